"""Secret scans over an incremental blob ledger, in DataFrame and SQL functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds, for each blob, which rules of
which version have scanned it, and the spans they found. A scan takes the blobs of the history, drops
the pairs of blob and rule version that the ledger has, fetches each text with pairs left once however many paths or
versions share it, runs the missing rules only, appends the findings and joins them back to all paths. A rule whose
version rises is scanned anew, and what its older versions found no longer counts; the others are not run again.

Spans are found without Python: ``regexp_extract_all`` gives the matches, ``split`` on the same
pattern the gaps between them, and their running lengths are the offsets in code points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_KEY = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
#: kind, version, pattern, least length, what of a match has that length: the match or what follows its head. A rule
#: whose pattern, length or head changes gets a higher version. The first three are the base rules; the order ranks
#: kinds whose spans start together.
RULES = [
    ("assign", 2, rf"(?:{_KEY})[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", 12, rf"^(?:{_KEY})[\"']?\x20*[:=]\x20*[\"']?"),
    ("access", 2, r"AKIA[A-Z0-9]+", 18, ""),
    ("hex", 2, r"[0-9a-f]{16,}", 16, ""),
    ("pem", 2, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1, ""),
    ("jwt", 2, r"eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", 1, ""),
]
BASE = 3
_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
#: What the ledger stores: spans by the names of their rules, so that rules may be reordered.
LEDGER = "blob string, rules array<string>, spans array<struct<rule:string,start:bigint,end:bigint>>"


def rule_names() -> list[str]:
    """``kind@version`` of each rule, in the order of RULES."""
    return [f"{kind}@{version}" for kind, version, *_ in RULES]


def _quoted(s: str) -> str:
    return "r'" + s.replace("'", r"\x27") + "'"


def kind_spans(text: str, rank: int) -> str:
    """SQL for the spans of one rule in the column named ``text``."""
    _, _, pattern, least, head = RULES[rank]
    p = _quoted(pattern)
    size = f"length(regexp_replace(x.m, {_quoted(head)}, ''))" if head else "length(x.m)"
    place = "s.at + length(x.g)"
    # there is one gap more than matches: its match is null and it ends the walk. An accumulator is copied in every step, so
    # the spans are gathered in a string
    walk = (
        f"aggregate(zip_with(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1), (m, g) -> named_struct('m', m, 'g', g)),"
        f" named_struct('at', 0L, 'out', ''), (s, x) -> named_struct('at', s.at + length(x.g) + coalesce(length(x.m), 0),"
        f" 'out', IF(x.m IS NOT NULL AND {size} >= {least}, concat(s.out, ',', {place}, ':', {place} + length(x.m)), s.out)), s -> s.out)"
    )
    spans = f"transform(filter(split({walk}, ','), y -> y <> ''), y -> named_struct('start', CAST(split_part(y, ':', 1) AS BIGINT), 'kind', {rank}, 'end', CAST(split_part(y, ':', 2) AS BIGINT)))"
    return f"IF({text} rlike {p}, {spans}, CAST(array() AS {_SPANS}))"


def _text_list(names: list[str]) -> str:
    return "array(" + ", ".join(f"'{n}'" for n in names) + ")"


def scan(blobs: DataFrame) -> DataFrame:
    """Ledger rows of the blobs (blob, text, todo): the spans that the rules named in ``todo`` find in the text, sorted."""
    names = rule_names()
    spans = ", ".join(f"IF(array_contains(todo, '{n}'), {kind_spans('text', i)}, CAST(array() AS {_SPANS}))" for i, n in enumerate(names))
    named = f"transform(array_sort(concat({spans})), x -> named_struct('rule', element_at({_text_list(names)}, x.kind + 1), 'start', x.start, 'end', x.end))"
    return blobs.select("blob", F.col("todo").alias("rules"), F.expr(named).alias("spans"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def versions(df: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, blob, text); a null text counts as empty."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return df.select(F.col(f"`{path_col}`").alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def update_ledger(history: DataFrame, ledger: DataFrame | None, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """New ledger rows: for each blob of the history the rule versions that the ledger lacks for it, and what they find.

    ``ledger`` None: nothing was scanned before. Else hashes alone are held against it, and texts are fetched for what is left.
    Texts that hold no secret get a row with no spans, so they are not scanned again. The result is a table in the
    shared folder; append it to the ledger.
    """
    texts = versions(history, path_col, text_col).select("blob", "text")
    every = F.expr(_text_list(rule_names()))
    if ledger is None:
        return C.materialize(scan(texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", every)))
    seen = ledger.groupBy(F.col("blob").alias("seen")).agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("done"))
    todo = texts.select("blob").distinct().join(seen, F.col("blob") == F.col("seen"), "left")
    todo = todo.select(F.col("blob").alias("b"), F.array_except(every, F.coalesce("done", F.expr("CAST(array() AS array<string>)"))).alias("todo")).filter("size(todo) > 0")
    todo = C.materialize(todo)
    found = texts.join(todo, F.col("blob") == F.col("b")).groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    return C.materialize(scan(found))


def findings(history: DataFrame, ledger: DataFrame, path_col: str = "path", text_col: str = "text", unique: bool = False) -> DataFrame:
    """(path, blob, rules, spans) of each row of the history: the present rule versions that have scanned its blob and
    their spans (start, kind as a rank, end) in order; both null where the ledger lacks the blob.

    ``unique``: the ledger holds each blob once, as a first ``update_ledger`` returns it. Else its rows are merged
    into a table first: a join next to an aggregate could not have the copies of a hot blob dealt anew.
    """
    names = _text_list(rule_names())
    own = ledger.select(F.col("blob").alias("scanned"), F.expr(f"filter(rules, x -> array_contains({names}, x))").alias("rules"), F.expr(f"filter(spans, x -> array_contains({names}, x.rule))").alias("spans"))
    if not unique:
        own = own.groupBy("scanned").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
        own = C.materialize(own)
    ranked = f"array_sort(transform(spans, x -> named_struct('start', x.start, 'kind', array_position({names}, x.rule) - 1, 'end', x.end)))"
    own = own.select("scanned", F.array_sort("rules").alias("rules"), F.expr(f"CAST({ranked} AS {_SPANS})").alias("spans"))
    return versions(history, path_col, text_col).select("path", "blob").join(own, F.col("blob") == F.col("scanned"), "left").select("path", "blob", "rules", "spans")


class Ledger:
    """A ledger kept as Parquet in a folder that Spark can read and write.

    ``update`` scans what the folder lacks and appends it. An append shows up whole or not at all, a rerun after a crash
    finds the same pairs missing, and rows written twice by two writers are merged when they are read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(LEDGER).parquet(self.path) if there else empty_ledger(self.spark)

    def update(self, history: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
        """Scans the history's unseen pairs, appends them and returns them."""
        new = update_ledger(history, self.read(), path_col, text_col)
        new.write.mode("append").parquet(self.path)
        return new

    def findings(self, history: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
        return findings(history, self.read(), path_col, text_col)


_NAMED = "transform({}, x -> concat(element_at(array(" + ", ".join(f"'{k}'" for k, *_ in RULES) + "), x.kind + 1), ':', x.start, ':', x.end))"


def digest(found: DataFrame) -> DataFrame:
    """The findings as counts, a hash of the base spans and all spans in one string."""
    count = [F.expr(f"CAST(size(filter(spans, x -> x.kind = {i})) AS BIGINT)").alias(f"n_{RULES[i][0]}") for i in range(BASE)]
    base = _NAMED.format(f"filter(spans, x -> x.kind < {BASE})")
    return found.select(F.col("path").alias("doc_id"), *count, F.sha2(F.expr(f"array_join({base}, ',')"), 256).alias("base_sha256"), F.expr(f"array_join({_NAMED.format('spans')}, ',')").alias("spans"), "blob", F.array_join("rules", ",").alias("rules"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None) -> DataFrame:
    """Digest columns of each row, scanning only what the ledger lacks.

    Null and empty texts have no spans. Rows that share a text, repeated rows and rows with a null id
    each get the findings of that text; ``rules`` names the rule versions that scanned it. Only the id and the
    text are read, so other columns of any name are no matter. An empty table gives none.
    """
    new = update_ledger(docs, ledger, id_col, text_col)
    return digest(findings(docs, new if ledger is None else ledger.unionByName(new), id_col, text_col, unique=ledger is None))


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The rows with each secret span of the text replaced by ``mask``; overlapping spans count as one.

    A null text stays null. Rows, repeated ones and those without an id too, stay as many; extra columns of any
    name come along. An empty table gives none.
    """
    new = update_ledger(docs.filter("text is not null"), None, "doc_id", "text").filter("size(spans) > 0").select("blob", "spans")
    # each span moves the place up to which the text is dealt with
    walk = (
        "aggregate(spans, named_struct('at', 0L, 'out', ''), (s, x) -> named_struct('at', greatest(s.at, x.end), 'out', IF(x.start >= s.at,"
        f" concat(s.out, substring(row.text, CAST(s.at + 1 AS INT), CAST(x.start - s.at AS INT)), '{mask}'), s.out)),"
        " s -> concat(s.out, substring(row.text, CAST(s.at + 1 AS INT))))"
    )
    rows = C.pack(docs).join(new, F.sha2(F.col("row.text"), 256) == F.col("blob"), "left")
    return rows.select(F.col("row").withField("text", F.expr(f"IF(spans IS NULL, row.text, {walk})")).alias("row")).select("row.*")


def op4_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(C.table(spark, sf_dir, "documents"))


def _oracle() -> str:
    parts = []
    for i, (kind, _, pattern, least, head) in enumerate(RULES):
        p = "'" + pattern.replace("'", "''") + "'"
        h = "'" + head.replace("'", "''") + "'"
        size = f"length(regexp_replace(m, {h}, ''))" if head else "length(m)"
        parts.append(
            f"""SELECT doc_id, rn, {i} AS kind, '{kind}' AS name, {size} >= {least} AS ok, pos - length(m) AS s, pos AS e FROM (
  SELECT doc_id, rn, m, sum(length(m) + length(g)) OVER (PARTITION BY rn ORDER BY i) AS pos FROM (
    SELECT doc_id, rn, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM (
      SELECT doc_id, rn, regexp_extract_all(t, {p}) AS ms, regexp_split_to_array(t, {p}) AS gs FROM d WHERE regexp_matches(t, {p}))))"""
        )
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rn FROM documents),
s AS ({' UNION ALL '.join(parts)}),
k AS (SELECT rn, kind, s, concat(name, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)) AS x FROM s WHERE ok),
g AS (SELECT rn, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS b, count(*) FILTER (WHERE kind = 2) AS c,
  string_agg(x, ',' ORDER BY s, kind) FILTER (WHERE kind < {BASE}) AS base, string_agg(x, ',' ORDER BY s, kind) AS spans FROM k GROUP BY rn)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, sha256(t) AS blob, '{",".join(sorted(rule_names()))}' AS rules FROM d LEFT JOIN g USING (rn)"""


ORACLE = _oracle()
