"""The training-data operators: brute force on small tables, round trips, held-out accuracy, odd inputs."""

import hashlib
import math
import os
import re
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from krathong.llm import components, decontaminate, entry, html_extract, mixing, quality_rank, quality_rules, secret_scan, simhash_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _kept string, size string, h string"


def docs_of(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", f"s{k % 2}" if k % 5 else None, None, "x", "y", "z") for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


LONG = " ".join(f"word{i % 977} filler." for i in range(60_000))
ODD = [None, "", " ", "one", "one", "a b c d e f", "Ünïcode ſK text\x1cword   x", "a\n\nb\r\n", LONG]


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- quality rules


def brute_rules(t):
    t = t or ""
    w = WORD.findall(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i, g in enumerate(zip(w, w[1:], w[2:])):
        if tri[g] > 1:
            hit |= {i, i + 1, i + 2}
    lines = t.split("\n")
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_rules_equal_brute_force(spark, real):
    model = {"w": np.eye(1, 15)[0], "trans": np.zeros((2, 2))}
    df = real.select("doc_id", "text").unionAll(docs_of(spark, ODD, range(10_000, 10_000 + len(ODD))).select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in quality_rules.quality_rules(df, model).collect():
        want = brute_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        score, trans = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = lambda p: sum(score[i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))
        best = max((tuple(int(b) for b in f"{k:0{n}b}") for k in range(2**n)), key=value)
        assert tuple(quality_rules.viterbi(score, trans).astype(int)) == best


def test_field_tells_junk_from_prose(spark):
    good = ["This is a plain sentence of ordinary words, one after another. " * 6] * 12
    bad = ["BUY!! NOW!! $$$ ### CHEAP!! | HOME | CART | %%% " * 8] * 12
    model = quality_rules.train(good + bad, [1] * 12 + [0] * 12, rounds=2, steps=60)
    share = quality_rules.measure([good[0], bad[0], good[0] + "\n" + bad[0]], model).content_share.tolist()
    assert share[0] > 0.9 and share[1] < 0.1 and 0.2 < share[2] < 0.9


# ---- near duplicates


def brute_print(t, k=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, radius=4):
    """rows: (id, fingerprint)."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if (rows[a][1] ^ rows[b][1]).bit_count() <= radius:
            root[find(b)] = find(a)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, f"{f:016x}", low.get(find(k))) for k, (i, f) in enumerate(rows)), key=repr)


def groups(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.simhash_groups(df).collect()), key=repr)


def test_groups_equal_brute_force(spark, real):
    texts = [r.text for r in real.orderBy("doc_id").collect()][:120]
    texts += [t + " tail" for t in texts[:15]] + ODD
    ids = [*range(len(texts) - 2), None, 3]
    assert groups(docs_of(spark, texts, ids)) == brute_groups([(i, brute_print(t)) for i, t in zip(ids, texts)])
    assert groups(docs_of(spark, [])) == []


@pytest.mark.parametrize(("run", "sample"), [(4, 64), (4, 2), (1024, 64)])
def test_links_of_clusters(spark, monkeypatch, run, sample):
    """Tight clusters, with runs that fit a task, runs that are cut into chunks, and variants known to be hot beforehand."""
    monkeypatch.setattr(simhash_dedup, "RUN", run)
    monkeypatch.setattr(simhash_dedup, "SAMPLE", sample)
    rng = np.random.default_rng(3)
    fps = []
    for c in rng.integers(0, 2**63, 3).tolist():
        for _ in range(40):
            f = c
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                f ^= 1 << b
            fps.append(f)
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = simhash_dedup.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4)
    got = {r.node: r.root for r in components.components(links).collect()}
    want = {i: c for i, _, c in brute_groups([(s, f) for s, f in zip(signed, fps)])}
    assert {s: got.get(s, s) for s in signed} == want


def test_one_of_each_group_stays(spark):
    texts = ["alpha beta gamma delta epsilon"] * 3 + ["other words stand here in this text", None, ""]
    kept = simhash_dedup.keep_one(docs_of(spark, texts, [5, 2, 2, 7, 8, 9])).collect()
    assert sorted(r.doc_id for r in kept) == [2, 7, 8]


def test_each_group_keeps_one_row_whatever_its_ids(spark):
    a, b, c, d = ("alpha beta gamma delta epsilon", "other words stand here in this text", "nothing of this is found elsewhere", "one more text that no other row has")
    for ids, texts in (([None] * 4, [a, b, c, d]), ([7, 9, 7, 2], [a, a, b, b]), ([None, 1, None, None, None], [a, a, b, b, c]), ([3, 3, 3, None, None], [a, b, a, None, ""])):
        df = spark.createDataFrame([(i, t, k % 2) for k, (i, t) in enumerate(zip(ids, texts))], "doc_id long, text string, k int")
        kept = [(r.doc_id, r.text) for r in simhash_dedup.keep_one(df).collect()]
        group = lambda t: brute_print(t)
        want = {}
        for i, t in zip(ids, texts):
            want[group(t)] = min(want.get(group(t), math.inf), math.inf if i is None else i)
        assert sorted((group(t), math.inf if i is None else i) for i, t in kept) == sorted(want.items())


# ---- secrets


def brute_spans(t):
    rules = [(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, lambda m: len(m[2]) >= 12), (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18), (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 16)]
    found = sorted((m.start(), k, m.end()) for k, (p, f, ok) in enumerate(rules) for m in re.finditer(p, t or "", f) if ok(m))
    names = ["assign", "access", "hex"]
    return [sum(k == i for _, k, _ in found) for i in range(3)], hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest()


SECRETS = ["password=token: abcdefghijklmnop", "é PassWord = 'abcdefghijkl' AKIAABCDEFGHIJKLMN x 0123456789abcdef0", "api_key:abcdefghijklmno apikey=short token=\"aaaaaaaaaaaa\"", "AKIAAKIA1 deadbeefdeadbee deadbeefdeadbeef", "-----BEGIN RSA PRIVATE KEY-----", "\U0001f600 secret: 0123456789abcdef"]


def test_secrets_equal_brute_force(spark, real):
    df = real.select("doc_id", "text").unionAll(docs_of(spark, SECRETS + ODD, range(10_000, 10_000 + len(SECRETS + ODD))).select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in df.collect()}
    rows = secret_scan.secret_scan(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == brute_spans(texts[r.doc_id])


def test_only_unseen_pairs_are_scanned(spark, monkeypatch):
    first = docs_of(spark, SECRETS[:3])
    ledger = secret_scan.update_ledger(first, None, "doc_id")
    both = docs_of(spark, SECRETS[:4] + SECRETS[:1])
    new = secret_scan.update_ledger(both, ledger, "doc_id")
    assert ledger.count() == 3 and new.count() == 1
    found = secret_scan.findings(both, ledger.unionAll(new), "doc_id").collect()
    assert len(found) == 5 and all(r.spans is not None and r.rules == sorted(secret_scan.rule_names()) for r in found)
    assert sorted(map(repr, secret_scan.secret_scan(both, ledger=ledger).collect())) == sorted(map(repr, secret_scan.secret_scan(both).collect()))
    # one rule gets a new version: only that rule runs again, and its old findings go
    rules = [(k, v + (k == "hex"), p.replace("{16,}", "{18,}") if k == "hex" else p, n, h) for k, v, p, n, h in secret_scan.RULES]
    monkeypatch.setattr(secret_scan, "RULES", rules)
    again = secret_scan.update_ledger(both, ledger.unionAll(new), "doc_id")
    assert [r.rules for r in again.collect()] == [["hex@3"]] * 4
    merged = secret_scan.findings(both, ledger.unionAll(new).unionAll(again).unionAll(again), "doc_id").collect()
    alone = secret_scan.findings(both, secret_scan.update_ledger(both, None, "doc_id"), "doc_id").collect()
    assert sorted(map(repr, merged)) == sorted(map(repr, alone)) and "hex@3" in merged[0].rules


def test_ledger_store(spark, tmp_path):
    store = secret_scan.Ledger(spark, str(tmp_path / "ledger"))
    first, both = docs_of(spark, SECRETS[:3]), docs_of(spark, SECRETS + ODD)
    assert [store.update(d, "doc_id").count() for d in (first, first, both, both)] == [3, 0, len(set(SECRETS) - set(SECRETS[:3])) + len({t or "" for t in ODD}), 0]
    got = secret_scan.digest(store.findings(both, "doc_id"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, secret_scan.secret_scan(both).collect()))


def test_secrets_of_odd_tables(spark):
    many = " ".join(f"password=abcdefghij{i:05d}" for i in range(3000))
    rows = [(None, many, "b", 1, "s"), (None, many, "b", 1, "s"), ("x", None, "b", 1, "s")]
    df = spark.createDataFrame(rows, "doc_id string, text string, blob string, rules int, spans string")
    got = secret_scan.secret_scan(df).collect()
    assert sorted((r.doc_id or "", r.n_assign) for r in got) == [("", 3000), ("", 3000), ("x", 0)] and got[0].base_sha256 in {brute_spans(many)[1], brute_spans("")[1]}
    assert secret_scan.secret_scan(df.limit(0)).count() == 0 == secret_scan.redact(df.limit(0)).count()
    masked = secret_scan.redact(df)
    assert masked.columns == df.columns and sorted((r.text or "")[:17] for r in masked.collect()) == ["", "[secret] [secret]", "[secret] [secret]"]


def test_redaction(spark):
    got = [r.text for r in secret_scan.redact(docs_of(spark, [SECRETS[1], "plain", None])).orderBy("doc_id").collect()]
    assert got == ["é [secret]' [secret] x [secret]", "plain", None]


# ---- mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), {}
    while True:
        rest, open_ = budget - sum(capped.values()), [s for s in names if s not in capped]
        level = rest / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * w[s] > 2 * sizes[s]]
        if not over:
            return capped | {s: level * w[s] for s in open_}
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mix(spark, real):
    for df in (real, docs_of(spark, ODD), docs_of(spark, [None, ""]), docs_of(spark, [])):
        rows = mixing.mix(df).collect()
        src = {r.doc_id: r.source for r in df.select("doc_id", "source").collect()}
        sizes, taken, target, biggest = Counter(), Counter(), {}, Counter()
        for r in rows:
            s = src[r.doc_id]
            sizes[s] += r["size"]
            taken[s] += r.taken
            target[s] = r.target
            biggest[s] = max(biggest[s], r["size"])
            assert 0 <= r.taken <= 2 * r["size"]
        want = brute_targets(sizes) if rows else {}
        assert len(rows) == df.count()
        for s in sizes:
            assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-9)
            assert abs(taken[s] - target[s]) <= biggest[s] / 2 + 1e-6
        assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(df).collect()))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, name):
    c = duckdb.connect()
    p = f"{SF}/documents.parquet"
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df = entry.queries()[name](spark, SF)
    want = c.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(x) for x in cols]
    assert sorted(tuple(r[x] for x in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


# ---- decontamination


def brute_leaks(texts, items):
    out = set()
    for d, t in texts:
        w = decontaminate.words_of(t or "")
        for i, x in items:
            v = decontaminate.words_of(x or "")
            k = min(5, len(v))
            if not v or len(w) < k:
                continue
            sh = lambda s: Counter(tuple(s[a : a + k]) for a in range(len(s) - k + 1))
            want = sh(v)
            for a in range(max(1, len(w) - len(v) + 1)):
                own = sh(w[a : a + len(v)])
                both = sum((own & want).values())
                if both >= 0.8 * (sum(own.values()) + sum(want.values()) - both):
                    out.add((d, i))
                    break
    return out


def test_leaks_equal_brute_force(spark):
    item = " ".join(f"w{i}" for i in range(40))
    edited = item.replace("w39", "changed")
    near = " ".join(f"w{i}" for i in range(1, 40)) + " more"
    items = [(1, item), (2, "tiny item"), (3, None), (4, ""), (5, "a b a b a b a b a b a b"), (5, "a b a b a b a b a b a b")]
    texts = [*enumerate([f"head {item} tail", edited, near, " ".join(f"w{i}" for i in range(0, 40, 2)), "a tiny, ITEM here", "a b a b a b a b a b a b a b", item[:60], *ODD])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = decontaminate.find_leaks(df, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_leaks(texts[:-1], [*dict(items).items()])
    assert {(0, 1), (1, 1), (4, 2)} <= {(r.doc_id, r.item_id) for r in got.collect()}
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(df, bench).count() == len(texts) - got.select("doc_id").distinct().count()


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 15)
    assert sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect())) == whole


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=decontaminate.RADIUS, unique=True))
def test_every_print_within_the_radius_shares_a_block(fp, bits):
    other = fp
    for b in bits:
        other ^= 1 << b
    pairs = zip(decontaminate.block_values(fp), decontaminate.block_values(other))
    assert any((a ^ b).bit_count() <= decontaminate.RADIUS // decontaminate.BLOCKS for a, b in pairs)


def test_the_radius_holds_similar_pairs():
    """Of random pairs of windows with a similarity of 0.8 or more, hardly any differ in more bits than the radius; none is lost otherwise."""
    rng = np.random.default_rng(7)
    seen = within = found = 0
    for _ in range(1500):
        n = int(rng.integers(12, 120))
        a = [f"w{x}" for x in rng.integers(0, 5000, n)]
        b = list(a)
        for at in rng.choice(n, rng.integers(0, 1 + max(1, n // 45)), replace=False):
            b[at] = f"x{at}"
        if rng.random() < 0.4:
            cut = int(rng.integers(0, 1 + n // 12))
            b = b[cut:] + [f"y{i}" for i in range(cut)]
        sh = lambda s: Counter(tuple(s[i : i + 5]) for i in range(len(s) - 4))
        x, y = sh(a), sh(b)
        both = sum((x & y).values())
        if both < decontaminate.SIMILARITY * (x.total() + y.total() - both):
            continue
        prints = [int(decontaminate.window_prints(decontaminate.shingle_hashes(w, 5), n - 4)[0]) for w in (a, b)]
        seen += 1
        within += (prints[0] ^ prints[1]).bit_count() <= decontaminate.RADIUS
        found += bool(decontaminate.Index([(1, " ".join(a))]).find(" ".join(["zz", *b, "zz"])))
    print(seen, within, found)
    assert seen > 700 and within >= 0.995 * seen and found >= 0.995 * seen


def test_many_items_of_one_length_are_found_by_the_index():
    """Without its blocks nothing is found: every candidate comes through them."""
    rng = np.random.default_rng(8)
    items = [(i, "common opening words of all " + " ".join(f"w{x}" for x in rng.integers(0, 400, 30))) for i in range(300)]
    index = decontaminate.Index(items)
    texts = [items[5][1] + " tail", "head " + items[9][1] + " " + items[11][1], items[3][1].replace("common", "usual")]
    got = [index.find(t) for t in texts]
    assert [sorted(i for i, *_ in g) for g in got] == [[5], [9, 11], [3]]
    index.blocks = {}
    assert [index.find(t) for t in texts] == [[], [], []]


# ---- classifiers


def auc(score, y):
    r = np.argsort(np.argsort(score)) + 1
    return (r[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize(("module", "label", "score", "least"), [(quality_rank, "quality", quality_rank.rank_quality, 0.97)])
def test_held_out_accuracy(spark, module, label, score, least):
    sf = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = module.fit(docs, labels)
    rows = score(docs, model).join(labels, "doc_id").filter("held_out").collect()
    y = np.array([r[label] for r in rows])
    assert auc(np.array([r.score for r in rows]), y) > least
    odd = score(docs_of(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert odd[0].score == odd[1].score and odd[3].score == odd[4].score
    assert score(docs_of(spark, []), model).count() == 0


# ---- HTML


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<nav><a href=/>Home</a></nav><article><h1>T</h1><p>A &amp; b<b>c</b>\n  d<p>e</article><footer>x</footer>", "T A & bc d e"),
        ("<article><p>Body text of the story.</p><aside>ad</aside><section class='comments'><p>Nice!</p></section><div id=cookie-notice>ok?</div><form><p>mail</p></form></article>", "Body text of the story."),
        ("<article><p>cut off &lt;here", "cut off <here"),
        ("<nav><ul><li>menu<article><p>Still found.</p></article>", "Still found."),
        ("<body><div class=header>Site</div><div id=main><p>A long paragraph of real text, with words.</p><p>Short.</p></div><div class='sidebar'><p>Links</p></div></body>", "A long paragraph of real text, with words. Short."),
        ("<article><p>one <button>Share</button>two<noscript><p>n</p></noscript> three<span class=ad>AD</span></p></article>", "one two three"),
        ("<script>var a='</p>';</script><article>x<script>y</script><style>z</style></article>", "x"),
    ],
)
def test_extract(page, want):
    assert html_extract.extract(page or "") == want


PROSE = "A long paragraph of plain words that tell the story of this page, one after the other. " * 6


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # the clusters decide, though there is an article
        (f"<article><a>One</a><br><a>Two</a><br><a>Go</a></article><div><p>{PROSE}</p><p>{PROSE}</p></div><div><a>Up</a></div>", f"{PROSE}{PROSE}"),
        (f"<article><p>{PROSE}</p></article><div><a>Up</a><br><a>Down</a></div>", PROSE),
        # short sections between and beside long ones stay, lists of links do not
        (f"<div><div><a>Home</a><br><a>Map</a></div><section><h1>Title</h1></section><section><p>{PROSE * 9}</p></section><div><p>In short.</p></div><section><p>{PROSE}</p></section><section><p>The end.</p></section></div>", f"Title {PROSE * 9}In short. {PROSE}The end."),
        (f"<main><h1>Title</h1><article><p>{PROSE}</p></article><article><p>Note.</p></article></main><div>Site</div>", f"Title {PROSE}Note."),
    ],
)
def test_clusters_choose_regions(page, want):
    assert html_extract.extract(page) == want.strip()


def test_extract_pages_rows(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (None, "u", "<article>" + "<p>x y</p>" * 20_000 + "</article>", "t")], "page_id long, url string, html string, text string")
    rows = html_extract.extract_pages(df).collect()
    assert [r.n_chars for r in rows] == [0, 0, 4 * 20_000 - 1]


# ---- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, now, kept = docs.columns, docs, [docs.count()]
    for _, stage in P.STAGES:
        now = P.common.materialize(stage(spark, now, SF))
        assert set(cols) <= set(now.columns)
        kept.append(now.count())
    assert kept == sorted(kept, reverse=True) and 0 < kept[-1] < kept[0]
    assert not any("password=" in (r.text or "") and brute_spans(r.text)[0][0] for r in now.collect())
    assert not brute_leaks([(r.doc_id, r.text) for r in now.limit(40).collect()], [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])


def brute_kept(rows):
    """One row of each group: the least (id, text hash), null ids last."""
    prints = [brute_print(r[1]) for r in rows]
    group = [c for _, _, c in sorted(((i, f, c) for (i, f, c) in brute_groups([(k, f) for k, f in enumerate(prints)])))]
    order = lambda r: (r[0] is None, r[0] or 0, (xxhash.xxh64_intdigest(r[1].encode(), 42) + 2**63) % 2**64 - 2**63)
    best = {}
    for g, r in zip(group, rows):
        if g not in best or order(r) < order(best[g]):
            best[g] = r
    return list(best.values())


def brute_redacted(t):
    rules = [(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, 12, 1), (r"AKIA[A-Z0-9]+", 0, 18, 0), (r"[0-9a-f]+", 0, 16, 0)]
    hidden = sorted((m.start(), m.end()) for p, f, n, g in rules for m in re.finditer(p, t, f) if len(m[g]) >= n)
    out, at = "", 0
    for a, b in hidden:
        if a >= at:
            out += t[at:a] + "[secret]"
        at = max(at, b)
    return out + t[at:]


def brute_mixed(rows):
    """rows: (id, text, source); with copies, where there are any."""
    sizes, by = Counter(), {}
    for i, t, s in rows:
        h = hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[: mixing.DIGITS]
        sizes[s] += len(WORD.findall(t))
        by.setdefault(s, []).append((h, len(WORD.findall(t)), (i, t, s)))
    out = []
    for s, target in brute_targets(sizes).items():
        whole = math.floor(target / sizes[s]) if sizes[s] else 0
        rest = target - whole * sizes[s]
        for h, _, row in by[s]:
            cum, own = sum(n for x, n, _ in by[s] if x <= h), sum(n for x, n, _ in by[s] if x == h)
            more = rest > 0 and (cum <= rest or cum - own <= rest and cum - rest < rest - (cum - own))
            out += [(*row, whole + more)] if whole + more else []
    return out


def test_each_stage_equals_brute_force(spark, real, tmp_path):
    import corpus_pipeline as P

    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(6)
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = [(r.doc_id, r.text, r.source) for r in real.filter("n_chars between 400 and 2500").orderBy("doc_id").limit(60).collect()]
    long = [r for r in rows if len(WORD.findall(r[1])) >= 100]
    assert len(long) >= 16
    a = [t for _, t, _ in long]
    rows += [(None, a[0], "n"), (None, a[1] + " tail", "n"), (None, " ".join(WORD.findall(a[2])[::-1]), "n"), (None, " ".join(WORD.findall(a[3])[::-1]), None)]  # null ids
    rows += [(900_000, " ".join(WORD.findall(a[k])[::-1]), "r") for k in (4, 5, 5)] + [(900_001, " ".join(WORD.findall(a[5])[::-1]) + " end", "r"), (long[6][0], a[7], "r")]  # repeated ids
    rows += [(900_002, f"{a[8][::-1]} {items[0][1]}", "r"), (900_003, " ".join(WORD.findall(a[9])[::-1]) + " password=abcdefghijklmnop 0123456789abcdef0 x", "r"), (900_004, None, "r"), (900_005, "", "r")]
    sf = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{sf}/documents.parquet")
    bench.write.parquet(f"{sf}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    # the model sees the same table in the stage and here
    model = quality_rules.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))

    def good(t):
        n, *_, rep = brute_rules(t)
        return n >= 50 and 2 * rep <= n and quality_rules.measure([t], model).content_share[0] >= quality_rules.KEEP_SHARE

    leaky = lambda rows: {d for d, _ in brute_leaks([(k, r[1]) for k, r in enumerate(rows)], items)}
    brute = [
        lambda rows: [r for r in rows if good(r[1] or "")],
        brute_kept,
        lambda rows: [r for at in [leaky(rows)] for k, r in enumerate(rows) if k not in at],
        lambda rows: [(i, brute_redacted(t), s) for i, t, s in rows],
        brute_mixed,
    ]
    now, seen = docs, rows
    for (name, stage), f in zip(P.STAGES, brute, strict=True):
        now = P.common.materialize(stage(spark, now, sf))
        want = f(seen)
        seen = [(r.doc_id, r.text, r.source) for r in now.collect()]
        got = [(*r, c.copies) for r, c in zip(seen, now.collect())] if name == "mixing sources" else seen
        assert Counter(got) == Counter(want), name
        assert len(want) > 5
        if name == "simhash near-dedup":
            assert sum(r[0] is None for r in got) >= 2
