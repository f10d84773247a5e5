"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names; gradients and verdicts of the fitted rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from krathong.llm import components, decontaminate, mixing, quality_rank, quality_rules, simhash_dedup, toxicity, transcripts

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} filler." for i in range(60_000))
GOOD = "This is a plain sentence of ordinary words, one after another. "
CLASH = "doc_id long, text string, lang string, source string, n_chars long, row string, kept boolean, base_failed string, score double, predicted int, size string, copies string, mix_size string, leaks int, blob string, spans string, fp long, d string, h string, digest string, rules string"


def odd(spark):
    texts = [None, "", " \n", GOOD * 8, GOOD * 8, LONG, "a | b", "password=abcdefghijklmnop " + GOOD * 9]
    rows = [(i, t, "en", s, 0, "r", True, "b", 0.5, 1, "z", "c", "m", 3, "bl", "sp", 7, "d", "h", "dg", "ru") for i, (t, s) in enumerate(zip(texts, [None, "a", "a", "b", "b", "b", None, "a"]))]
    rows += [(None, GOOD * 8, *rows[0][2:])] * 2 + [(3, "another text of the same id " + GOOD * 7, *rows[3][2:])] * 2
    return spark.createDataFrame(rows, CLASH)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_rules(spark, docs, labels):
    model = quality_rules.fit(docs, labels)
    rows = quality_rules.quality_rules(odd(spark), model).collect()
    assert len(rows) == 12 and sum(r.doc_id is None for r in rows) == 2
    assert all(r.base_failed and not r.kept for r in rows if not r.n_words)
    same = [r[1:] for r in rows if r.doc_id in (3, 4, None) and r.n_words == 8 * len(GOOD.split())]
    assert len(same) == 4 and len(set(same)) == 1
    assert quality_rules.quality_rules(odd(spark).limit(0), model).count() == 0
    untrained = quality_rules.fit(docs.limit(0), labels)
    assert quality_rules.measure([GOOD * 8, ""], untrained).content_share.tolist() == [1.0, 0.0]


def test_models_are_kept(spark, docs, labels, tmp_path):
    texts = [r.text or "" for r in docs.limit(40).collect()]
    convs = spark.read.parquet(f"{SF}/conversations.parquet")
    for k, (model, judge) in enumerate([(quality_rules.fit(docs, labels), lambda m: quality_rules.measure(texts, m).content_share.tolist()), (quality_rank.fit(docs, labels), lambda m: quality_rank.score(texts, m).tolist()), (toxicity.fit(docs, labels), lambda m: toxicity.score(texts, m).tolist()), (transcripts.fit(convs), lambda m: [transcripts.parse(t, m) for t in texts])]):
        quality_rules.C.save_model(spark, model, str(tmp_path / str(k)))
        assert judge(quality_rules.C.load_model(spark, str(tmp_path / str(k)))) == judge(model)


def test_verdict_by_hand(docs, labels):
    """kept is what Viterbi's labels say by the share of words, decoded here by comparing all paths of short texts."""
    model = quality_rules.fit(docs, labels)
    texts = ["\n".join(x) for x in (["BUY!! NOW!! $$$ | HOME |", GOOD * 6], [GOOD * 9, "%%% ###", "a"], ["| CART | %%% $$$ " * 20, GOOD])]
    got = quality_rules.measure(texts, model)
    for k, t in enumerate(texts):
        lines = t.split("\n")
        x = quality_rules.C.Lines([t])
        s = quality_rules.line_features(x, quality_rules.duplicate_lines([t])) @ model["w"]
        value = lambda p: sum(v for v, y in zip(s, p) if y) + sum(model["trans"][a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(([int(b) for b in f"{n:0{len(lines)}b}"] for n in range(2 ** len(lines))), key=value)
        share = sum(len(w.split()) for w, y in zip(lines, best) if y) / max(1, len(t.split()))
        assert math.isclose(got.content_share[k], share)
        assert got.kept[k] == (not got.base_failed[k] and share >= quality_rules.KEEP_SHARE)


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(3)
    per = np.array([4, 2, 1])
    first = np.concatenate(([0], np.cumsum(per)[:-1]))
    score, trans, y = np.column_stack([np.zeros(7), rng.normal(size=7)]), rng.normal(size=(2, 2)), rng.random(7) < 0.5
    active = [int((per > t).sum()) for t in range(per[0])]

    def loss(score, trans):
        total = 0.0
        for a, n in zip(first, per):
            paths = [[int(b) for b in f"{k:0{n}b}"] for k in range(2**n)]
            value = lambda p: sum(score[a + i, v] for i, v in enumerate(p)) + sum(trans[u, v] for u, v in zip(p, p[1:]))  # noqa: B023, E731
            total += np.log(sum(np.exp(value(p)) for p in paths)) - value(y[a : a + n].astype(int).tolist())
        return total

    gy, gt = quality_rules._gradient(score, trans, y, per, first, active)
    step = 1e-5
    for i in range(7):
        up, down = score.copy(), score.copy()
        up[i, 1] += step
        down[i, 1] -= step
        assert math.isclose(gy[i], (loss(up, trans) - loss(down, trans)) / (2 * step), abs_tol=1e-6)
    for i in range(2):
        for j in range(2):
            up, down = trans.copy(), trans.copy()
            up[i, j] += step
            down[i, j] -= step
            assert math.isclose(gt[i, j], (loss(score, up) - loss(score, down)) / (2 * step), abs_tol=1e-6)


def test_quality_rank(spark, docs, labels):
    model = quality_rank.fit(docs, labels)
    rows = quality_rank.rank_quality(odd(spark), model).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 and r.predicted == (r.score >= quality_rank.CUT) for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert quality_rank.rank_quality(odd(spark).limit(0), model).count() == 0
    assert set(quality_rank.score(["a", GOOD], quality_rank.fit(docs.limit(0), labels)).round(9)) != set()
    # preference pairs: of two documents with both labels the better one scores higher on average
    texts, y = quality_rules.labelled_sample(docs, labels, "quality", 500, 30_000, lambda i: quality_rank.held_out(i))
    s, y = quality_rank.score(texts, model), np.array(y)
    assert np.mean(s[y == 1][:, None] > s[y == 0][None]) > 0.95


def test_groups_and_one_of_each(spark):
    got = simhash_dedup.simhash_groups(odd(spark)).collect()
    assert len(got) == 12 and {r.component_id for r in got if r.fingerprint == "0" * 16} == {0}
    kept = simhash_dedup.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    assert kept.count() == len({r.component_id for r in got})
    assert simhash_dedup.keep_one(odd(spark).limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    n = 3000
    chain = [(i, i + 1) for i in range(n)]
    star = [(10_000, 10_000 + i) for i in range(1, n)]
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b)) for a, b in rng.permutation(np.array(chain + star + [(7, 7), (1, 0)]))] + [(None, 5), (20_000, 20_001), (20_001, 20_000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {10_000 + i: 10_000 for i in range(n)} | {20_000: 20_000, 20_001: 20_000}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_leaks(spark):
    bench = spark.createDataFrame([(1, GOOD * 3, "x"), (None, GOOD * 3, "x"), (2, "", "x"), (3, None, "x")], "item_id long, text string, doc_id string")
    found = decontaminate.find_leaks(odd(spark), bench)
    assert {r.item_id for r in found.collect()} == {1, None} and found.filter("doc_id is null").count() == 4
    kept = decontaminate.without_leaks(odd(spark), bench)
    assert kept.columns == odd(spark).columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 5, 6]


def test_mix_of_odd_ids_and_many_sources(spark):
    rows = mixing.mix(odd(spark)).collect()
    assert len(rows) == 12
    by_id = {}
    for r in rows:
        if r["size"]:
            by_id.setdefault((r.doc_id, r.source_size), set()).add(r.copies)
    assert all(len(v) == 1 for v in by_id.values())
    got = mixing.mixed_rows(odd(spark))
    assert got.columns == [*odd(spark).columns, "mix_mix_size", "mix_copies"]
    assert sum(r.mix_copies * r.mix_mix_size for r in got.collect()) == sum(r.taken for r in rows)
    # five hundred sources: ranks by code point and the level that dealing the excess ends at
    rng = np.random.default_rng(1)
    sizes = {f"s{i:03d}é"[: 3 + i % 3] + str(i): int(v) for i, v in enumerate(rng.pareto(0.7, 500) * 10 + 1)} | {None: 40}
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        level = (budget - sum(capped.values())) / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * w[s] > 2 * sizes[s]]
        if not over:
            break
        capped |= {s: 2.0 * sizes[s] for s in over}
    want = capped | {s: level * w[s] for s in open_}
    made = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert len(made) == 501 and all(math.isclose(r.target, want[r.source], rel_tol=1e-12) for r in made)


def test_pipeline_of_odd_tables(spark, docs, labels, tmp_path):
    sf = str(tmp_path)
    table = odd(spark)
    table.write.parquet(f"{sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{sf}/{name}.parquet")
    out = P.run(spark, sf)
    assert set(table.columns) <= set(out.columns)
    rows = out.collect()
    assert all(r.text for r in rows) and not any("password=" in r.text for r in rows)
    empty = table.limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
        extra = stage(spark, table.withColumn("extra col", F.lit(1)), sf)
        assert "extra col" in extra.columns and extra.count() <= table.count(), name
