"""Operators with a model, a sample or a graph, held against brute force and invariants."""

from __future__ import annotations

import re
import shutil
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stratawise.llm import graph, lsh_forest, pareto_mix, rule_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_links(texts):
    sets = []
    for t in texts:
        w = t.encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return [[i != j and bool(a) and bool(b) and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]


def check_join(df, rows):
    rows = [r for r in rows if r[0] is not None]
    docs = sorted({(r[0], r[1] or "") for r in rows})
    linked = brute_links([t for _, t in docs])
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = defaultdict(int)
    for i, (a, _) in enumerate(docs):
        for j, (b, _) in enumerate(docs):
            if linked[i][j] and a != b:
                links[a] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}
    assert {d: find(d) for d, _ in docs} == {d: r["class_id"] for d, r in got.items()}
    assert {d: links[d] for d, _ in docs} == {d: r["n_links"] for d, r in got.items()}


def test_jaccard_join_on_edge_cases(docs, table, empty):
    check_join(lsh_forest.jaccard_join(docs), table)
    assert lsh_forest.jaccard_join(empty).count() == 0


@pytest.mark.parametrize(("block", "crowd"), [(128, 512), (16, 512), (16, 20)])
def test_jaccard_join_of_a_large_group_in_blocks(spark, block, crowd):
    import random

    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(f"q{rng.randrange(500)}" for _ in range(80))) for i in range(40)]
    check_join(lsh_forest.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block=block, crowd=crowd), rows)


def test_jaccard_join_of_repeated_representatives(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(1, base), (1, base), (2, base + " more"), (2, "something else " * 9), (3, base), (2, base + " more")]
    check_join(lsh_forest.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_jaccard_join_of_batches_of_many_short_texts(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(setting)
    spark.conf.set(setting, "0")  # no limit: a partition is one batch
    try:
        n = 20_000
        docs = spark.range(0, 2 * n, 1, 1).selectExpr("id AS doc_id", f"concat('text w', id % {n}) AS text")
        got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in lsh_forest.jaccard_join(docs).collect()}
    finally:
        spark.conf.set(setting, old)
    assert got == {i: (i % n, 1, 2) for i in range(2 * n)}


def test_a_chained_component_is_compared_by_nodes(spark, monkeypatch):
    # Each text shares most of its words with the next: a chain of weak meetings, with a near copy here and there.
    rows = []
    for i in range(150):
        w = [f"w{k}" for k in range(i * 15, i * 15 + 90)]
        rows += [(2 * i, " ".join(w))] + [(2 * i + 1, " ".join([*w[:-3], "end"]))] * (i % 5 == 0)
    modes, compare = [], lsh_forest._groups

    def watched(*args):
        out = compare(*args)
        modes.append(out.where("nodes is not null").count())
        return out

    monkeypatch.setattr(lsh_forest, "_groups", watched)
    check_join(lsh_forest.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), threshold=(4, 5), block=16, crowd=20), rows)
    assert modes[0] > 20


def test_recall_against_brute_force_on_texts_at_every_similarity(spark):
    import random

    rng, rows = random.Random(6), []
    for i in range(60):
        base = [f"b{i}x{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 200))]
        rows.append((10 * i, " ".join(base)))
        for j in range(1, 5):
            w = list(base)
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((10 * i + j, " ".join(w)))
    check_join(lsh_forest.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), rows)


def test_neighbours_in_a_trie_share_the_longest_prefix():
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 3, (200, 2 * 6)).astype(np.uint32) << np.uint32(28)
    for t, (node, below) in enumerate(lsh_forest.forest_paths(sig, 2, 6, 3)):
        own = sig[:, 6 * t : 6 * t + 6]
        order = np.lexsort((below, node))
        shared = lambda a, b: int(np.cumprod(own[a] == own[b]).sum())
        for k, a in enumerate(order.tolist()):
            best = max(shared(a, b) for b in range(200) if b != a)
            near = max(shared(a, int(order[x])) for x in (k - 1, k + 1) if 0 <= x < 200)
            assert near == best or best < 3


def test_forest_depth_and_recall():
    depth = lsh_forest.forest_depth(24, 8, 0.8, 0.9999)
    assert lsh_forest.expected_recall(0.8, 24, depth) >= 0.9999 > lsh_forest.expected_recall(0.8, 24, depth + 1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200), (7, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_targets():
    t = pareto_mix.targets([("b", 100), ("a", 10), (None, 50), ("c", 40)])
    assert t["a"] == 30.0 and abs(sum(t.values()) - 200) < 1e-9 and all(t[s] <= 3 * n for s, n in (("b", 100), (None, 50), ("c", 40)))
    assert abs(t["b"] / t["c"] - 2) < 1e-9 and abs(t[None] / t["c"] - 5) < 1e-9
    assert pareto_mix.targets([]) == {} and pareto_mix.targets([("a", 0)]) == {"a": 0.0}


def test_mix(spark, docs, table, empty):
    one = [tuple(r) for r in pareto_mix.mix_sizes(docs).select("doc_id", "source", "__size", "__source_size", "__target", "__copies").collect()]
    assert Counter((r[0], r[1], r[2]) for r in one) == Counter((r[0], r[3], len(WORD.findall(r[1] or ""))) for r in table)
    assert Counter(one) == Counter(tuple(r) for r in pareto_mix.mix_sizes(docs.repartition(5)).select("doc_id", "source", "__size", "__source_size", "__target", "__copies").collect())
    full = pareto_mix.mix(docs)
    assert Counter(one) == Counter(tuple(r) for r in full.select("doc_id", "source", "__size", "__source_size", "__target", "__copies").collect())
    assert set(docs.columns) < set(full.columns)
    assert all(0 <= r[5] <= 3 for r in one)
    assert pareto_mix.mix(empty).count() == 0


def brute_mix(rows, source, missing):
    """Take documents (key, size) by Pareto rank, sorted as a whole, up to the missing words; numbers of each key."""
    import math

    words = Counter()
    for _, n in rows:
        words[n and 1 + math.floor(math.log2(n) * 8 + 1e-9)] += n
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        if sum(w * min(1, mid * 2 ** (k / 16)) for k, w in words.items() if k) < missing:
            low = mid
        else:
            high = mid
    ranked = []
    for key, n in rows:
        if n:
            p, u = min(1, high * 2 ** ((1 + math.floor(math.log2(n) * 8 + 1e-9)) / 16)), (((key & (1 << 64) - 1) >> 12) + 0.5) / (1 << 52)
            ranked.append((u / (1 - u) * (1 - p) / p, key, n))
    taken, left = [], missing
    for rank, key, n in sorted(ranked):
        if n > left:
            break
        taken.append(key)
        left -= n
    return set(taken), left, {key for rank, key, n in ranked}


def test_mix_takes_the_smallest_ranks(spark):
    rows = [(i, "w " * (1 + i * 7919 % 300), f"s{i % 7}") for i in range(3000)] + [(9000 + i, "w " * 3, None) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keys = {r[0]: r[1] for r in df.selectExpr("doc_id", "xxhash64(cast(doc_id as string), text, 20)").collect()}
    for bins, bin_rows in ((1024, 2000), (1024, 50), (4, 20)):
        got = pareto_mix.mix_sizes(df, bins=bins, bin_rows=bin_rows).collect()
        for s in {r[2] for r in rows}:
            own = [r for r in got if r["source"] == s]
            size, target = own[0]["__source_size"], own[0]["__target"]
            whole = min(3, int(target // size))
            taken, left, able = brute_mix([(keys[r["doc_id"]], r["__size"]) for r in own], s, target - whole * size)
            mine = {keys[r["doc_id"]] for r in own if r["__copies"] > whole}
            # The same documents but for the one at the cut and the exchanges in its bin.
            assert len(mine ^ taken) <= 17, (s, bins, bin_rows, len(mine ^ taken), len(taken))
            assert abs(sum(r["__copies"] * r["__size"] for r in own) - target) <= 2


def test_mix_meets_targets_of_small_sources_and_varies_by_seed(spark):
    rows = [(i, "w " * (20 if i % 10 else 900 + i), f"s{i % 5}") for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target, size = Counter(), {}, {}
    for r in pareto_mix.mix_sizes(df).collect():
        taken[r["source"]] += r["__size"] * r["__copies"]
        target[r["source"]], size[r["source"]] = r["__target"], r["__source_size"]
    assert all(abs(taken[s] - t) <= 12 for s, t in target.items()), (taken, target)
    picks = [{r["doc_id"] for r in pareto_mix.mix_sizes(df, seed=s).where("__copies > 0").collect()} for s in (1, 2)]
    assert picks[0] != picks[1]


def test_inclusion_probabilities_are_unequal_and_calibrated():
    words = {1: 100, 17: 200, 33: 5000}
    factor = pareto_mix.calibrated(words, 1000)
    assert abs(sum(w * min(1, factor * 2 ** (k / 16)) for k, w in words.items()) - 1000) < 1e-6
    factor = pareto_mix.calibrated(words, 5200)  # the largest are certain
    assert factor * 2 ** (33 / 16) > 1 and abs(sum(w * min(1, factor * 2 ** (k / 16)) for k, w in words.items()) - 5200) < 1e-6


def test_mix_of_equal_documents_and_clashing_columns(spark):
    rows = [(1, "a b c", "s", 5, "x")] * 40 + [(2, "d e", "t", 6, "y")] * 3 + [(3, None, "t", 7, "z"), (4, "f " * 60, "u", 8, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __size long, __p string")
    out = pareto_mix.mix(df.repartition(3))
    got = out.collect()
    assert Counter((r["doc_id"], r["__p"]) for r in got) == Counter((r[0], r[4]) for r in rows) and out.columns[:3] == ["doc_id", "text", "source"]
    assert {r["__size"] for r in got} == {3, 2, 0, 60}
    for s in "stu":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["__size"] * r["__copies"] for r in own) - own[0]["__target"]) <= max(r["__size"] for r in own)


def test_near_duplicates_judge_a_repeated_id_by_its_own_texts(spark):
    import corpus_pipeline

    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    c = " ".join(f"c{i}" for i in range(60))
    rows = [(7, a, "x"), (7, b, "y"), (3, b, "z"), (8, a + " end", "u"), (9, "", "v"), (None, a, "w"), (1, a + " x", "p"), (1, b + " y", "q"), (1, c, "r"), (None, "", "s")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, s1 string"), "")
    assert Counter(tuple(r) for r in kept.collect()) == Counter([rows[6], rows[7], rows[8], rows[4], rows[9]])
    alone = [(None, a, "x"), (None, a, "w"), (None, c, "v")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(alone, "doc_id long, text string, s1 string"), "")
    assert Counter(tuple(r)[:2] for r in kept.collect()) == Counter([(None, a), (None, c)])
    twice = [(5, a, "x"), (5, a, "w"), (5, a, "w")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(twice, "doc_id long, text string, s1 string"), "")
    assert kept.count() == 1 and kept.columns == ["doc_id", "text", "s1"]


@pytest.fixture(scope="module")
def judged(spark):
    import random

    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        n = rng.randrange(20, 120)
        good = rng.random() < 0.8
        w = [rng.choice("theonly erst alpha beta gamma delta words of many kinds keit zu".split()) + rng.choice(["", "s", "en", "ly"]) for _ in range(n)]
        text = " ".join(w).capitalize() + "." if good else rng.choice([(w[0] + " ") * n, " ".join(x.upper() + "!!" for x in w), " ".join(x + rng.choice(["***", "###", "&&&"]) for x in w)])
        rows.append((i, text, "en", "src"))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((r[0], r[1]) for r in labels)


def test_rule_quality_on_held_out_rows(judged):
    docs, labels, gold = judged
    model = rule_quality.train(docs, labels)
    assert 0 < len(model.rules) < 60
    scored = {r["doc_id"]: r for r in rule_quality.score_quality(docs, model).collect()}
    held = [d for d in gold if zlib.crc32(str(d).encode()) % 3 == 1]
    assert len(held) > 50 and np.mean([scored[d]["__predicted"] == gold[d] for d in held]) > 0.95
    # Labels of held-out rows are never read.
    flipped = labels.sparkSession.createDataFrame([(d, 1 - q if d in held else q, 0) for d, q in gold.items()], labels.schema)
    assert rule_quality.train(docs, flipped) == model


def test_rule_statistics_by_hand(docs, table):
    out = rule_quality.statistics(docs.select("doc_id", "text"), "st_").collect()
    want = []
    for row in table:
        t, w = row[1] or "", WORD.findall(row[1] or "")
        n, letters = max(1, len(w)), sum(unicodedata.category(c).startswith("L") for c in t)
        count = lambda chars: sum(t.count(c) for c in chars)
        stats = (
            len(w), letters / n, len(set(w)) / n, np.log(len(set(w))) / np.log(len(w)) if len(w) > 1 else 1.0, sum(unicodedata.category(c) == "Lu" for c in t) / max(1, letters),
            count("#*$%&<>") / n, count("!?") / n, count("|") / n, count("0123456789") / n, count(".,") / n, n / (1 + t.count("\n")),
        )
        want.append((-1 if row[0] is None else row[0], *map(float, stats)))
    got = [(-1 if r[0] is None else r[0], *r[2:]) for r in out]
    assert np.allclose(sorted(got), sorted(want), rtol=0, atol=1e-6)


def test_rule_quality_edges(spark, docs, table, empty, judged):
    some, labels, _ = judged
    model = rule_quality.train(some, labels)
    out = rule_quality.score_quality(docs, model)
    assert set(docs.columns) < set(out.columns) and out.count() == len(table)
    assert all(0 <= r["__score"] <= 1 for r in out.collect())
    assert rule_quality.score_quality(empty, model).count() == 0
    clash = docs.selectExpr("*", "1 AS s_words", "2 AS __text", "3 AS __n", "4 AS __words", "5 AS __letters")
    back = rule_quality.score_quality(clash, model)
    assert back.columns == [*clash.columns, "__score", "__predicted"] and {tuple(r[-7:-2]) for r in back.collect()} == {(1, 2, 3, 4, 5)}
    none = rule_quality.train(docs, labels.where("quality > 5"))
    assert none.rules == () and {r["__score"] for r in rule_quality.score_quality(docs, none).collect()} == {0.5}
    nulls = spark.createDataFrame([(None, 1, 0), (3, None, 0), (4, 1, 1)], labels.schema)
    assert rule_quality.train(docs, nulls).rules == ()


def test_pipeline_stages(spark, docs, table, empty, judged, tmp_path):
    import corpus_pipeline

    judged[1].write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    current = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage-{k}"))
        current = spark.read.parquet(str(tmp_path / f"stage-{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert current.columns == docs.columns, name
    assert current.count() == corpus_pipeline.run(spark, str(tmp_path)).count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    ids = Counter(r["doc_id"] for r in kept.collect())
    # One row of each class of texts stays, by brute force over texts; texts without words all stay.
    texts = sorted({r[1] or "" for r in table})
    linked, group = brute_links(texts), {}
    for i, t in enumerate(texts):
        group[t] = next((group[u] for j, u in enumerate(texts[:i]) if linked[i][j]), t)
    wordy = [t for t in texts if WORD.search(t)]
    assert Counter(group[r["text"]] for r in kept.where("text is not null").collect() if WORD.search(r["text"])) == Counter({group[t]: 1 for t in wordy})
    assert sum(n for d, n in ids.items()) == len({group[t] for t in wordy}) + sum(not WORD.search(r[1] or "") for r in table)
    shutil.rmtree(tmp_path)
