"""Near-duplicates, classifiers and the pipeline on small and whole tables."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_near_copies import kept_by_all_pairs

import corpus_pipeline
from riskloom.llm import decontaminate, quality, queries, secrets, simhash, toxicity
from riskloom.llm.components import connected_components

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.1"
WORDS = [f"w{i}" for i in range(60)] + ["É", "ĳ", "İ"]


def near_texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out).split(" ")
            w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choices(WORDS, k=rng.randrange(1, 120))))
    return out


def test_fingerprints():
    for t in ["", " \t\n", "one", "One two", "A b c d", "É e f g h", "x " * 40, *near_texts(1, 30)]:
        assert simhash.fingerprint(t) & (2 ** 64 - 1) == brute.fingerprint(t)


@pytest.mark.parametrize("pair_limit", [1, 3, 64])
def test_components_are_those_of_all_pairs(spark, frame, pair_limit):
    rows = [*((i * 3 % 400, t) for i, t in enumerate(near_texts(pair_limit, 250))), (900, None), (901, ""), (901, ""), (902, " ")]
    got = simhash.near_duplicates(frame(rows), pair_limit=pair_limit).collect()
    prints = [(i, brute.fingerprint(t)) for i, t in rows]
    want = {(i, p, c) for (i, p), c in zip(prints, brute.components(prints))}
    assert len(got) == len(rows) and {(r["doc_id"], r["fp"] & (2 ** 64 - 1), r["component_id"]) for r in got} == want


def test_near_duplicate_query_on_whole_table(spark):
    rows = queries.op5_simhash(spark, SF).collect()
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r["doc_id"], brute.fingerprint(r["text"])) for r in texts]
    want = {(i, f"{p:016x}", c) for (i, p), c in zip(prints, brute.components(prints))}
    assert {tuple(r) for r in rows} == want and len(rows) == len(texts)


def test_thresholds_follow_the_pigeonhole_principle():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (500, 64)).astype(float)
    bits[:, 1] = bits[:, 0]
    both = bits.T @ bits
    for n, radius in ((500, 2), (500, 1), (10 ** 9, 2), (0, 2)):
        groups, ts = simhash.allocate(n, both * (n / 500), radius) if n else simhash.allocate(0, both * 0, radius)
        assert sorted(b for g in groups for b in g) == list(range(64)) and sum(t + 1 for t in ts) == radius + 1
        masks = simhash.probe_masks(groups, ts)
        for _ in range(100):
            flips = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(not m & flips for m in masks)
    few, many = simhash.allocate(500, both, 2), simhash.allocate(10 ** 9, both * 2e6, 2)
    assert max(many[1]) >= max(few[1])       # more rows, more probes for fewer candidates
    assert any({0, 1} <= set(g) for g in simhash.group_bits(500, both, 4))


def test_long_chain_is_one_component(spark):
    links = spark.range(0, 200).selectExpr("id AS u", "id + 1 AS v").union(spark.createDataFrame([(900, 901), (901, 901)], "u bigint, v bigint"))
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900} and connected_components(links.limit(0)).count() == 0


def test_one_of_each_group_stays(spark, frame):
    text = " ".join(f"t{i}" for i in range(50))
    docs = frame([(5, text), (3, text), (3, text), (8, "other words here now"), (None, "some"), (None, text)])
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns and sorted(str(r["doc_id"]) for r in got.collect()) == ["3", "8", "None"]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_classifiers_take_awkward_rows(spark, frame):
    good = [(i, f"some plain words {i} with a calm end. and more of them\nline {i}") for i in range(0, 120)]
    bad = [(i, f"BUY!! NOW!! {i} $$$ idiot{i} !!") for i in range(120, 240)]
    docs = frame([*good, *bad, (500, None), (501, ""), (None, "a"), (3, good[3][1]), (502, "x" * 50000)])
    labels = labels_of(spark, [*((i, 1, 0) for i, _ in good), *((i, 0, 1) for i, _ in bad), (1, 0, None), (2, None, 1), (None, 1, 1), (777, 1, 0)])
    for rows, label in ((quality.classify(docs, labels), "good"), (toxicity.classify(docs, labels), "bad")):
        got = rows.collect()
        assert len(got) == 245 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
        right = [r["predicted"] == int((r["doc_id"] < 120) == (label == "good")) for r in got if r["doc_id"] is not None and r["doc_id"] < 240]
        assert sum(right) / len(right) > 0.95
    for none in (labels.limit(0), labels.filter("quality = 1 AND toxic = 0")):
        assert quality.classify(docs, none).filter("predicted = 0").count() == 0
        assert {r["score"] for r in toxicity.classify(docs, none).select("score").collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0 and toxicity.classify(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


@pytest.mark.parametrize("name, label, recall, false", [("op10_quality", "quality", 0.98, 0.1), ("op6_toxicity", "toxic", 0.8, 0.05)])
def test_held_out_accuracy(spark, name, label, recall, false):
    rows = queries.queries()[name](spark, LARGER).filter("held_out").join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").select(
        F.col(label).alias("y"), "predicted").collect()
    assert np.mean([r["predicted"] for r in rows if r["y"]]) >= recall and np.mean([r["predicted"] for r in rows if not r["y"]]) <= false


def test_forest_walk_is_the_plain_one():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    forest = quality.grow(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=12, depth=3)
    for row, score in zip(x[:50], forest.score(x[:50])):
        total = forest.base
        for t in range(12):
            at = 0
            while forest.left[t, at] != at:
                at = forest.left[t, at] if row[forest.feature[t, at]] <= forest.threshold[t, at] else forest.right[t, at]
            total += forest.value[t, at]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((forest.score(x) > 0.5) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.85


def test_kernel_is_the_plain_one_and_takes_insertions():
    def plain(a, b):
        def grams(w):
            w, out = "^" + w, {}
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                        g = w[i] + w[j] + w[k]
                        out[g] = out.get(g, 0) + toxicity.DECAY ** (k - i + 1)
            return out
        x, y = grams(a), grams(b)
        size = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
        return sum(v * y.get(g, 0) for g, v in x.items()) / size if size else 0.0

    words = ["idiot", "id.iot", "i-d-i-o-t", "river", "abababab", "x", "xy", ""]
    got = toxicity.kernel(words, words)
    assert np.allclose(got, [[plain(a, b) for b in words] for a in words])
    assert got[0, 1] > 0.5 and got[0, 2] > 2 * got[0, 3] and "idiot" in toxicity.units("you i d i o t there")


def test_pipeline_stages_on_their_own_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [decontaminate.plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans",
                                                      "SentencePiece encoding and decoding"]
    kept = docs
    for (name, stage), check in zip(corpus_pipeline.STAGES, ("quality", "copies", "leaks", "secrets", "ids")):
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = stage(spark, kept, SF)
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        rows = kept.collect()
        if check != "ids":
            assert kept.columns == docs.columns
            after = {r["doc_id"]: r["text"] for r in rows}
            assert len(after) == len(rows)
        if check == "quality":
            scores = {r["doc_id"]: r["predicted"] for r in queries.op10_quality(spark, SF).collect()}
            assert set(after) == {i for i, p in scores.items() if p}
        elif check == "copies":
            assert set(after) == kept_by_all_pairs(list(before.items()))
        elif check == "leaks":
            gone = set(before) - set(after)
            assert {i for i, t in before.items() if any(b in decontaminate.plain(t) for b in bench)} <= gone
            assert all(any(brute.least_edits(b, decontaminate.plain(before[i])) <= len(b) * 0.08 for b in bench) for i in gone)
        elif check == "secrets":
            assert set(after) == set(before)
            for r in rows:
                assert not brute.secrets(r["text"]) and r["n_chars"] == len(r["text"])
                assert r["text"] == before[r["doc_id"]] or "[secret]" in r["text"]
        else:
            assert {r["doc_id"] for r in rows} == set(before) and all(r["round_trip"] for r in rows)
    empty = docs.limit(0)
    assert all(stage(spark, empty, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)
