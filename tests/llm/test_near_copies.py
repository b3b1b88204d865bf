"""The pipeline's near-copies are those of all pairs by five-word similarity, and rows go by their own text."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import decontaminate, jaccard, simhash


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def kept_by_all_pairs(rows, similarity=0.8):
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: shingles(t) for i, t in rows}
    for i, j in combinations(sorted(root), 2):
        if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return {top(i) for i in root}


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 9)}"
    return " ".join(words)


def test_near_copies_are_those_of_all_pairs(spark, frame):
    rng = random.Random(5)
    line = " ".join(f"common{i}" for i in range(12))
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(120)) + " " + line for _ in range(60)]
    texts = [*base, *(edited(rng, rng.choice(base[:20]), rng.randrange(1, 7)) for _ in range(120)),
             *(edited(rng, base[0], rng.randrange(1, 4)) for _ in range(150)), "one two", "one two", "", ""]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = kept_by_all_pairs(rows)
    assert 100 < len(want) < 200
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, frame(rows), "").collect()} == want


@pytest.mark.parametrize("pair_limit", [1, 64])
def test_passages_shared_by_most_texts_link_nothing(spark, frame, monkeypatch, pair_limit):
    """A passage that makes up most of many texts brings no pair together, and hubs of buckets lose none."""
    monkeypatch.setattr(jaccard, "COMMON", 4)
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [f"{passage} {' '.join(f'w{rng.randrange(10 ** 6)}' for _ in range(rng.randrange(6, 40)))}" for _ in range(80)]
    texts += [edited(rng, texts[rng.randrange(30)], rng.randrange(1, 6)) for _ in range(60)] + ["a b c", "A  b\tc", "a b"]
    docs = frame(list(enumerate(texts)))
    keyed = docs.select("doc_id", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"))
    plain, similar = simhash.near_copies, jaccard.similar_sets
    monkeypatch.setattr(jaccard, "similar_sets", lambda *given: similar(*given, pair_limit=pair_limit))
    roots = plain(keyed).join(keyed, "text_key").groupBy("root").agg(F.min("doc_id").alias("least"))
    want = kept_by_all_pairs(list(enumerate(texts)))
    assert {r["least"] for r in roots.collect()} == want and 80 <= len(want) < 140


def test_prefixes_meet():
    """The index prefix of the smaller set and the look-up prefix of the larger one share a shingle."""
    rng = np.random.default_rng(3)
    common = np.sort(rng.choice(400, 60, replace=False)).astype(np.int64)
    met = 0
    for _ in range(3000):
        a = rng.choice(400, rng.integers(1, 60), replace=False)
        b = np.union1d(rng.permutation(a)[:rng.integers(0, len(a) + 1)], rng.choice(400, rng.integers(0, 5)))
        a, b = sorted((np.unique(a), np.unique(b)), key=len)
        if jaccard.similarity_of(a, b) >= 0.8 - 1e-12:
            met += 1
            short, long = jaccard.prefix_sizes(len(a), 0.8)[1], jaccard.prefix_sizes(len(b), 0.8)[0]
            assert set(jaccard.ordered_prefix(a, short, common)) & set(jaccard.ordered_prefix(b, long, common))
    assert met > 300


def test_only_copied_rows_go(spark, frame):
    text, other, third = (" ".join(f"{c}{i}" for i in range(50)) for c in "abc")
    docs = frame([(5, text), (3, text), (3, text), (5, other), (3, third), (None, text)])
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"][0]) for r in got.collect()) == [("3", "a"), ("3", "c"), ("5", "b")]


def test_only_rows_with_an_item_go(spark, frame):
    item = "the question asks how many apples remain after the third day of the market"
    docs = frame([(None, f"before {item} after"), (None, "clean text"), (None, None), (4, item), (4, "also clean"), (7, "")])
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = decontaminate.drop_contaminated(docs, bench)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == [
        ("4", "also clean"), ("7", ""), ("None", "None"), ("None", "clean text")]


def family(rng, n, words, edits):
    """Texts made from one by different edits."""
    base = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(words))
    return [edited(rng, base, rng.choice(edits)) for _ in range(n)]


def test_rare_shingles_come_first_in_one_order(spark):
    """Shingles that many near copies share do not come before a copy's own, however many of them are set at the end."""
    rng = random.Random(8)
    made = family(rng, 80, 300, [4, 8])
    texts = spark.createDataFrame([(i.to_bytes(2, "big"), t) for i, t in enumerate(made)], "text_key binary, text string")
    rows = jaccard.described(texts, 0.8, 5).collect()
    assert len(rows) == len({bytes(r["text_key"]) for r in rows}) == 80
    hashes = jaccard.WordHashes()
    sets = {bytes(r["text_key"]): jaccard.shingle_set(made[int.from_bytes(r["text_key"], "big")], 5, hashes) for r in rows}
    number = Counter(t for s in sets.values() for t in s.tolist())
    place = {}
    for r in rows:
        own = {t for t in sets[bytes(r["text_key"])].tolist() if number[t] == 1}
        assert len(r["prefix"]) == jaccard.prefix_sizes(r["n"], 0.8)[0]
        assert len(own) < 10 or {*r["prefix"][:10]} <= own
        place[bytes(r["text_key"])] = {t: k for k, t in enumerate(r["prefix"])}
    for a, b in combinations(place.values(), 2):
        shared = sorted(a.keys() & b.keys(), key=a.get)
        assert shared == sorted(shared, key=b.get)


def test_pairs_do_not_meet_at_each_shared_shingle(spark, frame, monkeypatch):
    """Rows of candidate pairs are about as many as the pairs, and the pairs suffice."""
    rng = random.Random(9)
    made = [t for _ in range(12) for t in family(rng, 8, 250, range(2, 9))]
    docs = frame(list(enumerate(made)))
    seen, alike = [], jaccard.alike
    monkeypatch.setattr(jaccard, "alike", lambda pairs, *more: seen.append((pairs.count(), pairs.distinct().count())) or alike(pairs, *more))
    want = kept_by_all_pairs(list(enumerate(made)))
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == want and 12 < len(want) < 90
    assert len(seen) == 3 and 20 < seen[-1][1] <= seen[-1][0] < 1.5 * seen[-1][1]
