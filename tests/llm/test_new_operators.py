"""Collocations, exact copies and hard negatives against plain versions on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import collocations, exact_dedup, hard_negatives


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def groups_by_hand(rows):
    texts = defaultdict(list)
    for i, t in rows:
        texts[normal(t)].append(i)
    out = Counter()
    for t, ids in texts.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        first = True
        for i in ids:
            stays = first and i == keep
            first = first and not stays
            out[i, keep, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


COPIES = [(5, "a  b"), (3, "a\tb"), (9, "a\n\x0b\r b"), (3, "a b"), (4, "a b "), (None, "a b"), (None, "only here"), (None, "only\nhere"), (7, None), (8, ""),
          (8, "other"), (11, " "), (12, "x" * 200_000), (13, "x" * 200_000), (14, "é"), (15, "é"), (16, "a b"), *((i, "hot") for i in range(100, 400))]


@pytest.mark.parametrize("bits", [None, 1, 0])
def test_copies_are_those_of_the_texts(spark, frame, bits):
    """With a hash of one bit or none most groups mix texts, and bytes decide."""
    weak = {} if bits is None else {"digest": lambda t: F.pmod(F.xxhash64(t), F.lit(2 ** bits)), "bits": 4096 * 2 ** bits}
    got = exact_dedup.duplicate_groups(frame(COPIES), **weak)
    assert Counter(tuple(r) for r in got.collect()) == groups_by_hand(COPIES)


def test_one_of_the_copies_stays(spark, frame):
    docs = frame(COPIES)
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    want = Counter((k[0], k[4]) for k, n in groups_by_hand(COPIES).items() for _ in range(n) if k[3])
    assert Counter((r["doc_id"], hashlib.sha256(normal(r["text"]).encode()).hexdigest()) for r in got.collect()) == want
    assert exact_dedup.duplicate_groups(docs.limit(0)).count() == 0 and exact_dedup.drop_copies(docs.limit(0)).count() == 0


def phrases_by_hand(rows, top, depth, least):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, depth + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        longer = [b for (x, q), b in f.items() if x == lang and len(q) > len(p) and b >= least and any(q[i:i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 50 * a for b in longer):
            continue
        score, _, l, r = min((10 ** 6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, ps in out.items() for i, (s, a, p, l, r) in enumerate(sorted(ps)[:top])}


def awkward_texts():
    rng = random.Random(11)
    words = ["the", "The", "ÄB", "äb", "new", "york", "city", "a", "b", " ", "ß-x", "e'f"]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\r", "?"]) for _ in range(rng.randrange(1, 60))))
            for _ in range(120)]
    return rows + [("en", None), ("en", ""), (None, " \t.,"), ("en", "new york city " * 3000), ("fr", "un deux trois"), rows[0], rows[0]]


@pytest.mark.parametrize("settings", [{}, {"shard_words": 150}, {"bits": 64}, {"depth": 4, "shard_words": 500}, {"top": 7, "depth": 2}])
def test_phrases_are_those_of_a_count(spark, settings):
    """Whatever the shards and however full the table of frequent phrases."""
    rows = awkward_texts()
    docs = spark.createDataFrame([(i, t, lang, "x", "y") for i, (lang, t) in enumerate(rows)],
                                 "doc_id bigint, text string, lang string, phrase string, n string").repartition(3)
    got = collocations.collocations(docs, **{"bits": 1 << 12} | settings).collect()
    want = phrases_by_hand(rows, settings.get("top", 2000), settings.get("depth", 3), 10)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 20


def test_no_phrases(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], "doc_id bigint, text string, lang string")
    assert collocations.collocations(docs, bits=64).count() == 0 and collocations.collocations(docs.limit(0), bits=64).count() == 0


def test_intervals_are_those_of_sorted_positions():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 6, 400).astype(np.int32)
    index = collocations.Index(text, 6, 4)
    p = index.words()
    for grow in (index.extend_left, index.extend_right, index.extend_left):
        p = grow(p)
        k = p.words.shape[1]
        held = Counter(tuple(map(int, text[i:i + k])) for i in range(len(text) - k + 1) if 0 not in text[i:i + k])
        got = dict(zip(map(tuple, p.words.tolist()), p.count.tolist()))
        around = Counter(tuple(map(int, np.roll(text, -i)[:k])) for i in range(len(text) - k + 1, len(text)))
        assert {w: n - around[w] for w, n in got.items() if n > around[w]} == held
        both = np.r_[text, text]
        order = sorted(range(len(text)), key=lambda i: tuple(both[i:i + 4]))
        back = text[::-1]
        twice = np.r_[back, back]
        mirrored = sorted(range(len(text)), key=lambda i: tuple(twice[i:i + 4]))
        for w, lo, rlo, n in zip(p.words.tolist(), p.low, p.reverse_low, p.count):
            assert all(both[order[i]:order[i] + k].tolist() == w for i in range(lo, lo + n))
            assert all(twice[mirrored[i]:mirrored[i] + k].tolist() == w[::-1] for i in range(rlo, rlo + n))


def negatives_by_hand(rows, every):
    ok = {(i, lab, tuple(floor(256 * x) for x in v)) for i, lab, v in rows
          if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = Counter()
    for i, lab, v in ok:
        if i % every:
            continue
        near = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in ok if len(w) == len(v)]
        for s, j in sorted((s, j) for s, j, other in near if other == lab and j != i)[:5]:
            fits = sorted((t, k) for t, k, other in near if other != lab and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out.update((i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fits))
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, lab, v, "x", "y") for i, lab, v in rows],
                                 "vec_id bigint, label int, embedding array<double>, anchor string, shard string")


@pytest.mark.parametrize("settings", [{}, {"shard_rows": 60, "block_anchors": 4}])
def test_negatives_are_those_of_all_pairs(spark, settings):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(8, 6))
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in centres[rng.integers(0, 8)] * rng.uniform(0.2, 3) + 0.1 * rng.normal(size=6)]) for i in range(500)]
    rows += [(i, i % 2, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(500, 620)]                       # ties, also at the bounds
    rows += [(i, 1, [0.95 * x for x in (1.0, 2.0, 3.0, 4.0, 5.0, 6.0)]) for i in range(620, 630)]
    rows += [(700, None, [1.0] * 6), (710, 1, None), (720, 1, []), (730, 1, [1.0, None] * 3), (740, 1, [float("nan")] * 6), (750, 1, [float("inf")] * 6), (None, 1, [1.0] * 6),
             (760, 1, [0.0] * 6), (770, 2, [0.001] * 6), (780, 1, [-1.0] * 6), (790, 1, [1.0, 2.0]), (791, 1, [2.0, 2.0]), (792, 2, [1.5, 1.0]), (800, 9, [1.0] * 6), rows[10], rows[20]]
    got = hard_negatives.mine(vectors(spark, rows), every=10, **settings).collect()
    want = negatives_by_hand(rows, 10)
    assert Counter(tuple(r) for r in got) == want and len(want) > 300
    none = vectors(spark, rows).limit(0)
    assert hard_negatives.mine(none).count() == 0 and hard_negatives.mine(vectors(spark, rows[1:10])).count() == 0


def test_scores_beyond_doubles_stay_exact(spark):
    big = 2.0 ** 22
    rows = [(0, 1, [big, big, 1.0]), *((i, 1, [big, big, float(i)]) for i in range(1, 9)), *((i, 2, [big * 0.9, big * 0.9, float(i % 5)]) for i in range(10, 30))]
    assert Counter(tuple(r) for r in hard_negatives.mine(vectors(spark, rows)).collect()) == negatives_by_hand(rows, 50)


def test_clustered_vectors_are_pruned():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    values = np.floor(256 * (centres[rng.integers(0, 40, 8000)] + 0.03 * rng.normal(size=(8000, 16))))
    shard, best = hard_negatives.Shard(values), hard_negatives.Best(np.full(100, -np.inf), 5)
    for a, r, s in shard.pairs(values[:100], lambda: best.need):
        fits = s >= best.need[a]
        best.add(a[fits], s[fits], r[fits])
    assert shard.verified < 0.6 * 100 * 8000
    every = (values[:100] @ values.T).astype(int)
    assert all(sorted(best.score[best.slot == i], reverse=True) == sorted(every[i], reverse=True)[:5] for i in range(100))
