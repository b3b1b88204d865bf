"""Token ids: the SentencePiece transducer and the shard index against the libraries."""

import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from riskloom.llm import common, queries, sentencepiece_fst, token_index

SF = "/root/testdata/sf0.001"
PARTS = [*"aabbTHeino .,,!?\n\t▁éßñ中한 😀½'st\"(){};:=0123|*<>İΣſ#$", "  ", "   ", "ing", "tion", "'s", "<|endoftext|>", "é.", "\x1c"]
AWKWARD = ["", " ", "a" * 3000, " " * 100 + "x" + " " * 77, "ab" * 2000, "\n\n\n", "x" + "▁" * 40, "²." * 10]


def random_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randrange(40))) for _ in range(n)] + AWKWARD


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_transducer_gives_the_librarys_ids(spark, frame, model):
    texts = random_texts(3000)
    rows = sentencepiece_fst.encode(frame([*enumerate(texts), (0, texts[0]), (None, None)])).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = texts[r["doc_id"]] if r["doc_id"] is not None else ""
        assert r["ids"] == model.encode(text) and r["n_ids"] == len(r["ids"]) and r["round_trip"]


def test_small_cache_gives_the_same(spark, frame, model):
    texts = random_texts(300, seed=8)
    rows = sentencepiece_fst.encode(frame(list(enumerate(texts))), cache_size=5).collect()
    assert all(r["ids"] == model.encode(texts[r["doc_id"]]) for r in rows)


def test_a_task_holds_few_texts_at_a_time(frame, monkeypatch):
    docs, tasks = frame([(1, "x")]), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: tasks.append(run))
    sentencepiece_fst.encode(docs)
    text = "ein langer Text " * 300
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "text": [text] * 3000})
    tracemalloc.start()
    try:
        n = sum(out.num_rows for out in tasks[0](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 3000 and peak < 10 * 256 * len(text)  # all texts at once are 3000 * len(text)


def test_few_remembered_pairs_give_the_same(model):
    machine, texts = sentencepiece_fst.Transducer.load(public_tokenizers.path("piece_bpe_32k.model"), most_pairs=20), random_texts(200, seed=11)
    for text in texts:
        chunks = sentencepiece_fst.cutter("▁", machine.marks).findall(("▁" + text).replace(" ", "▁")) if text else []
        assert np.frombuffer(b"".join(machine.encode_chunks(chunks)), "<i4").tolist() == model.encode(text) and len(machine.apart) <= 20


def test_the_pipeline_sends_texts_to_python_in_small_batches(spark, frame):
    def sizes(batches):
        yield pa.RecordBatch.from_pydict({"n": [b.num_rows for b in batches]})

    held = frame([(i, "x" * 10_000) for i in range(1500)]).coalesce(1)
    try:
        corpus_pipeline.encode(spark, frame([(1, "x")]), "")
        got = [r["n"] for r in held.mapInArrow(sizes, "n bigint").collect()]
        assert sum(got) == 1500 and max(got) * 10_000 < 3 << 20  # 15 MB at once by default
        spark.conf.set(common.ARROW_BYTES, "64m")
        corpus_pipeline.encode(spark, frame([(1, "x")]), "")
        assert [r["n"] for r in held.mapInArrow(sizes, "n bigint").collect()] == [1500]  # what the session names stays
    finally:
        spark.conf.unset(common.ARROW_BYTES)


def test_every_finite_path_is_the_only_one():
    machine = sentencepiece_fst.Transducer.load(public_tokenizers.path("piece_bpe_32k.model"))

    def paths(text, last=""):
        if not text:
            return [[]]
        return [[text[:k], *rest] for k in range(1, len(text) + 1) if (k == 1 or text[:k] in machine.pieces) and machine.stand_apart(last, text[:k])
                for rest in paths(text[k:], text[:k])]

    rng = random.Random(1)
    for _ in range(150):
        text = "▁" + "".join(rng.choices("aeinrstth", k=rng.randrange(1, 9)))
        assert paths(text) == [machine.merged(text)] == [machine.shortest_path(text)]


def test_sentencepiece_query_on_whole_table(spark, model):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op7_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts)
    assert all(r["ids"] == model.encode(texts[r["doc_id"]]) and model.decode(r["ids"]) == texts[r["doc_id"]] for r in rows)


def expected(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = [], 0
    for i, text in sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


def test_shards_hold_the_librarys_ids_in_order(spark, frame, tmp_path):
    rows = [*((i * 7 - 500, t) for i, t in enumerate(random_texts(1500))), (4, None), (4, None), (None, "x"), (None, "a y"), (2 ** 62, "z"), (3, "twice"), (3, "again")]
    got = told(token_index.encode_and_read(frame(rows), path=str(tmp_path / "ids")))
    assert got == expected(rows)
    assert sorted(p.name[-4:] for p in (tmp_path / "ids").iterdir()) == [".ids"] * len(list((tmp_path / "ids").iterdir()))


def test_token_query_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert told(queries.op4_token_index(spark, SF)) == expected(rows)


def test_look_up_tells_unknown_keys(spark, frame, tmp_path):
    rows = token_index.write_shards(frame([(i, f"text {i}") for i in range(500)]), str(tmp_path / "ids"))
    index, buckets = token_index.build_index(rows, bucket_keys=40)
    found = token_index.look_up(spark.range(0, 20000, 25).selectExpr("id AS key"), index, buckets).collect()
    assert sorted(r["key"] for r in found) == list(range(0, 500, 25)) and buckets == 13


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(np.random.default_rng(n).integers(-2 ** 62, 2 ** 62, n))
        assert (np.sort(token_index.PerfectHash(keys).slots(keys)) == np.arange(len(keys))).all()


def test_no_documents(spark, frame, tmp_path):
    assert told(token_index.encode_and_read(frame([]), path=str(tmp_path / "ids"))) == []
    assert sentencepiece_fst.encode(frame([])).count() == 0
