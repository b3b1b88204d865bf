"""Secrets, personal data and benchmark passages against plain versions."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, pii, queries, secrets

SF = "/root/testdata/sf0.01"
HARD = [
    (1, "pässword := \"a=token: abcdefgh1 token=api_key : abcdefgh1 PASSWORD='abcdefgh' AKIAABCDEFGHIJKLMN é AKIA12"),
    (2, "secret=token=12345678901234567890123456789012 " + "ab" * 30), (3, None), (4, ""), (5, "token=" + "x" * 20000), (5, "token=" + "x" * 20000),
    (None, "api-key api_key=abcd.efgh-1 apikey: \"" + "0" * 8 + "\""), (6, "a" * 30000), (7, "AKIAAKIAAKIAAKIA1 AKIAaKIA"), (8, "password = = x"),
    (9, "ghp_" + "x1" * 18 + " xoxb-1234567890-ab -----BEGIN RSA PRIVATE KEY----- AIza" + "z" * 35 + " https://me:pa55@h.example"),
]
PRIVATE = [
    (1, "a.b@c.de, x@y z@@q.w +1 (988) 555-2485. 4539 1488 0343 6467 256.1.1.1 1.2.3.4.5.6.7.8 é 001.2.3.4"), (2, None), (3, ""),
    (4, "9" * 20000), (5, "a" * 20000 + "@x"), (6, "@" * 5000 + "a@b.c@d.e"), (7, "+1" + " " * 5000), (None, "me@here.org"), (8, "1 2 3 4-5-6 7 8 9 0 1 2 3 4 5 6"),
    (8, "1 2 3 4-5-6 7 8 9 0 1 2 3 4 5 6"), (9, "1.2.3." + "9" * 5000),
]


def base_of(spans, kinds):
    return ",".join(s for s in spans.split(",") if s.split(":")[0] in kinds)


def test_secret_query_on_hard_rows(spark, frame):
    rows = secrets.scan(frame(HARD)).select("doc_id", "text", secrets.joined_spans(F.col("found")).alias("s"), "label").collect()
    assert len(rows) == len(HARD)
    for r in rows:
        assert base_of(r["s"], ("assign", "access", "hex")) == brute.secrets(r["text"])
    more = next(r["s"] for r in rows if r["doc_id"] == 9)
    assert [s.split(":")[0] for s in more.split(",")] == ["forge_token", "chat_token", "private_key", "cloud_key", "url_login"]


def test_secret_query_on_whole_table(spark):
    rows = queries.op1_secret_scan(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts) and sum(r["n_assign"] + r["n_access"] for r in rows) > 0
    for r in rows:
        want = brute.secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == brute.digest(want)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [want.count(k + ":") for k in ("assign", "access", "hex")]


def test_trigram_queries_hold_for_every_match():
    samples = {"assign": "API_KEY='abcdefgh", "access": "AKIA" + "B" * 12, "private_key": "-----BEGIN EC PRIVATE KEY-----",
               "web_token": "eyJabcdefgh.eyJabcdefgh.x", "url_login": "ftp://a:bcd@e", "payment_key": "sk_live_" + "1" * 16}
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        assert bool(query) == (rule.kind != "hex")
        if rule.kind in samples:
            low = samples[rule.kind].lower()
            assert all(any(all(t in low for t in s) for s in clause) for clause in query)


def test_rule_without_trigrams_scans_all(spark, frame):
    rules = [secrets.Rule("digits", "[0-9]{4,}"), secrets.Rule("word", "lorem")]
    got = secrets.scan(frame([(1, "x 12345"), (2, "LOREM lorem"), (3, "y")]), rules).select("doc_id", secrets.joined_spans(F.col("found")).alias("s"))
    assert {r["doc_id"]: r["s"] for r in got.collect()} == {1: "digits:2:7", 2: "word:6:11", 3: ""}


def test_redaction_keeps_the_rest(spark, frame):
    got = {r["doc_id"]: r["text"] for r in secrets.redact(frame(HARD[:2] + [(3, None), (4, "")])).collect()}
    assert got[2] == "[secret] [secret]" and got[3] is None and got[4] == "" and "AKIA12" in got[1] and "abcdefgh'" not in got[1]


def test_empty_table(spark, frame):
    empty = frame([])
    assert secrets.scan(empty).count() == 0 and pii.find(empty).count() == 0


@pytest.mark.parametrize("rows", [PRIVATE, [(i, "".join(random.Random(i).choices("01239.@+-() ab", k=60))) for i in range(400)]], ids=["hard", "random"])
def test_personal_data(spark, frame, rows):
    got = pii.find(frame(rows)).select("doc_id", secrets.joined_spans(F.col("base")).alias("b"), secrets.joined_spans(F.col("spans")).alias("s")).collect()
    assert sorted((str(r["doc_id"]), r["b"]) for r in got) == sorted((str(i), brute.personal(t)) for i, t in rows)
    assert all(base_of(r["s"], pii.KINDS) == r["b"] for r in got)


def test_personal_query_on_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op3_personal_data(spark, SF).collect()
    assert len(rows) == len(texts) and sum(r["n_email"] for r in rows) > 0
    assert all(r["base_sha256"] == brute.digest(brute.personal(texts[r["doc_id"]])) for r in rows)


def test_contexts_find_unseen_identifiers(spark, frame):
    told = [(i, f"thing{i} reachme user{i}@mail.example.com thanks and lot{i}9999 plain") for i in range(12)]
    hidden = [(100, "words reachme hidden.user-77(at)mail thanks words"), (101, "words other code-12345 here")]
    got = {r["doc_id"]: r["s"] for r in pii.find(frame(told + hidden)).select("doc_id", secrets.joined_spans(F.col("spans")).alias("s")).collect()}
    assert got[100] == "context_email:14:36" and got[101] == ""


def test_grouped_digits_are_one_identifier(spark, frame):
    told = [(i, f"thing{i} reachme user{i}@mail.example.com thanks") for i in range(12)]
    hidden = [(100, "words reachme 555 123 4567 thanks words"), (101, "reachme (1234 5678 9012). thanks"), (102, "year 2019 12 plain"),
              (103, "reachme 12  34 thanks"), (104, "reachme 12 345678 thanks"), (105, "reachme 4111 1111 1111 1111 thanks")]
    got = {r["doc_id"]: r["s"] for r in pii.find(frame(told + hidden)).select("doc_id", secrets.joined_spans(F.col("spans")).alias("s")).collect()}
    assert {k: v for k, v in got.items() if k >= 100} == {
        100: "context_email:14:26", 101: "context_email:9:23", 102: "", 103: "", 104: "context_email:11:17", 105: "card:8:27"}


def test_copies_of_one_text_are_dealt_over_parts(spark, frame):
    rows = [(i, f"thing{i} reachme user{i}@mail.example.com thanks") for i in range(12)]
    rows += [(None, "words reachme hidden.user-77(at)mail thanks")] * 50 + [(i, "") for i in range(100, 150)] + [(200, "code 12345")] * 7
    got = [sorted(map(str, pii.find(frame(rows), rows_per_task=n).collect())) for n in (3, 10_000)]
    assert got[0] == got[1] and len(got[0]) == len(rows) and sum("context_email" in r for r in got[0]) == 50


def passages(rng, n):
    return ["".join(rng.choice("abcdefghij  ") for _ in range(rng.randrange(30, 120))).strip() or "x" for _ in range(n)]


def test_leaks_are_those_within_the_budget(spark, frame):
    rng = random.Random(5)
    items = [decontaminate.plain(t) for t in passages(rng, 12)]
    docs = []
    for d in range(120):
        body = list(items[d % 12])
        for _ in range(rng.randrange(0, 9)):
            k = rng.randrange(len(body))
            body[k:k + 1] = rng.choice([[], [rng.choice("xyz")], [body[k], "q"]])
        docs.append((d, "".join(rng.choices("abcdefghij ", k=40)) + " " + "".join(body).upper() + "\n\t" + "".join(rng.choices("abcdefghij ", k=40))))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(3, items[3]), (50, None), (51, "ab"), (None, items[0])], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.matches(frame(docs + [(900, None), (901, "")]), bench, q=5, rate=0.12, block_chars=400).collect()}
    want = {}
    for d, t in docs:
        for i, item in enumerate(items):
            edits = brute.least_edits(item, decontaminate.plain(t))
            if len(item) >= 5 and edits <= decontaminate.edit_budget(len(item), 5, 0.12):
                want[d, i] = edits
    assert got == want and 40 < len(want) < 120


def test_leak_query_finds_every_exact_passage(spark):
    docs = [(r["doc_id"], decontaminate.plain(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], decontaminate.plain(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in queries.op2_decontamination(spark, SF).collect()}
    exact = {(d, i) for d, t in docs for i, item in items if item in t}
    assert exact <= set(got) and all(got[k] == 0 for k in exact)
    texts, named = dict(docs), dict(items)
    assert all(brute.least_edits(named[i], texts[d]) == e for (d, i), e in got.items() if e)


def test_contaminated_rows_go(spark, frame):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again")], "item_id bigint, text string")
    docs = frame([(1, "x The quick brown  fox jumps over the lazy dog again"), (2, "clean"), (2, "clean"), (None, "clean"), (3, None)])
    got = decontaminate.drop_contaminated(docs, bench)
    assert got.columns == docs.columns and sorted(str(r["doc_id"]) for r in got.collect()) == ["2", "2", "3", "None"]
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_a_text_of_many_secrets(spark, frame):
    """More hits than a block of either walk, some inside each other, in a text of wide characters."""
    many = " é𝄞 ".join(f"token={'ab12cd34' * 4}{i:04d}" if i % 3 else f"AKIA{i:016d}" for i in range(1500))
    docs = frame([(1, many), (2, many * 2), (3, "x" * 300_000 + " token=abcdefgh1"), (4, None)])
    rows = {r["doc_id"]: r for r in secrets.scan(docs).select("doc_id", "text", secrets.joined_spans(F.filter("found", lambda x: x["rank"] < secrets.BASE)).alias("spans")).collect()}
    assert all(rows[i]["spans"] == brute.secrets(rows[i]["text"]) for i in rows) and rows[2]["spans"].count(":") > 6000
    for r in secrets.redact(docs).collect():
        text, at, out = rows[r["doc_id"]]["text"], 0, []
        for s in secrets_of(spark, frame, text):
            if s["start"] >= at:
                out += [text[at:s["start"]], "[secret]"]
            at = max(at, s["end"])
        assert r["text"] == (None if text is None else "".join(out) + text[at:])


def secrets_of(spark, frame, text):
    return secrets.scan(frame([(1, text)])).first()["found"]
