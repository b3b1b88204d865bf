"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression yields a Boolean trigram query: a conjunction of alternatives, each the trigrams of one
mandatory string. Postings of the trigrams that the rules ask for are gathered by segment of documents, the queries are
answered by intersecting and uniting postings, and a rule's expression runs over the whole text of its candidates alone.
A rule without a mandatory trigram scans every text.
"""

from __future__ import annotations

import re._constants as K
import re._parser as parser
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import bound, scanned, staged, stretches

#: Strings that one mandatory piece of an expression may stand for before it is cut.
MOST_STRINGS = 16


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern`` finds leftmost non-overlapping matches; those whose ``group`` is shorter than
    ``shortest`` are dropped. Base kinds come first, in their listed order."""

    kind: str
    pattern: str
    group: int = 0
    shortest: int = 0


# The first three patterns and lengths are given.
RULES = (
    Rule("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    Rule("payment_key", r"sk_live_[A-Za-z0-9]{16,}", 0, 24),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
    Rule("url_login", r"[a-z][a-z0-9+.-]{0,15}://[A-Za-z0-9._%-]{1,64}:[^\s/@:]{3,128}@[A-Za-z0-9.-]+", 0, 1),
)
BASE = 3

#: AND of (OR of (AND of trigrams)).
Query = tuple[frozenset[frozenset[str]], ...]


def _strings(tree: Sequence) -> set[str] | None:
    """Every string that a piece of an expression can match, in lower case, if there are few."""
    out = {""}
    for op, arg in tree:
        if op is K.LITERAL:
            more = {chr(arg).lower()}
        elif op is K.IN and all(k is K.LITERAL for k, _ in arg):
            more = {chr(v).lower() for _, v in arg}
        elif op is K.BRANCH:
            parts = [_strings(b) for b in arg[1]]
            more = set().union(*parts) if all(p is not None for p in parts) else None
        elif op is K.SUBPATTERN:
            more = _strings(arg[3])
        elif op is K.MAX_REPEAT and arg[1] == 1:
            inner = _strings(arg[2])
            more = inner | {""} if inner is not None else None
        elif op is K.MAX_REPEAT and arg[0] == arg[1] and arg[1] < 32:
            more = _strings(list(arg[2]) * arg[1])
        else:
            more = None
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every match of ``pattern`` fulfils in lower case; empty if there is none."""
    clauses: set[frozenset[frozenset[str]]] = set()

    def close(run: set[str]) -> None:
        if run and all(len(s) >= 3 for s in run):
            clauses.add(frozenset(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run))

    def walk(tree: Sequence) -> None:
        run = {""}
        for node in tree:
            more = _strings([node])
            if more is not None and len(run) * len(more) <= MOST_STRINGS:
                run = {a + b for a, b in product(run, more)}
                continue
            close(run)
            run = more if more is not None else {""}
            if more is None:
                op, arg = node
                if op is K.SUBPATTERN:
                    walk(arg[3])
                elif op is K.MAX_REPEAT and arg[0] >= 1:
                    walk(arg[2])
        close(run)

    walk(list(parser.parse(pattern.replace("(?i)", ""))))
    return tuple(sorted(clauses, key=lambda c: sorted(map(sorted, c))))


def posting_index(docs: DataFrame, trigrams: Sequence[str], segment_docs: int = 4096) -> DataFrame:
    """(segment, trigram, ids): which documents hold each of ``trigrams``, about ``segment_docs`` documents a segment."""
    segments = max(1, -(-docs.count() // segment_docs))
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    return (docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.lower("text").alias("low"))
            .select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(segments)).alias("segment"), F.explode(held).alias("trigram"))
            .groupBy("segment", "trigram").agg(F.collect_set("doc_id").alias("ids")))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(doc_id, kinds): the documents whose postings fulfil each query. One row per segment holds its asked postings."""
    none = F.array().cast("array<bigint>")
    rows = index.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("of"))

    def ids(t: str) -> Column:
        return F.coalesce(F.element_at("of", F.lit(t)), none)

    def answer(q: Query) -> Column:
        unions = [reduce(F.array_union, [reduce(F.array_intersect, [ids(t) for t in sorted(s)]) for s in sorted(c, key=sorted)]) for c in q]
        return reduce(F.array_intersect, unions)

    def named(kind: str) -> Column:
        return F.transform(answer(queries[kind]), lambda d: F.struct(d.alias("doc_id"), F.lit(kind).alias("kind")))

    pairs = F.concat(*map(named, queries))
    return rows.select(F.explode(pairs).alias("p")).select("p.*").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule, from the lengths of its matches and of the stretches between them (code points)."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(hits))
    steps = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(hits, F.length).alias("hit"),
                         F.transform(kept, F.length).alias("kept"))

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        first, last = at + x["gap"], at + x["gap"] + x["hit"]
        return last, x["kept"] >= rule.shortest, F.struct(first.alias("start"), F.lit(rank).alias("rank"), last.alias("end"), F.lit(rule.kind).alias("kind"))

    return scanned(steps, F.lit(0), "struct<start:int,rank:int,end:int,kind:string>", step)


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, segment_docs: int = 4096, into: str = "found") -> DataFrame:
    """Every row and column of ``docs`` with column ``into``: the spans of all rules by start, then by rule.

    A null text has no spans. Repeated rows each get their own; rows without doc_id are scanned by every rule. A column
    of the name ``into`` is replaced; other columns stay.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    docs = docs.drop(into)
    wanted = sorted({t for q in queries.values() for c in q for s in c for t in s})
    index = staged(posting_index(docs.select("doc_id", "text"), wanted, segment_docs), "postings")
    asked = staged(candidates(index, queries), "candidates").toDF("asked__id", "asked__kinds")
    joined = docs.join(asked, docs["doc_id"] == asked["asked__id"], "left")
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    found = []
    for rank, r in enumerate(rules):
        if r.kind in queries:
            due = F.coalesce(F.array_contains("asked__kinds", r.kind), F.lit(False)) | F.col("doc_id").isNull()
        else:
            due = F.rlike("text", F.lit(r.pattern))
        found.append(F.when(due & F.col("text").isNotNull(), spans_of(F.col("text"), r, rank)).otherwise(empty))
    return joined.select(*[docs[c] for c in docs.columns], F.array_sort(F.concat(*found)).alias(into))


def joined_spans(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, marker: str = "[secret]", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with every span replaced by ``marker`` (overlapping spans by one) and n_chars, if there, brought up to date."""
    spans = "redacted__spans"

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        """Spans that begin inside an earlier one add to it; stretches of the text stay between the others."""
        return F.greatest(at, x["end"]), x["start"] >= at, F.struct(at.alias("start"), x["start"].alias("end"))

    gaps = scanned(F.col(spans), F.lit(0), "struct<start:int,end:int>", step)
    tail = F.substring(F.col("text"), F.array_max(F.transform(spans, lambda x: x["end"])) + 1, F.length("text"))
    clean = F.concat(bound(gaps, lambda g: F.array_join(F.transform(stretches(F.col("text"), g), lambda t: F.concat(t, F.lit(marker))), "")), tail)
    out = scan(docs, rules, into=spans).withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
