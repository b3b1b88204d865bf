"""Personal data: entities of fixed form, and identifiers found by bootstrapped contexts.

Entities of fixed form are the seeds. The words beside them are lexical patterns; Spark scores the graph of patterns and
instances in rounds, and identifier-like tokens that patterns of high confidence surround are reported too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import staged, texts

KINDS = ("email", "ip", "card", "phone")
# Forms of the seed kinds. A run of digits is entered at its first digit only, where a match would begin.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[^0-9]+")
_EDGE = ".,;:!?()[]{}<>\"'"
_EDGES = f"[{re.escape(_EDGE)}]*+"
#: A token with a digit or an at sign may be an identifier, and so may neighbouring groups of up to four digits with single spaces between
#: them; longer groups are tokens of their own.
_TOKEN = re.compile(rf"(?<!\S)(?:{_EDGES}[0-9]{{1,4}}(?:\x20[0-9]{{1,4}})+(?={_EDGES}(?!\S))|[^\s0-9@]*+[0-9@]\S*)")
#: Characters beside a span in which its neighbouring word is looked for.
_NEAR = 64

Span = tuple[int, int, int]  # start, rank of kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: every one holds one at sign, and begins as far left of it as it may."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            last = end.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def seeds(text: str) -> list[Span]:
    """Spans of the seed kinds by start, then by kind as listed; matches that fail a kind's test are dropped."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0]) if len(m[0]) >= 14 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def beside(text: str, start: int, end: int) -> tuple[str, str]:
    """The words before and after a span, in lower case without punctuation at their edges or between them and the span."""
    left = text[max(0, start - _NEAR):start].lower().rstrip(_EDGE + " \t\n").split()
    right = text[end:end + _NEAR].lower().lstrip(_EDGE + " \t\n").split()
    return (left[-1].strip(_EDGE) if left else ""), (right[0].strip(_EDGE) if right else "")


def mentions(text: str, known: list[Span]) -> Iterator[tuple[int, int, str, str, str, str]]:
    """(start, end, kind or empty, value, left word, right word) of seeds and of other identifier-like tokens."""
    for s, k, e in known:
        yield s, e, KINDS[k], text[s:e], *beside(text, s, e)
    i, taken = 0, 0
    for m in _TOKEN.finditer(text):
        s, e = m.span()
        while i < len(known) and known[i][0] < e:
            taken, i = max(taken, known[i][2]), i + 1
        if s < taken:
            continue
        while s < e and text[s] in _EDGE:
            s += 1
        while e > s and text[e - 1] in _EDGE:
            e -= 1
        if e - s >= 5:
            yield s, e, "", text[s:e], *beside(text, s, e)


_SPAN = "struct<start:int,rank:int,end:int,kind:string>"
_MENTION = "struct<start:int,end:int,kind:string,value:string,left:string,right:string>"


def found_seeds(docs: DataFrame) -> DataFrame:
    """doc_id, body (a hash of the text), base spans and mentions of every row, and a number ``deal`` that spreads rows; the text
    itself is read once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = 0
        for b in batches:
            base, seen = [], []
            for t in b["text"]:
                known = seeds(t)
                base.append([{"start": s, "rank": k, "end": e, "kind": KINDS[k]} for s, k, e in known])
                seen.append([dict(zip(("start", "end", "kind", "value", "left", "right"), m)) for m in mentions(t, known)])
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "body": b["body"], "base": base, "mentions": seen, "deal": range(rows, rows + len(b))})
            rows += len(b)

    keyed = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("body"), "text")
    return keyed.mapInPandas(run, f"doc_id bigint, body bigint, base array<{_SPAN}>, mentions array<{_MENTION}>, deal bigint")


def score_graph(all_mentions: DataFrame, rounds: int = 3, least_seeds: int = 5, sure: float = 0.8) -> DataFrame:
    """(instance, kind, score) of identifiers that are no seeds and reach ``sure``.

    A pattern is a word on one side with that side. Its confidence for a kind is the mean score of its distinct instances
    (seeds of the kind score 1, others their last score), for patterns with at least ``least_seeds`` distinct instances of
    the kind that are seeds or sure. An instance takes the noisy-or over its patterns. All steps are grouped sums and joins
    on the pattern or the instance; every round is written.
    """
    m = all_mentions.select(F.xxhash64("value").alias("instance"), "kind", "left", "right")
    edges = staged(m.select("instance", "kind", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), F.col("left").alias("word")), F.struct(F.lit("r").alias("side"), F.col("right").alias("word")))).alias("p"))
        .select("instance", "kind", F.xxhash64("p.side", "p.word").alias("pattern"), F.col("p.word").alias("word"))
        .filter("word != ''").select("instance", "kind", "pattern").distinct(), "edges")
    sizes = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("n"))
    scores = edges.filter("kind != ''").select("instance", "kind", F.lit(1.0).alias("score"), F.lit(True).alias("seed")).distinct()
    links = edges.select("instance", "pattern").distinct()
    for _ in range(rounds):
        sums = links.join(scores, "instance").groupBy("pattern", "kind").agg(
            F.sum("score").alias("s"), F.sum((F.col("score") >= sure).cast("int")).alias("strong"))
        patterns = sums.filter(F.col("strong") >= least_seeds).join(sizes, "pattern").select(
            "pattern", "kind", (F.col("s") / F.col("n")).alias("confidence")).filter("confidence >= 0.05")
        fresh = edges.filter("kind = ''").select("instance", "pattern").join(patterns, "pattern").groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("score"))
        scores = staged(scores.filter("seed").unionByName(fresh.withColumn("seed", F.lit(False))), "scores")
    best = scores.filter(~F.col("seed") & (F.col("score") >= sure)).groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    return best


def find(docs: DataFrame, rounds: int = 3, least_seeds: int = 5, sure: float = 0.8, rows_per_task: int = 10_000) -> DataFrame:
    """doc_id, base spans and all spans (start, rank, end, kind) of every row of ``docs``.

    Discovered spans have the kind ``context_<kind>`` and come after the seed kinds in rank. Null and empty texts have
    none. Repeated rows are kept, also without doc_id; other columns are dropped. Rows without a possible identifier meet no
    join; those of a text that over ``rows_per_task`` rows hold are dealt over several parts.
    """
    seen = staged(found_seeds(docs), "seeds")
    told = seen.select("body", F.explode("mentions").alias("m")).select("body", "m.*")
    new = staged(score_graph(told, rounds, least_seeds, sure), "identifiers")
    spans = told.filter("kind = ''").drop("kind").withColumn("instance", F.xxhash64("value")).join(new, "instance")
    rank = F.lit(len(KINDS)) + F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    span = F.struct("start", rank.cast("int").alias("rank"), "end", F.concat(F.lit("context_"), "kind").alias("kind")).cast(_SPAN)
    more = spans.groupBy("body").agg(F.collect_set(span).alias("more"))  # of one text
    none = F.array().cast(f"array<{_SPAN}>")
    asked = F.exists("mentions", lambda m: m["kind"] == "")
    few = seen.filter(~asked).select("doc_id", "base", none.alias("more"))
    rows = seen.filter(asked).select("doc_id", "body", "base", "deal")
    hot = rows.groupBy("body").count().filter(F.col("count") > rows_per_task).select("body", F.ceil(F.col("count") / rows_per_task).cast("int").alias("parts"))
    dealt = rows.join(hot, "body", "left").na.fill(1, ["parts"]).withColumn("part", (F.col("deal") % F.col("parts")).cast("int"))
    copied = more.join(hot, "body", "left").na.fill(1, ["parts"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    told_more = dealt.join(copied.select("body", "part", "more"), ["body", "part"], "left").select("doc_id", "base", F.coalesce("more", none).alias("more"))
    return few.unionByName(told_more).select("doc_id", "base", F.array_sort(F.concat("base", "more")).alias("spans"))
