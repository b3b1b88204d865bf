"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import scratch_path

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: str = "2m") -> None:
    """Rows go to Python in batches of about ``size`` from now on, unless the session names its own.

    An executor and its Python workers hold several copies of a batch, and seldom give the memory back: by default one has
    up to 10,000 texts, whatever their length up to 64 MB.
    """
    if ARROW_BYTES not in spark.conf.getAll:
        spark.conf.set(ARROW_BYTES, size)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator works on; a null text counts as the empty text."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its size is known, and no lost executor makes it run anew."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``: the fold of a row."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, max_rows: int) -> DataFrame:
    """Texts with a 0/1 ``label``, at most ``max_rows`` of those whose labels row fulfils ``train``.

    Rows are drawn by a hash of the id, so a run repeats itself. An id labelled twice takes its larger label. The drawn
    ids are at most ``max_rows``, which bounds what the join may broadcast.
    """
    ids = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train)
           .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    drawn = staged(ids, "drawn")
    return texts(docs).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "label")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scanned(items: Column, start: Column, item_type: str, step: Callable[[Column, Column], tuple[Column, Column, Column]], block: int = 256) -> Column:
    """The results of a walk over an array: ``step(at, x)`` gives the next ``at``, whether x has a result, and that result.

    Results are gathered by blocks, since what a walk carries is copied at each step: the work is a block's size for each
    item, and the items once for each block.
    """
    none = F.array().cast(f"array<{item_type}>")

    def inner(acc: Column, x: Column) -> Column:
        at, has, result = step(acc["at"], x)
        more = F.when(has, F.concat(acc["out"], F.array(result.cast(item_type)))).otherwise(acc["out"])
        return F.struct(at.alias("at"), more.alias("out"))

    def outer(all_items: Column) -> Callable[[Column, Column], Column]:
        def walk(acc: Column, b: Column) -> Column:
            part = F.aggregate(F.slice(all_items, b * block + 1, F.lit(block)), F.struct(acc["at"].alias("at"), none.alias("out")), inner)
            return bound(part, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["done"], F.array(p["out"])).alias("done")))

        return walk

    begin = F.struct(start.alias("at"), F.array().cast(f"array<array<{item_type}>>").alias("done"))
    return bound(items, lambda xs: F.aggregate(
        F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>")),
        begin, outer(xs), lambda a: F.flatten(a["done"])))


def stretches(text: Column, spans: Column, few: int = 512) -> Column:
    """The text of each span (start, end) in code points. Of many spans, each is looked up in one of at most ``few`` blocks of the text."""
    def plain(t: Column) -> Column:
        return F.transform(spans, lambda s: F.substring(t, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

    def by_block(t: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.length(t) / few).cast("int"))

        def cut(b: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.lit(few - 1)), lambda i: F.substring(t, i * b + 1, b))

            def one(s: Column, held: Column) -> Column:
                first, last = F.floor(s["start"] / b).cast("int"), F.floor(F.greatest(s["start"], s["end"] - 1) / b).cast("int")
                near = F.array_join(F.slice(held, first + 1, last - first + 1), "")
                return F.substring(near, (s["start"] - first * b + 1).cast("int"), (s["end"] - s["start"]).cast("int"))

            return bound(blocks, lambda held: F.transform(spans, lambda s: one(s, held)))

        return bound(size, cut)

    return F.when(F.size(spans) <= few, plain(text)).otherwise(by_block(text))


def bit_places(key: Column, bits: int) -> dict[str, Column]:
    """Where a key has its bit in a table of ``bits``: cell of 4,096 bits, word of 64 in the cell, bit in the word."""
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    return {"__cell": F.shiftright(slot, 12).cast("int"), "__word": F.shiftright(slot, 6).bitwiseAND(F.lit(63)).cast("int"),
            "__bit": slot.bitwiseAND(F.lit(63)).cast("int")}


def may_be_among(df: DataFrame, key: str, keys: DataFrame, bits: int = 1 << 26) -> DataFrame:
    """``df`` with ``__among``: false only where ``key`` is none of ``keys``, a frame with a column of the same name.

    A table of one bit for each hash goes to all tasks: at 2**26 bits less than 13 MB, however many keys there are. So what surely
    has no partner need not be shuffled; with more keys than bits it lets everything through.
    """
    words = keys.select(*[c.alias(n) for n, c in bit_places(F.col(key), bits).items()]).groupBy("__cell", "__word").agg(
        F.expr("bit_or(shiftleft(1L, __bit))").alias("__held"))
    cells = words.groupBy("__cell").agg(F.map_from_entries(F.collect_list(F.struct("__word", "__held"))).alias("__words"))
    marked = df.withColumns(bit_places(F.col(key), bits)).join(F.broadcast(cells), "__cell", "left")
    among = F.coalesce(F.expr("getbit(try_element_at(__words, __word), __bit) = 1"), F.lit(False))
    return marked.withColumn("__among", among).drop("__cell", "__word", "__bit", "__words")


def pieces_of(values: list[str], max_chars: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts that hold about ``max_chars`` characters together; a longer text stands alone."""
    start, held = 0, 0
    for i, v in enumerate(values):
        if held and held + len(v) > max_chars:
            yield start, i
            start, held = i, 0
        held += len(v)
    if start < len(values):
        yield start, len(values)
