"""Exact duplicates: rows grouped by a 128-bit hash of the normalised text, groups split where bytes differ.

Main path in DataFrame functions only. A narrow table (id, hash, digest) decides everything. Texts are compared within the
groups that have more than one row: a bit table of fixed size holds back most other texts where they are read, and copies
meet on the map side, so a group of any size costs one text a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import may_be_among, staged, texts

#: Bits of the table of repeated hashes that goes to all tasks, however many hashes there are.
FILTER_BITS = 1 << 26
# Fixed values of the contract: runs of these characters count as one space.
SPACES = r"[\x20\x09-\x0D]+"
# End of fixed values.


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def content_hash(text: Column) -> Column:
    """The 128 bits of MD5 as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def _best() -> Column:
    """Of a group's rows the one with the smallest doc_id; rows without one come last, repeated rows by their place."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")


def duplicate_groups(docs: DataFrame, digest: Callable[[Column], Column] = content_hash, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text) for every row of ``docs``.

    Texts are equal when their normalised bytes are; null counts as empty, and empty texts are equal like any other. Of
    equal texts one row stays: the one with the smallest doc_id, rows without doc_id only where no other has one (keep_id is
    then null), and one of rows that repeat a doc_id. ``digest`` may be any hash of a text: groups of equal hash are
    compared by bytes, and those found to hold several texts are grouped anew by text. Other columns are dropped.
    """
    plain = texts(docs).select("doc_id", normalised(F.col("text")).alias("plain"))
    hashed = plain.select("doc_id", digest(F.col("plain")).alias("hash"), "plain")
    rows = staged(hashed.select("doc_id", "hash", F.unhex(F.sha2("plain", 256)).alias("sha"),
                                F.monotonically_increasing_id().alias("row")), "rows")
    several = staged(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("group_size"), _best()).filter("group_size > 1"), "several")
    mixed = staged(_mixed(hashed, several.select("hash"), bits), "mixed")
    if mixed.isEmpty():
        return _decided(rows, several, "hash")
    whole = _decided(rows.join(mixed, "hash", "left_anti"), several.join(mixed, "hash", "left_anti"), "hash")
    again = staged(hashed.join(mixed, "hash", "left_semi").withColumns(
        {"row": F.monotonically_increasing_id(), "sha": F.unhex(F.sha2("plain", 256))}), "again")
    classes = again.groupBy("plain").agg(F.count(F.lit(1)).alias("group_size"), _best()).filter("group_size > 1")
    return whole.unionByName(_decided(again, classes, "plain"))


def _mixed(hashed: DataFrame, several: DataFrame, bits: int) -> DataFrame:
    """The hashes whose rows differ in some byte. Single rows that the bit table lets through do no harm."""
    members = may_be_among(hashed, "hash", several, bits).filter("__among")
    distinct = members.groupBy("hash", "plain").agg(F.count(F.lit(1)).alias("copies"))
    return distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("different")).filter("different > 1").select("hash")


def _decided(rows: DataFrame, several: DataFrame, key: str) -> DataFrame:
    """Rows without a group of their own stand alone."""
    alone = F.col("best").isNull()
    return rows.join(several, key, "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns and their order stay.

    Rows that go are found by id and text, so other texts under the same id stay. Where the row that stays is repeated
    under its id, one of its repetitions stays.
    """
    same = ["__doc", "__sha"]
    found = duplicate_groups(docs).select(F.col("doc_id").alias("__doc"), F.col("text_sha256").alias("__sha"), "kept")
    counts = found.groupBy(*same).agg(F.count(F.lit(1)).alias("__rows"), F.bool_or("kept").alias("__kept"))
    special = staged(counts.filter("NOT __kept OR __rows > 1"), "special")
    keyed = docs.withColumns({"__doc": F.col("doc_id"), "__sha": F.sha2(normalised(F.coalesce("text", F.lit(""))), 256)})

    def joined(which: DataFrame, how: str) -> DataFrame:
        right = which.select(F.col("__doc").alias("__d"), F.col("__sha").alias("__s"))
        return keyed.join(right, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__sha") == F.col("__s")), how)

    repeated = joined(special.filter("__kept"), "left_semi").dropDuplicates(same)
    return joined(special, "left_anti").unionByName(repeated).select(docs.columns)
