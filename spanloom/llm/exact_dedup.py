"""Exact duplicates with a split of heavy hitters.

Texts are equal when they are identical after each run of blanks
(``[\\x20\\x09-\\x0D]+``) has become one space. A text's digest is the SHA-256 of
that in UTF-8; equal digests are taken as equal texts.

1. The ids and digests of all rows are written once; texts are read no more.
2. Misra-Gries counters (``freqItems``) find every digest that holds more than a
   quarter of a mean shuffle partition, beside some that hold less.
3. One aggregate, combined before its shuffle, verifies them: their exact sizes
   and winners. There are as many at most as counters (10,000), so they are
   broadcast, and rows that hold them are settled where they lie.
4. All other digests are shuffled; none of them can fill a partition.

Everything is DataFrame functions; no Python runs on the executors.

Edge cases: a null text counts as empty, and all empty texts are equal; blanks
at either end stay, as one space; a null id is greater than any other, and a
group without any id has a null winner and keeps all its rows; repeated rows
(same id, same text) count each in the size and share their verdict; an empty
table gives an empty result; columns other than the id and the text are ignored
by ``mark_copies`` and returned as they are by ``drop_copies``, whatever their
names. Texts of any length are digested whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

MOST_HEAVY = 10_000  # counters at most; freqItems allows no more


def normalised(text: Column) -> Column:
    """The text with each run of blanks as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def counters_for(partitions: int) -> int:
    """How many Misra-Gries counters find what is more than a quarter of a mean partition."""
    return min(MOST_HEAVY, max(1000, 4 * partitions))


def heavy_hitters(keyed: DataFrame, counters: int) -> DataFrame:
    """(digest, group_size, keep_id) of at most `counters` digests, among them all that occur in more than 1 / counters of the rows."""
    found = keyed.select(F.hex("digest").alias("digest")).freqItems(["digest"], 1.0 / counters)
    candidates = found.select(F.explode("digest_freqItems").alias("digest")).select(F.unhex("digest").alias("digest"))
    return keyed.join(F.broadcast(candidates), "digest").groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.min("id").alias("keep_id"))


def _settled(keyed: DataFrame, heavy: DataFrame) -> DataFrame:
    """keyed (id, digest) with the size and the winner of each row's group."""
    met = keyed.join(F.broadcast(heavy), "digest", "left")
    group = Window.partitionBy("digest")
    light = met.where("group_size IS NULL").select(
        "digest", "id", F.count(F.lit(1)).over(group).alias("group_size"), F.min("id").over(group).alias("keep_id"))
    return met.where("group_size IS NOT NULL").select("digest", "id", "group_size", "keep_id").unionByName(light)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return materialise(docs.select(docs[id_col].alias("id"), digest_of(docs[text_col]).alias("digest")), "digests")


def _heavy(keyed: DataFrame) -> DataFrame:
    partitions = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(heavy_hitters(keyed, counters_for(partitions)), "heavy-digests")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id (of the equal texts' least id), group_size, kept, text_sha256."""
    keyed = _keyed(docs, id_col, text_col)
    return _settled(keyed, _heavy(keyed)).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay: copies of heavy hitters go before anything of theirs is shuffled."""
    keyed = _keyed(docs, id_col, text_col)
    heavy = _heavy(keyed)
    # the least ids of what is not heavy; rows of heavy groups never get here
    least = keyed.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").groupBy("digest").agg(F.min("id").alias("keep"))
    mark, won = f"__{len(docs.columns)}_digest", heavy.select("digest", F.col("keep_id").alias("keep"))
    rows = docs.withColumn(mark, digest_of(docs[text_col]))

    def stays(winners: DataFrame):
        return (rows[mark] == winners["digest"]) & rows[id_col].eqNullSafe(winners["keep"])

    return rows.join(F.broadcast(won), stays(won), "left_semi").unionByName(
        rows.join(F.broadcast(heavy.select("digest")), rows[mark] == heavy["digest"], "left_anti").join(least, stays(least), "left_semi")).drop(mark)
