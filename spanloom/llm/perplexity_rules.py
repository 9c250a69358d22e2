"""Quality rules: word counts, repetition, and language-specific perplexity bands.

The language model is an interpolated modified Kneser-Ney model of character
4-grams. Characters are UTF-16 units, not folded, so a gram is one exact 64-bit
number in any script, and the model grows with what the corpus holds. Nothing of
it passes through the driver (but four sums an order) and nothing is broadcast:

1. Documents are packed into blocks, each with the sorted array of its distinct
   grams, and a row for each text with its hash, two min-hashes of its
   16-character windows, and a sketch of six bits of each of 16 more. Texts that
   share a min-hash may be near copies; one is taken as a near copy of the text
   of least hash that it shares one with if their sketches agree in 13 places too.
   Copies and near copies don't count, over the whole table, whatever the blocks,
   so a group of them weighs as much as one text; all other texts count.
2. The blocks count the grams of the texts that count, and Spark sums them;
   orders 3, 2 and 1 count the distinct units before a gram. Discounts, back-off
   masses and probabilities are windows and joins of these tables, of integers
   only until the last division, so they don't depend on an order of sums
   either. The model is stored in arrays sorted by the grams' hashes.
3. The blocks' arrays are probed against the model by a sort-merge join; the
   answers meet their block, whose texts are scored by binary search. The blocks
   are bucketed by their number, so texts are not shuffled.

A text's log perplexity a character is compared with those of its language: their median
and median absolute deviation (from a histogram in thousandths, near copies
counting once) give a lower and an upper band, wider for short texts and rare
languages. Texts outside, and texts that fail the base rules, are rejected.

Edge cases: null text counts as without words, and fails the base rules; a null
language is the empty string; texts without characters have no perplexity and
stay in every band; a language without bands keeps all its texts; repeated rows
are judged alike; an empty table gives an empty result; extra columns are
ignored by ``judge`` and returned as they are by ``keep_good``, null ids are
returned like others. Very long texts are scored whole, in a piece of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, materialise, release, ship_package

ORDER, BITS = 4, 16
LOW_BAND, HIGH_BAND = 5.0, 3.0  # in deviations below and above the median
SHORT_SLACK = 0.7  # added to the deviation over the root of the characters
LEAST_DEVIATION = 0.005
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
BLOCK_UNITS = 12 << 20  # characters after which a block is closed
PIECE_UNITS = 1 << 18  # characters that are packed, and worked on, together
_SLICE = 1 << 20  # grams that are sorted or looked up together
_WINDOW = 16  # characters of a min-hashed window
_BIN = 1000
_LANES, _ALIKE = 16, 13  # further min-hashes of a text, eight a long, and how many near copies share
_LANE_ONES = 0x3F3F3F3F3F3F3F3F  # six bits a byte: their sum with as many never leaves the byte
_LANE_TOPS = 0x4040404040404040
_LANE_NAMES = ("lanes_1", "lanes_2")
_KEY_NAMES = ("text_hash", "near_1", "near_2", *_LANE_NAMES)
_START = "\n" * (ORDER - 1)  # a text begins as after a line's end


# ---- base rules

def base_rules(text: str) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at space and \t \n \v \f \r only
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = data.split(b"\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen: set[bytes] = set()
        for line in lines:
            if line in seen:
                dup += bool(line.split())
            seen.add(line)
    repeat = repeated_words(words)
    return n, chars, symbols, dup, repeat, n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n


_WINDOW_FACTORS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that occur twice or more."""
    n = len(words)
    if n < 6:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    windows = sum(ids[i : n - 4 + i] * factor for i, factor in enumerate(_WINDOW_FACTORS))
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    found = np.isin(windows, twice)
    covered = np.zeros(n, bool)
    for i in range(5):
        covered[i : n - 4 + i] |= found
    return int(covered.sum())


# ---- characters and grams

_MIX = [np.uint64(k) for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


_LANE_FACTORS = [np.uint64((0x9E3779B97F4A7C15 * (2 * lane + 1) ** 7 | 1) % 2**64) for lane in range(_LANES)]


def _mix(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * factor
    return x ^ (x >> np.uint64(29))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grams that end at the characters of the texts, and where each text's grams start and end."""
    units = [text.encode("utf-16-le", "surrogatepass") for text in texts]
    sizes = np.array([len(u) // 2 for u in units], np.int64)
    pad = _START.encode("utf-16-le")
    x = np.frombuffer(b"".join(part for u in units for part in (pad, u)), np.uint16)
    found = np.zeros(max(0, len(x) - ORDER + 1), np.uint64)
    for i in range(ORDER):
        found <<= np.uint64(BITS)
        found |= x[i : i + len(found)]
    first = np.cumsum(sizes + ORDER - 1) - sizes - ORDER + 1
    return found, first, first + sizes


def near_keys(found: np.ndarray, first: np.ndarray, last: np.ndarray, texts: list[str]) -> np.ndarray:
    """Two min-hashes of each text's windows, and two rows of eight lanes with six bits of a min-hash each; near copies share
    any of these 18 with a chance of about their likeness. Short texts have their own hash in all rows."""
    out = np.stack([text_hashes(texts)] * (2 + _LANES // 8))
    out[2:] &= np.uint64(_LANE_ONES)
    long = np.flatnonzero(last - first > _WINDOW)
    if len(long):
        n = len(found) - _WINDOW + ORDER
        window = found[:n].copy()
        for at in range(ORDER, _WINDOW, ORDER):
            window = window * _MIX[2] + found[at : at + n]
        ends = np.stack([first[long] + ORDER, last[long] - _WINDOW + ORDER], axis=1).ravel()
        for row, factor in enumerate(_MIX[:2]):
            hashes = np.append(_mix(window, factor), np.uint64(0))
            out[row, long] = np.minimum.reduceat(hashes, ends)[::2]
        out[2:, long] = 0
        mixed = np.append(_mix(window, _MIX[2]), np.uint64(0))
        for lane in range(_LANES):
            least = np.minimum.reduceat(mixed * _LANE_FACTORS[lane], ends)[::2]
            out[2 + lane // 8, long] |= (_mix(least, _MIX[0]) & np.uint64(0x3F)) << np.uint64(8 * (lane % 8))
    return out


def text_hashes(texts: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) for text in texts], np.uint64)


class _Grams:
    """Distinct grams, sorted, and how often each was added."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, codes: np.ndarray) -> None:
        for at in range(0, len(codes), _SLICE):
            self.parts.append(np.unique(codes[at : at + _SLICE], return_counts=True))
            if len(self.parts) > 8:
                self.parts = [self.merged()]

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, n = (np.concatenate(column) for column in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        return keys[first], np.add.reduceat(n, first) if len(keys) else n


def within(found: np.ndarray, first: np.ndarray, last: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The grams of the chosen texts."""
    held = [found[a:b] for a, b in zip(first[chosen].tolist(), last[chosen].tolist(), strict=True)]
    return np.concatenate(held) if held else found[:0]


# ---- blocks

_BLOCKS = "block long, piece int, docs binary, grams binary, keys binary"


def _pieces(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in pieces of up to PIECE_UNITS characters (or one text), with their texts."""
    texts = [text or "" for text in batch.column(at).to_pylist()]
    first = units = 0
    for i, text in enumerate(texts):
        if units and units + len(text) > PIECE_UNITS:
            yield batch.slice(first, i - first), texts[first:i]
            first, units = i, 0
        units += len(text)
    if texts:
        yield batch.slice(first), texts[first:]


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def blocks_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns, as blocks: a row with the block's sorted grams (piece -1), and rows with packed documents and, for
    each of them, the hash and the near keys of its text.

    The table is bucketed by block and stands in the shared folder; its name leaves the catalog at once.
    """
    spark = docs.sparkSession
    ship_package(spark)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, piece, units, block = TaskContext.get().partitionId() << 32, 0, 0, _Grams()

        def row(*values):
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)],
                ["block", "piece", "docs", "grams", "keys"])

        for batch in batches:
            for part, texts in _pieces(batch, at):
                found, first, last = grams(texts)
                block.add(within(found, first, last, np.arange(len(texts))))
                keys = np.concatenate([text_hashes(texts)[None], near_keys(found, first, last, texts)])
                yield row(number, piece, _packed(part), None, keys.tobytes())
                piece, units = piece + 1, units + len(found)
                if units >= BLOCK_UNITS:
                    yield row(number, -1, None, block.merged()[0].tobytes(), None)
                    number, piece, units, block = number + 1, 0, 0, _Grams()
        if piece:
            yield row(number, -1, None, block.merged()[0].tobytes(), None)
        del block
        release()

    name, buckets = f"spanloom_blocks_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs.mapInArrow(run, _BLOCKS).write.bucketBy(buckets, "block").sortBy("block").option(
        "path", fresh_path(spark, "blocks")).format("parquet").saveAsTable(name)
    held = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return held


def _arrays(blocks: DataFrame) -> DataFrame:
    """(block, at, gram): the blocks' sorted arrays as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                keys = np.frombuffer(keys, np.int64)
                for first in range(0, len(keys), 1 << 16):
                    part = keys[first : first + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), block)), pa.array(np.arange(first, first + len(part), dtype=np.int32)), pa.array(part)],
                        ["block", "at", "gram"])
        release()

    return blocks.where("piece = -1").select("block", "grams").mapInArrow(run, "block long, at int, gram long")


def _alike(a: Column, b: Column) -> Column:
    """Whether two texts' lanes (structs with lanes_1, lanes_2) agree in _ALIKE places."""
    apart = sum((F.bit_count((a[name].bitwiseXOR(b[name]) + F.lit(_LANE_ONES)).bitwiseAND(F.lit(_LANE_TOPS))) for name in _LANE_NAMES), F.lit(0))
    return apart <= _LANES - _ALIKE


def counting_texts(blocks: DataFrame) -> DataFrame:
    """(block, piece, at) of the texts that count: of copies and confirmed near copies one, and all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, piece, keys in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys = np.frombuffer(keys, np.int64).reshape(len(_KEY_NAMES), -1)
                n = keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), pa.array(np.full(n, piece, np.int32)), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, keys)],
                    ["block", "piece", "at", *_KEY_NAMES])

    rows = blocks.where("piece >= 0").select("block", "piece", "keys").mapInArrow(
        run, "block long, piece int, at int, " + ", ".join(f"{name} long" for name in _KEY_NAMES))
    for near in ("near_1", "near_2"):  # the text of least hash is carried along those of a near key
        order = Window.partitionBy(near).orderBy("text_hash", "block", "piece", "at")
        rows = rows.withColumns({"again": F.coalesce(F.lag("text_hash").over(order) == F.col("text_hash"), F.lit(False)),
                                 "leader": F.first(F.struct("text_hash", *_LANE_NAMES)).over(order.rowsBetween(Window.unboundedPreceding, 0))})
        near_copy = (F.col("leader.text_hash") != F.col("text_hash")) & _alike(F.struct(*_LANE_NAMES), F.col("leader"))
        rows = rows.where(~F.col("again") & ~near_copy).drop("again", "leader")
    return rows.select("block", "piece", "at")


def _documents(packed: pa.Scalar) -> pa.RecordBatch:
    with pa.ipc.open_stream(packed.as_buffer()) as stream:
        return stream.read_next_batch()


def _all_grams(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """counts (gram, n) summed, and 0 for the blocks' other grams, which are looked up too."""
    return counts.unionByName(_arrays(blocks).select("gram", F.lit(0).cast("long").alias("n"))).groupBy("gram").agg(F.sum("n").alias("n"))


def count_grams(blocks: DataFrame, text_at: int, counting: DataFrame | None = None) -> DataFrame:
    """(gram, n) of all grams, counted in the texts that count (of `counting_texts`); the text is the packed documents' column `text_at`."""

    def run(held: pa.Table, chosen: pa.Table) -> pa.Table:
        piece_of, at = chosen.column("piece").to_numpy(), chosen.column("at").to_numpy()
        block = _Grams()
        for i, piece in enumerate(held.column("piece").to_pylist()):
            mine = np.sort(at[piece_of == piece])
            if len(mine):
                texts = [text or "" for text in _documents(held.column("docs")[i]).column(text_at).take(pa.array(mine)).to_pylist()]
                block.add(within(*grams(texts), np.arange(len(texts))))
        keys, n = block.merged()
        del block
        release()
        return pa.table({"gram": keys.view(np.int64), "n": n})

    counted = blocks.where("piece >= 0").select("block", "piece", "docs").groupBy("block").cogroup(
        (counting_texts(blocks) if counting is None else counting).groupBy("block")).applyInArrow(run, "gram long, n long")
    return _all_grams(blocks, counted)


# ---- the model

def _suffix(code: Column, order: int) -> Column:
    return code.bitwiseAND(F.lit((1 << (BITS * order)) - 1))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The discounts of grams seen once, twice, and three or more times, from how many grams are seen one to four times."""
    n1, n2, n3, n4 = (max(1, n) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    one, two, three = (min(max(d, 0.05 * k), 0.95 * k) for k, d in enumerate(raw, 1))
    return one, two, three


def estimate(counts: DataFrame) -> DataFrame:
    """Interpolated modified Kneser-Ney: (gram, key, log_p), sorted by key, of all grams in counts, those that count 0 included.

    Lower orders count the distinct units before their grams; below the first stands one class of 2^16 units.
    """
    level = counts.select(F.lit(ORDER).alias("level"), F.col("gram").alias("code"), "n")
    levels = level
    for order in range(ORDER - 1, 0, -1):
        level = level.groupBy(_suffix(F.col("code"), order).alias("code")).agg(F.count_if(F.col("n") > 0).alias("n")).select(
            F.lit(order).alias("level"), "code", "n")
        levels = levels.unionByName(level)
    levels = materialise(levels, "gram-levels")
    sums = {r.level: r for r in levels.groupBy("level").agg(
        F.sum("n").alias("total"), *(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)), F.count_if(F.col("n") > 2).alias("more")).collect()}
    below = None
    for order in range(1, ORDER + 1):
        if order not in sums:
            break
        known = sums[order]
        one, two, three = discounts(known.n1, known.n2, known.n3, known.n4)
        n = F.col("n")
        d = F.when(n == 0, 0.0).when(n == 1, one).when(n == 2, two).otherwise(three)
        rows = levels.where(F.col("level") == order).select("code", "n", d.alias("d"))
        if order == 1:  # one context
            rows = rows.withColumns({"total": F.lit(known.total), "mass": F.lit(one * known.n1 + two * known.n2 + three * known.more), "low": F.lit(2.0**-BITS)})
        else:
            context = Window.partitionBy(F.shiftrightunsigned("code", BITS))
            once, twice, often = (F.count_if(kind).over(context) for kind in (n == 1, n == 2, n > 2))
            rows = rows.withColumns({"total": F.sum("n").over(context), "mass": one * once + two * twice + three * often}).withColumn("suffix", _suffix(F.col("code"), order - 1))
            rows = rows.join(below.select(F.col("code").alias("suffix"), F.col("p").alias("low")), "suffix")
        p = F.when(F.col("total") > 0, (n - F.col("d") + F.col("mass") * F.col("low")) / F.col("total")).otherwise(F.col("low"))
        below = rows.select("code", p.alias("p"))
    if below is None:
        return counts.select("gram", F.xxhash64("gram").alias("key"), F.lit(0.0).cast("float").alias("log_p"))
    model = below.select(F.col("code").alias("gram"), F.xxhash64("code").alias("key"), F.log("p").cast("float").alias("log_p"))
    return materialise(model.repartitionByRange("key").sortWithinPartitions("key"), "model")


# ---- scores

_EXTRA = ["n_words long", "word_chars long", "n_symbols long", "n_dup_lines long", "n_repeat_words long", "base_failed boolean",
          "chars long", "counts boolean", "log_perplexity double"]
_KINDS = [*[pa.int64()] * 5, pa.bool_(), pa.int64(), pa.bool_(), pa.float64()]


def _log_perplexities(found: np.ndarray, first: np.ndarray, last: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Mean negative log probability a character of each text; NaN without characters. A text's sum is its own, so that it
    does not depend on what stands beside it."""
    met = np.zeros(len(found) + 1)
    for at in range(0, len(found), _SLICE):
        part = found[at : at + _SLICE]
        met[at : at + len(part)] = values[np.minimum(np.searchsorted(keys, part), len(keys) - 1)] if len(keys) else 0
    out = np.full(len(first), np.nan)
    some = np.flatnonzero(last > first)
    if len(some):
        ends = np.stack([first[some], last[some]], axis=1).ravel()
        out[some] = -np.add.reduceat(met, ends)[::2] / (last - first)[some]
    return out


def score(blocks: DataFrame, model: DataFrame, schema: T.StructType, text_col: str, keep: list[str], prefix: str = "",
          counting: DataFrame | None = None) -> DataFrame:
    """The documents of the blocks (their schema, of which `keep` stays) with base counts, whether they are among the texts that
    count (of `counting_texts`; false for all without these), and log perplexity."""
    wanted = _arrays(blocks).select("block", "at", "gram", F.xxhash64("gram").alias("key"))
    answers = wanted.join(model, ["key", "gram"]).select("block", F.lit(-1).alias("piece"), "at", "log_p")
    if counting is not None:
        answers = answers.unionByName(counting.select("block", "piece", "at", F.lit(0.0).cast("float").alias("log_p")))
    columns = [schema.names.index(name) for name in keep]
    at = schema.names.index(text_col)
    names = [*keep, *(prefix + e.split()[0] for e in _EXTRA)]

    def run(held: pa.Table, answer: pa.Table) -> pa.Table:
        order = np.argsort(held.column("piece").to_numpy()).tolist()  # the block's arrays come first
        keys = np.frombuffer(held.column("grams")[order[0]].as_py(), np.uint64)
        values = np.zeros(len(keys))
        piece_of, place = answer.column("piece").to_numpy(), answer.column("at").to_numpy()
        known = piece_of < 0
        values[place[known]] = answer.column("log_p").to_numpy()[known]
        chosen = {}
        for number, at_ in zip(piece_of[~known].tolist(), place[~known].tolist(), strict=True):
            chosen.setdefault(number, []).append(at_)
        out = []
        for piece in order[1:]:
            batch = _documents(held.column("docs")[piece])
            texts = [text or "" for text in batch.column(at).to_pylist()]
            found, first, last = grams(texts)
            value = _log_perplexities(found, first, last, keys, values)
            counts = np.zeros(len(texts), bool)
            counts[chosen.get(held.column("piece")[piece].as_py(), [])] = True
            rules = list(zip(*map(base_rules, texts), strict=True))
            extra = [*rules, [len(text) for text in texts], counts]
            extra = [pa.array(c, k) for c, k in zip(extra, _KINDS, strict=False)] + [pa.array(value, pa.float64(), mask=np.isnan(value))]
            out.append(pa.RecordBatch.from_arrays([*(batch.column(i) for i in columns), *extra], names))
        table = pa.Table.from_batches(out)
        release()
        return table

    result = T.StructType([schema[i] for i in columns] + T._parse_datatype_string(", ".join(prefix + e for e in _EXTRA)).fields)
    return blocks.select("block", "piece", "docs", "grams").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, result)


# ---- bands and verdicts

def bands_of(scores: DataFrame, lang: Column, prefix: str = "") -> DataFrame:
    """(language, median, deviation): of each language's texts, copies and confirmed near copies counting once."""
    value = F.col(f"{prefix}log_perplexity")
    once = scores.where(value.isNotNull() & F.col(f"{prefix}counts")).select(lang.alias("language"), F.floor(value * _BIN).cast("int").alias("bin"))
    histogram = materialise(once.groupBy("language", "bin").agg(F.count(F.lit(1)).alias("n")), "perplexity-histogram")

    def middle(rows: DataFrame, value: str, name: str) -> DataFrame:
        """The least value up to which half of a language's texts lie."""
        running = Window.partitionBy("language").orderBy(value)
        ranked = rows.select("language", value, F.sum("n").over(running).alias("upto"),
                             F.sum("n").over(Window.partitionBy("language")).alias("total"))
        return ranked.where(2 * F.col("upto") >= F.col("total")).groupBy("language").agg(F.min(value).alias(name), F.max("total").alias("texts"))

    median = middle(histogram, "bin", "mid")
    off = (histogram.join(median.select("language", "mid"), "language")
           .groupBy("language", F.abs(F.col("bin") - F.col("mid")).alias("off")).agg(F.sum("n").alias("n")))
    bands = median.join(middle(off, "off", "mad").select("language", "mad"), "language").select(
        "language", ((F.col("mid") + 0.5) / _BIN).alias("median"),
        (F.greatest(F.col("mad") / _BIN, F.lit(LEAST_DEVIATION)) + 1.0 / F.col("texts")).alias("deviation"))
    return materialise(bands, "perplexity-bands")


@dataclass(frozen=True)
class Fitted:
    """A corpus' gram counts and the bands of its languages."""

    counts: DataFrame
    bands: DataFrame


def _language(lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col).cast("string"), F.lit(""))


def _scored(docs: DataFrame, text_col: str, keep: list[str], prefix: str, counts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The scores of docs, by their own grams or by given counts; and the counts."""
    blocks = blocks_of(docs, text_col)
    counting = materialise(counting_texts(blocks), "counting") if counts is None else None
    own = count_grams(blocks, docs.columns.index(text_col), counting) if counts is None else _all_grams(blocks, counts)
    own = materialise(own, "grams")
    model = estimate(own)
    return materialise(score(blocks, model, docs.schema, text_col, keep, prefix, counting), "perplexities"), own


def _verdict(scores: DataFrame, bands: DataFrame, lang_col: str, prefix: str) -> DataFrame:
    """The scores with `kept` (prefixed). Spark broadcasts the bands only if their files are small."""
    name = f"{prefix}language"
    met = bands.select(F.col("language").alias(name), F.col("median").alias(f"{prefix}median"), F.col("deviation").alias(f"{prefix}deviation"))
    joined = scores.join(met, _language(lang_col) == F.col(name), "left")
    z = (F.col(f"{prefix}log_perplexity") - F.col(f"{prefix}median")) / (
        F.col(f"{prefix}deviation") + SHORT_SLACK / F.sqrt(F.greatest(F.col(f"{prefix}chars"), F.lit(1)).cast("double")))
    return joined.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & F.coalesce(z.between(-LOW_BAND, HIGH_BAND), F.lit(True)))


def _chosen(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Fitted:
    """The gram counts of docs and the bands of its languages, to judge other documents by."""
    chosen = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    scores, counts = _scored(chosen, "text", ["lang"], "", None)
    return Fitted(counts, bands_of(scores, _language("lang")))


def judge(docs: DataFrame, fitted: Fitted | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs, with the base counts and the verdict, by docs themselves or by what was fitted on another corpus."""
    scores, _ = _scored(_chosen(docs, id_col, text_col, lang_col), "text", ["doc_id", "lang"], "", fitted and fitted.counts)
    bands = fitted.bands if fitted else bands_of(scores, _language("lang"))
    return _verdict(scores, bands, "lang", "").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


def keep_good(docs: DataFrame, fitted: Fitted | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, that are kept."""
    prefix = f"__{len(docs.columns)}_"
    scores, _ = _scored(docs, text_col, docs.columns, prefix, fitted and fitted.counts)
    bands = fitted.bands if fitted else bands_of(scores, _language(lang_col), prefix)
    return _verdict(scores, bands, lang_col, prefix).where(F.col(f"{prefix}kept")).select(*docs.columns)
