"""Spelling variants: words one inserted, deleted or replaced character apart, by range reporting on wavelet trees.

Words are counted over all texts. A word and a word of `m` characters that is
one edit longer, or as long but for one replaced character, agree before and
after the place of the edit. For a place, the words of length m that agree
before it are an interval of these words' order, those that agree after it are
an interval of the order of the words read from their ends. With a point for
each word (its rank in either order) the words that do both are those in a
rectangle, and a wavelet tree over the points reports them in a time that grows
with the logarithm of the words and with what it reports.

Trees are spread over tasks. The m places are dealt into segments of up to
`SEGMENT` places; words that agree outside a segment get the same key, whose
hash is their block, and a block has one tree a length. So a word enters as many blocks
as it has segments, any two near words meet in exactly one, and what shares a
key is bounded by the alphabet (90 letters, so 90^3), whatever the corpus.
Blocks grow in number with the words, and hold some ten thousand each.

A pair of two lengths may have several places (`aab` from `ab`); only the first
of a run of equal characters counts. Blocks return a row for each word that has
near words there: their number, and the best. Sums of these are shuffled, never
the pairs.

Edge cases: a null text has no words; words of any length count; a word without
near words has none (0), no form, and is its own root; of near words with equal
counts the smallest in code-point order is the form; repeated rows count each;
a null id is the empty string where places to delete are drawn; an empty table
gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import materialise, release, ship_package
from .components import apart

RUN = "[A-Za-zÀ-ÿ]+"
SEGMENT = 3  # places
BLOCK_ENTRIES = 30_000  # about so many entries of words a block
_SLICE = 1 << 15  # queries that are answered together
_ROUNDS = 64


# ---- words

def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int = 97) -> DataFrame:
    """(word) of all occurrences: runs of letters with A-Z lower-cased. Where `drop_every` divides the run's draw (the CRC-32
    of id and run), the character at the draw modulo the length is left out; with 0, nowhere."""
    runs = docs.select(docs[id_col].cast("string").alias("id"), F.explode(F.regexp_extract_all(docs[text_col].cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    run = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    if not drop_every:
        return runs.select(run.alias("word"))
    runs = runs.select(run.alias("run"), F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), run).cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    short = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.select(F.when(F.col("h") % drop_every == 0, short).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of words of enough characters and occurrences."""
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


# ---- wavelet trees

class WaveletTree:
    """Points (i, values[i]) for a permutation `values` of 0 ... n-1, kept as a bit of each value and level, the highest first;
    on each level the points stand ordered by the bits above, else as they came."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.n, self.levels = n, max(1, int(n - 1).bit_length()) if n else 1
        self.ones: list[np.ndarray] = []  # per level: how many ones stand before each place
        self.starts: list[np.ndarray] = []  # per level: where each node begins
        row = np.asarray(values, np.int64)
        for level in range(self.levels):
            shift = self.levels - 1 - level
            self.starts.append(np.searchsorted(row >> (shift + 1), np.arange((1 << level) + 1)))
            bits = (row >> shift) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bits)]))
            row = row[np.argsort(row >> shift, kind="stable")]  # within each node, zeros before ones

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all points with a <= i < b and c <= value < d, for arrays of such rectangles."""
        query = np.flatnonzero((a < b) & (c < d))
        node, lo, hi = np.zeros(len(query), np.int64), a[query], b[query]  # lo, hi: within the node
        for level in range(self.levels):
            half = 1 << (self.levels - 1 - level)
            start, ones = self.starts[level][node], self.ones[level]
            before = ones[start]
            one_lo, one_hi = ones[start + lo] - before, ones[start + hi] - before
            parts = []
            for bit, l, h in ((0, lo - one_lo, hi - one_hi), (1, one_lo, one_hi)):
                child = node * 2 + bit
                live = np.flatnonzero((l < h) & (child * half < d[query]) & ((child + 1) * half > c[query]))
                parts.append((query[live], child[live], l[live], h[live]))
            query, node, lo, hi = (np.concatenate(column) for column in zip(*parts, strict=True))
        return query, node


def _matrix(words: list[bytes]) -> np.ndarray:
    """Words of one length as rows of bytes."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def _strings(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes (none of them 0) as numpy strings, which are compared byte by byte."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


class Lexicon:
    """Words of one length m in both orders, with their points in a wavelet tree."""

    def __init__(self, words: list[bytes]):
        self.words = words
        rows = _matrix(words)
        self.m = rows.shape[1]
        self.order = np.argsort(_strings(rows), kind="stable")
        self.rows = rows[self.order]
        self.forward = _strings(self.rows)
        turned = _strings(self.rows[:, ::-1])
        by_end = np.argsort(turned, kind="stable")
        self.backward, self.by_end = turned[by_end], by_end
        rank = np.empty(len(words), np.int64)
        rank[by_end] = np.arange(len(words))
        self.tree = WaveletTree(rank)

    def _interval(self, held: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the ordered strings, those that begin with each row of parts."""
        wide = np.full((2, len(parts), self.m), 255, np.uint8)
        wide[0] = 1
        wide[:, :, : parts.shape[1]] = parts
        return np.searchsorted(held, _strings(wide[0])), np.searchsorted(held, _strings(wide[1]), side="right")

    def agreeing(self, rows: np.ndarray, place: int, longer: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of the words that agree with a row before `place` and after it: one character less is compared where
        a row has m characters, none where the words are one `longer` than the rows."""
        a, b = self._interval(self.forward, rows[:, :place])
        c, d = self._interval(self.backward, rows[:, place + (not longer) :][:, ::-1])
        query, value = self.tree.report(a, b, c, d)
        return query, self.by_end[value]  # a place in the forward order


# ---- blocks

class _Best:
    """How many near words were found for each word, and the best of them by (count, then order)."""

    def __init__(self):
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, words: np.ndarray, near: np.ndarray) -> None:
        if len(words):
            self.found.append((words, near))

    def rows(self, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, near words, best): n and rank by number of a word."""
        if not self.found:
            return (np.empty(0, np.int64),) * 3
        words, near = (np.concatenate(column) for column in zip(*self.found, strict=True))
        order = np.lexsort((rank[near], -n[near], words))
        words, near = words[order], near[order]
        first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        return words[first], np.diff(np.append(first, len(words))), near[first]


def near_in_block(m: int, words: list[bytes], n: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, near words, best entry) of a block's entries: words of m or m - 1 characters, each with a segment of places of a
    word of m characters [first, last)."""
    sizes = np.array([len(w) for w in words])
    text, number = np.unique(np.array(words, "S"), return_inverse=True)  # words that enter by several segments, as one
    entry_of = np.zeros(len(text), np.int64)
    entry_of[number] = np.arange(len(words))
    held = np.flatnonzero(sizes[entry_of] == m)
    best = _Best()
    if len(held):
        lexicon = Lexicon([words[i] for i in entry_of[held].tolist()])
        member = held[lexicon.order]  # by place in the forward order, the number among all of the block's
        for longer in (False, True):
            mine = np.flatnonzero(sizes == m - longer)
            for begin, end in sorted(set(zip(first[mine].tolist(), last[mine].tolist(), strict=True))):
                asked = mine[(first[mine] == begin) & (last[mine] == end)]
                for at in range(0, len(asked), _SLICE):
                    part = asked[at : at + _SLICE]
                    rows, own = _matrix([words[i] for i in part.tolist()]), number[part]
                    for place in range(begin, end):
                        query, found = lexicon.agreeing(rows, place, longer)
                        if longer:
                            if place:  # of equal characters in a row, the first is the one that was inserted
                                apart_ = lexicon.rows[found, place] != lexicon.rows[found, place - 1]
                                query, found = query[apart_], found[apart_]
                            best.add(member[found], own[query])
                        else:
                            other = member[found] != own[query]
                            query, found = query[other], found[other]
                        best.add(own[query], member[found])
    count = n[entry_of]
    who, near, top = best.rows(count, np.arange(len(text)))
    return entry_of[who], near, entry_of[top]


def entries_of(words: DataFrame, blocks: int) -> DataFrame:
    """(block, m, word, n, first, last): each word with the segments of words of its own length and of one character more.

    The key of a segment is what stands before and after it; of a word that is one shorter, what would.
    """
    size = F.length("word")
    entered = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("m"))
    entered = entered.select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1, F.lit(SEGMENT))).alias("first"))
    last = F.least("m", F.col("first") + SEGMENT)
    tail = F.substr("word", last + 1 - (F.col("m") - size))  # from the first character behind the segment
    key = F.xxhash64("m", "first", F.substr("word", F.lit(1), F.col("first")), tail)
    return entered.select(F.pmod(key, F.lit(blocks)).alias("block"), "m", "word", "n", "first", last.alias("last"))


_FOUND = "word string, near long, best_n long, best string"


def _answer(table: pa.Table) -> pa.Table:
    """The rows of _FOUND of a block, length by length."""
    out = []
    for m in pc.unique(table.column("m")).to_pylist():
        part = table.filter(pc.equal(table.column("m"), m))
        text = part.column("word")
        n, first, last = (part.column(c).to_numpy() for c in ("n", "first", "last"))
        who, near, top = near_in_block(m, [w.encode("latin-1") for w in text.to_pylist()], n, first, last)
        out.append(pa.table({"word": text.take(pa.array(who)), "near": near, "best_n": n[top], "best": text.take(pa.array(top))}))
    release()
    return pa.concat_tables(out)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near words."""
    ship_package(words.sparkSession)
    count = words.count()
    entries = entries_of(words, max(1, 6 * count // BLOCK_ENTRIES))  # some six entries a word
    found = entries.groupBy("block").applyInArrow(_answer, _FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("down"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("b.down")).alias("best_n"), F.col("b.best").alias("best"))


# ---- forms and roots

def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the end of each chain of forms, by pointer jumping. Counts at least double along a chain,
    so chains are short and the rounds are few."""
    jump = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(_ROUNDS):
        moved = Observation()
        onward = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jump = materialise(jump.join(apart(onward), "root", "left").observe(moved, F.count("next").alias("n")).select(
            "word", F.coalesce("next", "root").alias("root")), "roots")
        if not moved.get["n"]:
            return jump
    raise RuntimeError("chains of forms did not end")


def group_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n): a word's form is its best near word, if that is `factor` times as
    frequent; its root is where the forms lead."""
    words = materialise(words.select("word", "n"), "words")
    near = materialise(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best_n") >= factor * F.col("n"), F.col("best")).alias("form"),
        F.when(F.col("best_n") >= factor * F.col("n"), F.col("best_n")).alias("form_n")), "near-words")
    roots = roots_of(near.where("form IS NOT NULL"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int = 97, least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """The words of docs with their near words, forms and roots."""
    return group_variants(vocabulary(corpus_words(docs, id_col, text_col, drop_every), least_chars, least_count))
