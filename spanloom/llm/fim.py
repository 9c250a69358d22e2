"""Fill-in-middle transformation by a table-driven byte DFA.

A text is units: ``[blank]*[other]+``, or the blanks at its end. A form is drawn
for each document, and two counts of units at which the text is cut into prefix,
middle and suffix; the output is the text itself (plain), or
``<P>prefix<S>suffix<M>middle`` (psm), or ``<S>suffix<P>prefix<M>middle`` (spm).

The bytes of a batch of texts are cut into lanes of up to ``LANE`` bytes that
never span two texts, and all lanes are scanned in step. A state of the DFA says
what the last bytes were: a blank, `<`, `<` and a sentinel's letter, or anything
else. It depends on the last two bytes alone, so a lane in the middle of a text
begins with the state that these give. One table look-up a byte yields the next
state and what the transition counts: characters (bytes that don't continue
one), unit ends (from anything to a blank) and whole sentinels. Per lane that
makes three sums. Sums over a text's lanes are its units, its characters, and
whether it holds a sentinel; a second pass scans only the lanes in which a cut
lies, found by binary search in the running sums of unit ends.

Edge cases: a null text is empty; empty texts, and texts that hold a sentinel,
are plain; a null id draws as the empty string; repeated rows get the same
output; an empty table gives an empty result; columns other than the id and the
text are ignored. Texts of any length are cut as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, ship_package

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
LANE = 256
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80

# ---- the DFA: classes of bytes, states, and a table of what follows on what

_BLANK, _CONTINUES, _OPEN, _LETTER, _CLOSE, _OTHER = range(6)
_AFTER_BLANK, _AFTER_OTHER, _AFTER_OPEN, _AFTER_LETTER = range(4)
_WIDTH = 8  # of a row of the table
_CHAR, _END, _SENTINEL = 0, 16, 32  # where a transition's counts stand above its next state
_STATE_BITS = 5


def _classes() -> np.ndarray:
    found = np.full(256, _OTHER, np.uint8)
    found[[0x20, *range(0x09, 0x0E)]] = _BLANK
    found[0x80:0xC0] = _CONTINUES
    found[ord("<")] = _OPEN
    found[[ord(mark[1]) for mark in (PREFIX, SUFFIX, MIDDLE)]] = _LETTER
    found[ord(">")] = _CLOSE
    return found


def _transitions() -> np.ndarray:
    """Indexed by state * _WIDTH + class: the next state * _WIDTH, and above it what the transition counts."""
    table = np.zeros(4 * _WIDTH, np.int64)
    for state in range(4):
        for kind in range(6):
            onward = {_BLANK: _AFTER_BLANK, _OPEN: _AFTER_OPEN}.get(kind, _AFTER_OTHER)
            if state == _AFTER_OPEN and kind == _LETTER:
                onward = _AFTER_LETTER
            counts = (int(kind != _CONTINUES) << _CHAR) | (int(kind == _BLANK and state != _AFTER_BLANK) << _END) | (
                int(state == _AFTER_LETTER and kind == _CLOSE) << _SENTINEL)
            table[state * _WIDTH + kind] = onward * _WIDTH | counts << _STATE_BITS
    return table


_CLASS, _TABLE = _classes(), _transitions()
_STATE = (1 << _STATE_BITS) - 1


class Scan:
    """The counts of texts' lanes. data: all bytes; starts: where each text begins, and the end of the last."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data, self.starts = data, starts
        sizes = np.diff(starts)
        lanes = -(-sizes // LANE)
        self.lane_of = np.concatenate([[0], np.cumsum(lanes)])  # each text's first lane
        text = np.repeat(np.arange(len(sizes)), lanes)
        within = np.arange(len(text)) - self.lane_of[text]
        self.first = starts[text] + within * LANE
        self.size = np.minimum(LANE, starts[text + 1] - self.first)
        # the two bytes before a lane give its state; texts begin as after a blank
        self.state = np.full(len(text), _AFTER_BLANK * _WIDTH, np.int64)
        inner = within > 0
        for back in (2, 1):
            self.state[inner] = _TABLE[self.state[inner] + _CLASS[data[self.first[inner] - back]]] & _STATE
        counted = self._run()
        field = (1 << 16) - 1
        self.chars, self.ends, marks = (self._sums((counted >> at) & field) for at in (_CHAR, _END, _SENTINEL))
        whole = self.lane_of[1:], self.lane_of[:-1]
        self.text_chars, inner_ends, sentinels = (sums[whole[0]] - sums[whole[1]] for sums in (self.chars, self.ends, marks))
        self.units = inner_ends + (sizes > 0)  # the last unit ends with the text
        self.has_sentinel = sentinels > 0

    @staticmethod
    def _sums(counts: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(counts)])

    def _run(self) -> np.ndarray:
        """All lanes in step, the longest first, so that those still running stand together."""
        order = np.argsort(-self.size, kind="stable")
        at, state, size = self.first[order], self.state[order], self.size[order]
        counted = np.zeros(len(order), np.int64)
        running = len(order) - np.searchsorted(size[::-1], np.arange(LANE), side="right")
        for step, n in enumerate(running.tolist()):
            if not n:
                break
            out = _TABLE[state[:n] + _CLASS[self.data[at[:n] + step]]]
            state[:n] = out & _STATE
            counted[:n] += out >> _STATE_BITS
        back = np.empty_like(counted)
        back[order] = counted
        return back

    def cut(self, text: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte (from the text's start) and character after so many units of each text."""
        size, first_lane = np.diff(self.starts)[text], self.lane_of[text]
        place, chars = np.where(units > 0, size, 0), np.where(units > 0, self.text_chars[text], 0)
        inner = np.flatnonzero((units > 0) & (units < self.units[text]))
        if len(inner):
            wanted = self.ends[first_lane[inner]] + units[inner]  # the running number of the unit's end
            lane = np.searchsorted(self.ends, wanted) - 1
            left = wanted - self.ends[lane]
            state, n = self.state[lane], len(inner)
            before = np.zeros(n, np.int64)
            found = np.full(n, -1)
            open_ = np.arange(n)
            for step in range(LANE):
                out = _TABLE[state[open_] + _CLASS[self.data[self.first[lane[open_]] + step]]]
                left[open_] -= (out >> (_STATE_BITS + _END)) & 1
                hit = left[open_] == 0
                found[open_[hit]] = step
                open_ = open_[~hit]
                if not len(open_):
                    break
                out = out[~hit]
                before[open_] += (out >> (_STATE_BITS + _CHAR)) & 1
                state[open_] = out & _STATE
            place[inner] = self.first[lane] + found - self.starts[text[inner]]
            chars[inner] = self.chars[lane] - self.chars[first_lane[inner]] + before
        return place, chars


# ---- forms

def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits by which a document is cut."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[at : at + 4], "big") for at in (0, 4, 8, 12))


def _string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and where each begins."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string())
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    return np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8), starts


def forms_of(batch: pa.RecordBatch, seed: int, fim_percent: int, spm_percent: int) -> pa.RecordBatch:
    """The rows of SCHEMA for a batch of (id, text)."""
    ids, texts = batch.column(0), batch.column(1).fill_null("").cast(pa.string())
    data, starts = _string_bytes(texts)
    scan = Scan(data, starts)
    h = np.array([draws(i, seed) for i in ids.to_pylist()], np.int64).reshape(-1, 4)
    plain = (scan.units == 0) | scan.has_sentinel | (h[:, 2] % 100 >= fim_percent)
    spm = h[:, 3] % 100 < spm_percent
    cut = np.flatnonzero(~plain)
    a, b = (h[cut, k] % (scan.units[cut] + 1) for k in (0, 1))
    (p, p_chars), (m, m_chars) = scan.cut(cut, np.minimum(a, b)), scan.cut(cut, np.maximum(a, b))
    outputs: list[bytes | None] = [None] * len(ids)
    prefix_mark, suffix_mark, middle_mark = (mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))
    for i, x, y, s in zip(cut.tolist(), p.tolist(), m.tolist(), spm[cut].tolist(), strict=True):
        text = data[starts[i] : starts[i + 1]].tobytes()
        prefix, middle, suffix = prefix_mark + text[:x], middle_mark + text[x:y], suffix_mark + text[y:]
        outputs[i] = (suffix + prefix if s else prefix + suffix) + middle
    chars = np.zeros((2, len(ids)), np.int64)
    chars[0, cut], chars[1, cut] = p_chars, m_chars - p_chars
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    made = pc.coalesce(pa.array(outputs, pa.binary()).cast(pa.string()), texts)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(scan.units, pa.int64()), pa.array(form.tolist(), pa.string()), *(pa.array(c, pa.int64(), mask=plain) for c in chars), made],
        ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT,
              spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n (units), form, prefix_chars and middle_chars (null if plain), output."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield forms_of(batch, seed, fim_percent, spm_percent)
        release()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _between(text: Column, first: str, second: str, third: str) -> tuple[Column, Column, Column]:
    """What follows each of three sentinels in an output that begins with the first. As texts with sentinels are plain, the
    first place where a sentinel is found is where it was put."""
    rest = F.substr(text, F.lit(len(first) + 1))
    a = F.substring_index(rest, second, 1)
    rest = F.substr(rest, F.length(a) + len(second) + 1)
    b = F.substring_index(rest, third, 1)
    return a, b, F.substr(rest, F.length(b) + len(third) + 1)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of."""
    prefix, suffix, middle = _between(output, PREFIX, SUFFIX, MIDDLE)
    suffix_2, prefix_2, middle_2 = _between(output, SUFFIX, PREFIX, MIDDLE)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_2, middle_2, suffix_2)).otherwise(output)
