"""Personal data: fixed patterns, and a semi-Markov conditional random field for what these miss.

The fixed patterns (email, ip, card, phone) are matched exactly and in time
linear in the text; their spans always stay. Beside them a semi-Markov CRF looks
at the regions of a text that hold digits or at-signs. A region is cut into
tokens; every span of up to ``MAX_TOKENS`` tokens, however long, is a candidate
entity of any type, scored by features of the whole span (digits and their
grouping, check sum, separators, what stands before and after it) and by the type
of what it follows directly: another entity, or a token outside. A dynamic program with
that bound on an entity's tokens chooses boundaries and types of a region
together. Entities found that overlap no span of the patterns are added.

The CRF is trained by maximum likelihood on the driver, from a bounded sample:
at most ``SAMPLE`` distinct regions of the corpus of up to ``SAMPLE_LENGTH``
characters (those of least hash, chosen in three steps of local choice, so no
task or driver gets more than a few thousand) with the patterns' spans as
labels, and examples generated with a fixed seed (entities in forms that the
patterns don't know, and dates, versions, amounts and identifiers as
counter-examples).

Edge cases: a null text is the empty text; very long texts and regions are
searched whole (a region's work is linear in its tokens and characters);
repeated rows give repeated results; an empty table gives an empty result (and
the CRF is trained on the generated examples alone); extra columns are ignored
by ``find`` and returned by ``redact``.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, ship_package

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 20
SAMPLE, SAMPLE_LENGTH = 1000, 256
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

Span = tuple[int, int, int]  # kind, start, end

# ---- fixed patterns

_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile("[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2 and (d := 2 * d) > 9:
            d -= 9
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at)):
            end = found.end()
            yield 0, start, end
        at = text.find("@", max(end, at + 1))


def _ips(text: str) -> Iterator[Span]:
    for run in _DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            parts = list(_PART.finditer(text, run.start(), run.end()))
            for i in range(0, len(parts) - 3, 4):
                if all(len(p.group().lstrip("0")) <= 3 and int(p.group()[-4:]) <= 255 for p in parts[i : i + 4]):
                    yield 1, parts[i].start(), parts[i + 3].end()


def _digits(text: str) -> str:
    return "".join(_PART.findall(text))


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by kind and start."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        out += _ips(text)
        out += ((2, m.start(), m.end()) for m in _CARD.finditer(text)
                if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d))
        if "+" in text:
            out += ((3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15)
    return out


# ---- regions, tokens and features

_TRIGGER = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]", re.I)
_SPACE = re.compile(r"\s")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
_CONTEXT = re.compile(r"(?i)\b(?:(tel|phone|call|fax|mobile|cell)|(card|visa|credit|payment|amex)|(ip|host|server|addr\w*)|(e?mail|contact|write))\W{0,3}$")
_CHUNK = 2000  # tokens whose segments are scored together


def _word_start(text: str, at: int, floor: int) -> int:
    while at > floor and not text[at - 1].isspace():
        at -= 1
    return at


def _word_end(text: str, at: int) -> int:
    stop = _SPACE.search(text, at)
    return stop.start() if stop else len(text)


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring words (one white-space character apart) that hold a digit, an at-sign or its spelling.

    A spelling that stands alone brings the words beside it.
    """
    at = 0
    begin = end = -1
    while found := _TRIGGER.search(text, at):
        start, stop = _word_start(text, found.start(), at), _word_end(text, found.end())
        if found.end() - found.start() > 1:
            if start == found.start() and start - 1 > at:
                start = _word_start(text, start - 1, at)
            if stop == found.end() and stop < len(text):
                stop = _word_end(text, stop + 1)
        if begin >= 0 and start - end <= 1:
            end = stop
        else:
            if begin >= 0:
                yield begin, end
            begin, end = start, stop
        at = stop
    if begin >= 0:
        yield begin, end


FEATURES = (
    "bias", "digits<7", "digits7-9", "digits10-12", "digits13-15", "digits16-19", "digits>19", "luhn", "at", "at spelt", "dot after at",
    "letters end", "letters", "plus", "paren", "groups1", "groups2", "groups3", "groups4", "groups>4", "pattern 3-3-4", "pattern 4s",
    "quad", "quad wrong", "one separator", "slash or colon", "date", "left joined", "right joined", "say phone", "say card", "say ip",
    "say mail", "space inside", "mixed word", "long group", "edge odd", "unbalanced")
_N = {name: i for i, name in enumerate(FEATURES)}
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-/.][01]?[0-9][-/.][0-3]?[0-9]$|[0-3]?[0-9][-/.][0-3]?[0-9][-/.](?:19|20)?[0-9]{2}$")


def span_features(text: str, start: int, end: int) -> np.ndarray:
    """Features of text[start:end] as a whole."""
    span = text[start:end]
    f = np.zeros(len(FEATURES), np.float32)
    groups = _PART.findall(span)
    digits = "".join(groups)
    n, lens = len(digits), [len(g) for g in groups]
    on = ["bias"]
    on.append("digits<7" if n < 7 else "digits7-9" if n < 10 else "digits10-12" if n < 13 else "digits13-15" if n < 16 else "digits16-19" if n < 20 else "digits>19")
    if 13 <= n <= 19 and luhn(digits):
        on.append("luhn")
    low = span.lower()
    spelt = "[at]" in low or "(at)" in low
    place = span.find("@") if "@" in span else max(low.find("[at]"), low.find("(at)"))
    if "@" in span:
        on.append("at")
    if spelt:
        on.append("at spelt")
    if place >= 0 and ("." in span[place:] or "dot" in low[place:]):
        on.append("dot after at")
    if span[-1:].isalpha():
        on.append("letters end")
    letters = any(c.isalpha() for c in span)
    if letters:
        on.append("letters")
    if span[0] == "+":
        on.append("plus")
    if "(" in span and ")" in span and not spelt:
        on.append("paren")
    if groups:
        on.append(f"groups{len(groups)}" if len(groups) < 5 else "groups>4")
    if lens[-3:] == [3, 3, 4] and len(lens) <= 4 and not letters:
        on.append("pattern 3-3-4")
    if len(lens) >= 4 and set(lens[:-1]) == {4} and lens[-1] <= 4:
        on.append("pattern 4s")
    marks = {c for c in span if not c.isalnum()}
    if len(lens) == 4 and marks == {"."} and not letters:
        on.append("quad" if all(k <= 3 and int(g) <= 255 for k, g in zip(lens, groups, strict=True)) else "quad wrong")
    if len(marks) == 1:
        on.append("one separator")
    if marks & set("/:,=\"'_"):
        on.append("slash or colon")
    if _DATE.match(span):
        on.append("date")
    if start and (text[start - 1].isalnum() or text[start - 1] in "-_.@+/("):
        on.append("left joined")
    if end < len(text) and (text[end].isalnum() or text[end] in "-_@/" or (text[end] == "." and text[end + 1 : end + 2].isalnum())):
        on.append("right joined")
    if said := _CONTEXT.search(text, max(0, start - 24), start):
        on.append(("say phone", "say card", "say ip", "say mail")[said.lastindex - 1])
    if " " in span:
        on.append("space inside")
    if letters and n and place < 0:
        on.append("mixed word")
    if lens and max(lens) > 6:
        on.append("long group")
    if not (span[0].isalnum() or span[0] in "+(") or not span[-1].isalnum():
        on.append("edge odd")
    if span.count("(") != span.count(")") or span.count("[") != span.count("]"):
        on.append("unbalanced")
    f[[_N[name] for name in on]] = 1
    return f


@dataclass(frozen=True)
class Region:
    """Token bounds of a region, and its candidate segments with their features."""

    bounds: list[tuple[int, int]]
    segments: list[tuple[int, int]]  # first token, token after the last
    features: np.ndarray


def _segments(text: str, bounds: list[tuple[int, int]], low: int, high: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The candidate segments that begin at the tokens from low up to high, and their features."""
    segments, rows = [], []
    for i in range(low, min(high, len(bounds))):
        a = bounds[i][0]
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        seen = mail = 0
        for j in range(i, min(i + MAX_TOKENS, len(bounds))):
            first, last = bounds[j]
            seen += last - first if text[first].isdigit() else 0
            mail = mail or text[first] == "@" or (last - first == 2 and text[first:last].lower() == "at")
            if text[last - 1].isalnum() and (seen >= 7 or mail or (seen >= 4 and "." in text[a:last])):
                segments.append((i, j + 1))
                rows.append(span_features(text, a, last))
    return segments, np.array(rows, np.float32).reshape(-1, len(FEATURES))


def lattice(text: str, start: int, end: int) -> Region:
    bounds = [m.span() for m in _TOKEN.finditer(text, start, end)]
    return Region(bounds, *_segments(text, bounds, 0, len(bounds)))


# ---- the CRF

OUTSIDE = len(KINDS)  # the label of a token that is in no entity


@dataclass(frozen=True)
class Weights:
    """Of the features of each kind, and of a label (row) directly before another (column); outside after outside scores 0."""

    features: np.ndarray
    follows: np.ndarray

    @classmethod
    def zero(cls) -> Weights:
        return cls(np.zeros((len(KINDS), len(FEATURES))), np.zeros((len(KINDS) + 1, len(KINDS) + 1)))

    def map(self, f, *others: Weights) -> Weights:
        """f of the parts, one by one."""
        return Weights(f(self.features, *(o.features for o in others)), f(self.follows, *(o.follows for o in others)))


def decode(text: str, start: int, end: int, weights: Weights) -> list[Span]:
    """The best segmentation of a region: (kind, start, end).

    Segments are scored in chunks of the tokens that they begin at, in order: once a chunk is scored, all that ends in
    it is known, and what ends later waits. So a region of any length is decoded as one, without its whole lattice in memory.
    """
    bounds = [m.span() for m in _TOKEN.finditer(text, start, end)]
    n, follows = len(bounds), weights.follows
    least = 2 * (follows.min() - follows.max())  # a segment that scores less never beats leaving its tokens out
    best = [[-np.inf] * (OUTSIDE + 1) for _ in range(n + 1)]
    back: list[list[tuple[int, int] | None]] = [[None] * (OUTSIDE + 1) for _ in range(n + 1)]  # where the segment began, the label before
    best[0][OUTSIDE] = 0.0
    into: dict[int, tuple[list[float], list[int]]] = {}

    def arrive(i: int) -> tuple[list[float], list[int]]:
        """The best score of what ends before token i and goes on with each label, and the label it ends with."""
        if i not in into:
            total = np.array(best[i])[:, None] + follows
            into[i] = total.max(axis=0).tolist(), total.argmax(axis=0).tolist()
        return into[i]

    ending: dict[int, list[tuple[int, int, float]]] = {}
    for low in range(0, n, _CHUNK):
        segments, features = _segments(text, bounds, low, low + _CHUNK)
        scores = features @ weights.features.T
        for s, k in np.argwhere(scores > least).tolist():
            i, j = segments[s]
            ending.setdefault(j, []).append((i, k, float(scores[s, k])))
        for j in range(low + 1, min(low + _CHUNK, n) + 1):
            score, label = arrive(j - 1)
            best[j][OUTSIDE], back[j][OUTSIDE] = score[OUTSIDE], (j - 1, label[OUTSIDE])
            for i, k, s in ending.pop(j, ()):
                score, label = arrive(i)
                if score[k] + s > best[j][k]:
                    best[j][k], back[j][k] = score[k] + s, (i, label[k])
            into.pop(j - MAX_TOKENS - 1, None)
    out, j, kind = [], n, max(range(OUTSIDE, -1, -1), key=lambda k: best[n][k])
    while j:
        i, before = back[j][kind]
        if kind != OUTSIDE:
            out.append((kind, bounds[i][0], bounds[j - 1][1]))
        j, kind = i, before
    return out[::-1]


def _likelihood(region: Region, truth: set[tuple[int, int, int]], weights: Weights) -> tuple[float, Weights]:
    """Log likelihood of the true segmentation, and its gradient."""
    n = len(region.bounds)
    scores = region.features @ weights.features.T
    odds, follows = np.exp(np.clip(scores, -40, 40)), np.exp(weights.follows)
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for s, (i, j) in enumerate(region.segments):
        by_end.setdefault(j, []).append(s)
        by_start.setdefault(i, []).append(s)
    ahead, arrive = np.zeros((n + 1, OUTSIDE + 1)), np.zeros((n + 1, OUTSIDE + 1))
    ahead[0, OUTSIDE] = 1
    arrive[0] = follows[OUTSIDE]
    for j in range(1, n + 1):
        ahead[j, OUTSIDE] = arrive[j - 1, OUTSIDE]
        for s in by_end.get(j, ()):
            ahead[j, :OUTSIDE] += arrive[region.segments[s][0], :OUTSIDE] * odds[s]
        arrive[j] = ahead[j] @ follows
    behind, leave = np.ones((n + 1, OUTSIDE + 1)), np.zeros((n + 1, OUTSIDE + 1))  # after a label; of the labels that begin
    for i in range(n - 1, -1, -1):
        leave[i, OUTSIDE] = behind[i + 1, OUTSIDE]
        for s in by_start.get(i, ()):
            leave[i, :OUTSIDE] += odds[s] * behind[region.segments[s][1], :OUTSIDE]
        behind[i] = follows @ leave[i]
    total = ahead[n].sum()
    gradient = Weights(np.zeros_like(weights.features), -follows * np.einsum("iy,iz->yz", ahead[:n], leave[:n]) / total)
    value = -float(np.log(total))
    if region.segments:
        first, last = np.array(region.segments).T
        share = arrive[first, :OUTSIDE] * odds * behind[last, :OUTSIDE] / total
        gradient.features[:] -= share.T @ region.features
    where = {segment: s for s, segment in enumerate(region.segments)}
    at, label = 0, OUTSIDE
    for k, i, j in [*sorted((t for t in truth if t[1:] in where), key=lambda t: t[1]), (OUTSIDE, n, n)]:
        for now in [*[OUTSIDE] * (i - at), *([k] if k != OUTSIDE else [])]:
            value += weights.follows[label, now]
            gradient.follows[label, now] += 1
            label = now
        at = j
        if k != OUTSIDE:
            value += scores[where[i, j], k]
            gradient.features[k] += region.features[where[i, j]]
    gradient.follows[OUTSIDE, OUTSIDE] = 0
    return float(value), gradient


def train(examples: list[tuple[str, list[Span]]], epochs: int = 20, rate: float = 0.15, ridge: float = 2e-4) -> Weights:
    """Weights by Adam on the regularised likelihood of the examples' regions."""
    data = []
    for text, spans in examples:
        for start, end in regions(text):
            region = lattice(text, start, end)
            if region.segments:
                starts = {a: i for i, (a, _) in enumerate(region.bounds)}
                ends = {b: i + 1 for i, (_, b) in enumerate(region.bounds)}
                truth, free = set(), 0
                for k, a, b in sorted(spans, key=lambda span: span[1:]):  # of overlapping spans the first
                    if a in starts and b in ends and starts[a] >= free:
                        truth.add((k, starts[a], ends[b]))
                        free = ends[b]
                data.append((region, truth))
    weights, mean, square, step = Weights.zero(), Weights.zero(), Weights.zero(), 0
    order = random.Random(7)
    for _ in range(epochs):
        order.shuffle(data)
        for at in range(0, len(data), 32):
            batch = data[at : at + 32]
            found = [_likelihood(region, truth, weights)[1] for region, truth in batch]
            gradient = weights.map(lambda w, *gs: sum(gs) / len(gs) - ridge * w, *found)
            step += 1
            mean = mean.map(lambda m, g: 0.9 * m + 0.1 * g, gradient)
            square = square.map(lambda q, g: 0.99 * q + 0.01 * g**2, gradient)
            weights = weights.map(
                lambda w, m, q, n=step: w + rate * (m / (1 - 0.9**n)) / (np.sqrt(q / (1 - 0.99**n)) + 1e-8), mean, square)
    return weights


def generated_examples(n: int = 900, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Sentences with entities in many forms, and with numbers that are none."""
    rng = random.Random(seed)

    def digits(k):
        return "".join(rng.choice("0123456789") for _ in range(k))

    def word():
        return "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9)))

    def card(k=16):
        body = digits(k - 1)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def email():
        user, host, end = word() + rng.choice(["", ".", "_"]) + rng.choice(["", digits(2)]) + word(), word(), rng.choice(["com", "org", "net", "example.com"])
        if rng.random() < 0.5:
            return f"{user}@{host}.{end}"
        at, dot = rng.choice([("[at]", "[dot]"), ("(at)", "(dot)"), ("[at]", "."), ("(at)", ".")])
        gap = rng.choice(["", " "])
        return f"{user}{gap}{at}{gap}{host}" + (f"{gap}{dot}{gap}" if dot != "." else ".") + end

    def phone():
        a, b, c = str(rng.randint(200, 999)), digits(3), digits(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"{a} {b} {c}"])

    def number():
        return rng.choice([
            lambda: digits(rng.randint(1, 6)), lambda: digits(rng.randint(7, 15)), lambda: f"{rng.randint(1950, 2039)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
            lambda: f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1950, 2039)}", lambda: f"{rng.randint(0, 23):02}:{digits(2)}:{digits(2)}",
            lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}", lambda: f"{rng.randint(1, 999)},{digits(3)}.{digits(2)}",
            lambda: f"{rng.randint(256, 999)}.{rng.randint(0, 999)}.{rng.randint(256, 999)}.{rng.randint(0, 999)}",
            lambda: next(d for d in iter(lambda: digits(16), None) if not luhn(d)), lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
            lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)), lambda: f"@{word()}", lambda: f"{word()}{digits(2)}",
            lambda: f"{digits(5)}-{digits(5)}", lambda: f"{digits(2)}-{digits(7)}", lambda: " ".join(digits(rng.randint(1, 5)) for _ in range(rng.randint(2, 7)))])()

    def entity():
        kind = rng.randrange(4)
        if kind == 0:
            return 0, email()
        if kind == 1:
            return 1, ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == 2:
            d, mark = card(), rng.choice(["", " ", "-", "."])
            return 2, mark.join(d[i : i + 4] for i in range(0, 16, 4))
        return 3, phone()

    hints = {0: ["mail", "contact"], 1: ["host", "server"], 2: ["card", "visa"], 3: ["tel", "call", "phone"]}
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(rng.randint(1, 4))) + " ", []
        for _ in range(rng.randint(1, 3)):
            if rng.random() < 0.5:
                kind, form = entity()
                if rng.random() < 0.3:
                    text += rng.choice(hints[kind]) + rng.choice([" ", ": "])
                spans.append((kind, len(text), len(text) + len(form)))
                text += form
            else:
                text += number()
            text += rng.choice([" ", ". ", ", "]) + " ".join(word() for _ in range(rng.randint(1, 3))) + " "
        out.append((text, spans))
    return out


def _least(size: int):
    """For mapInArrow: the `size` distinct strings of least hash that a task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            held |= {piece: xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass")) for piece in batch.column(0).to_pylist()}
            if len(held) > 2 * size:
                held = dict(sorted(held.items(), key=lambda item: (item[1], item[0]))[:size])
        kept = sorted(held.items(), key=lambda item: (item[1], item[0]))[:size]
        yield pa.RecordBatch.from_arrays([pa.array([piece for piece, _ in kept], pa.string())], ["piece"])

    return run


def fit(docs: DataFrame, text_col: str = "text") -> Weights:
    """The CRF's weights, from a bounded sample of the texts' regions and generated examples."""
    ship_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                found = []
                for text in batch.column(0):
                    value = text.as_py() or ""
                    found += (value[max(0, start - 24) : end + 8] for start, end in regions(value) if end - start <= SAMPLE_LENGTH)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["piece"])

        yield from _least(SAMPLE)(pieces())
        release()

    kept = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(cut, "piece string")
    kept = kept.repartition("piece").mapInArrow(_least(SAMPLE), "piece string").repartition(8, "piece").mapInArrow(_least(SAMPLE), "piece string")
    held = sorted((r.piece for r in kept.collect()), key=lambda piece: (xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass")), piece))
    return train([*((piece, base_spans(piece)) for piece in held[:SAMPLE]), *generated_examples()])


def merged_spans(base: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, in order and apart from each other."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def added_spans(text: str, base: list[Span], weights: Weights) -> list[Span]:
    """What the CRF finds beside the patterns: spans that overlap none of theirs."""
    out = []
    starts, ends = merged_spans(base)
    for start, end in regions(text):
        for kind, a, b in decode(text, start, end, weights):
            before = bisect.bisect_left(starts, b) - 1  # the last that begins before the span ends
            if before < 0 or ends[before] <= a:
                out.append((kind, a, b))
    return out


def all_spans(text: str, weights: Weights) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and these with the CRF's, by kind and start."""
    base = base_spans(text)
    return base, sorted({*base, *added_spans(text, base, weights)})


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


def find(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the patterns' counts and hash, and all spans."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, spans = [[], [], [], []], [], []
            for text in batch.column(1):
                base, every = all_spans(text.as_py() or "", weights)
                for kind in range(4):
                    counts[kind].append(sum(k == kind for k, _, _ in base))
                hashes.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
        release()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, SCHEMA)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span (overlapping ones together) replaced by the kind of the first."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            out += text[at:start], f"<{KINDS[kind].upper()}>"
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weights: Weights, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs, all columns, with personal data replaced in the texts and the number of characters brought up to date."""
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)
    count = docs.columns.index(chars_col) if chars_col in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts, changed = list(batch.columns), [], {}
            for row, text in enumerate(batch.column(at).to_pylist()):
                spans = all_spans(text, weights)[1] if text else []
                texts.append(redacted(text, spans) if spans else text)
                if spans:
                    changed[row] = len(texts[-1])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if count >= 0 and changed:
                sizes = columns[count].to_pylist()
                for row, n in changed.items():
                    sizes[row] = n
                columns[count] = pa.array(sizes, batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
        release()

    return docs.mapInArrow(run, docs.schema)
