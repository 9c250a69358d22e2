"""Exact duplicates, fill-in-middle and spelling variants against brute force, and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import exact_dedup, fim, spelling

DOCS = "doc_id long, text string"
BLANK = "\x20\x09-\x0d"


def with_clashes(df):
    for name in ("id", "digest", "keep_id", "group_size", "kept", "n", "form", "output", "word", "run", "h", "root"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    long = "lorem ipsum \n é " * 30_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (None, "no id"), (None, "no  id"), (5, "same words here"), (5, "same words here"), (6, "same\twords\nhere"),
            (7, " same words here"), (8, "é — 漢字 \U0001f600 <P> sentinel"), (9, "<|endoftext|> < P > <S <M\n>"), (10, long + "x")]
    return with_clashes(spark.createDataFrame(rows, DOCS))


# ---- op11

def brute_copies(rows):
    digest = lambda text: hashlib.sha256(re.sub(f"[{BLANK}]+", " ", text or "").encode()).hexdigest()
    groups = {}
    for i, text in rows:
        groups.setdefault(digest(text), []).append(i)
    out = []
    for i, text in rows:
        own = groups[digest(text)]
        least = min((x for x in own if x is not None), default=None)
        out.append((i, least, len(own), i == least, digest(text)))
    return sorted(map(str, out))


def test_copies_match_brute_force(spark, odd):
    rng = random.Random(4)
    texts = [f"text  number {rng.randrange(200)}" for _ in range(600)] + ["hot   text"] * 500 + [f"alone {i}" for i in range(400)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    assert sorted(str(tuple(r)) for r in exact_dedup.mark_copies(docs).collect()) == brute_copies(rows)
    assert sorted(str(tuple(r)) for r in exact_dedup.mark_copies(odd).collect()) == brute_copies([(r.doc_id, r.text) for r in odd.collect()])
    assert exact_dedup.mark_copies(odd.limit(0)).count() == 0


def test_heavy_hitters_are_found_and_exact(spark):
    """Whatever the order and the partitions, what holds more than 1 / counters of the rows is among at most that many."""
    rng = random.Random(5)
    rows = [f"{i % 3}" for i in range(300)] + [f"x{i}" for i in range(700)]
    rng.shuffle(rows)
    keyed = spark.createDataFrame(list(enumerate(rows)), "id long, t string").select("id", exact_dedup.digest_of(F.col("t")).alias("digest"))
    want = {bytearray(hashlib.sha256(str(k).encode()).digest()).hex(): (100, rows.index(str(k))) for k in range(3)}
    for partitions in (1, 5, 40):
        heavy = exact_dedup.heavy_hitters(keyed.repartition(partitions), 20).collect()
        assert len(heavy) <= 20
        found = {r.digest.hex(): (r.group_size, r.keep_id) for r in heavy}
        assert {k: found.get(k) for k in want} == want


def test_light_and_heavy_paths_agree(spark):
    """The same verdicts whether a group is settled by broadcast or by shuffle."""
    rows = [(i, "a" if i % 2 else f"b{i % 7}") for i in range(200)]
    keyed = exact_dedup._keyed(spark.createDataFrame(rows, DOCS), "doc_id", "text")
    whole = exact_dedup.heavy_hitters(keyed, 100)
    settled = [sorted(map(str, exact_dedup._settled(keyed, heavy).collect())) for heavy in (whole, whole.limit(0))]
    assert settled[0] == settled[1] and len(settled[0]) == 200


def test_drop_copies_keeps_the_columns_and_the_winners(spark, odd):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    want = exact_dedup.mark_copies(odd).where("kept")
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, (r.doc_id for r in want.collect())))
    many = spark.createDataFrame([(i, "copy" if i % 3 else f"own {i}") for i in range(90)], DOCS)
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(many).collect()) == sorted({1, *range(0, 90, 3)})


def test_copies_run_no_python(spark, odd):
    plan = exact_dedup.mark_copies(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# ---- op12

def brute_form(doc_id, text):
    text = text or ""
    units = re.findall(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[at : at + 8], 16) for at in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_forms_match_brute_force_and_restore(spark, odd):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab \n\t<P>SMéß漢\U0001f600\xa0\x1c\x0b") for _ in range(rng.choice((3, 40, 255, 256, 257, 700))))) for i in range(300)]
    rows += [(900 + i, ("word " * 60 + " " * 300 + "é" * 300)[i:]) for i in range(40)]  # units longer than a lane
    docs = with_clashes(spark.createDataFrame(rows, DOCS).repartition(3)).unionByName(odd)
    held = [(r.doc_id, r.text) for r in docs.collect()]
    made = fim.transform(docs)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda row: (str(row[0]), str(row[-1]))
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((brute_form(*row) for row in held), key=key)
    assert sorted((str(r.doc_id), r.back) for r in got) == sorted((str(i), t or "") for i, t in held)
    assert {r.form for r in got} == {"plain", "psm", "spm"} and fim.transform(docs.limit(0)).count() == 0


@pytest.mark.parametrize("lane", [3, 4, 7, 64])
def test_lanes_of_any_length_scan_alike(monkeypatch, lane):
    monkeypatch.setattr(fim, "LANE", lane)
    rng = random.Random(lane)
    texts = ["".join(rng.choice("ab <P>é\n") for _ in range(rng.randrange(60))) for _ in range(100)]
    data, starts = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    scan = fim.Scan(data, starts)
    for i, text in enumerate(texts):
        units = re.findall(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+", text)
        assert (scan.units[i], scan.text_chars[i], scan.has_sentinel[i]) == (len(units), len(text), "<P>" in text)
        every = np.arange(len(units) + 1)
        place, chars = scan.cut(np.full(len(every), i), every)
        heads = ["".join(units[:k]) for k in every]
        assert place.tolist() == [len(h.encode()) for h in heads] and chars.tolist() == [len(h) for h in heads]


# ---- op13

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(count):
    found = {w: sorted((v for v in count if v != w and near(v, w)), key=lambda v: (-count[v], v)) for w in count}
    form = {w: v[0] if v and count[v[0]] >= 2 * count[w] else None for w, v in found.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(str((w, form[w], root(w), n, len(found[w]), count[form[w]] if form[w] else None)) for w, n in count.items())


def brute_words(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def test_wavelet_tree_reports_rectangles():
    rng = random.Random(7)
    for n in (1, 2, 3, 8, 50, 257):
        points = np.array(rng.sample(range(n), n))
        tree = spelling.WaveletTree(points)
        a, b, c, d = (np.array([rng.randint(0, n) for _ in range(150)]) for _ in range(4))
        query, value = tree.report(a, b, c, d)
        want = sorted((k, int(points[i])) for k in range(150) for i in range(n) if a[k] <= i < b[k] and c[k] <= points[i] < d[k])
        assert sorted(zip(query.tolist(), value.tolist(), strict=True)) == want


@pytest.mark.parametrize("entries", [10_000, 8])
def test_variants_match_brute_force(spark, monkeypatch, entries):
    """Dense words over few letters, with many edits between them, in one block a length and in many."""
    monkeypatch.setattr(spelling, "BLOCK_ENTRIES", entries)
    rng = random.Random(8)
    count = {}
    while len(count) < 400:
        count["".join(rng.choice("aaabÿé") for _ in range(rng.choice((5, 5, 6, 6, 7, 8, 13))))] = rng.choice((3, 4, 5, 7, 11, 20, 60, 60, 200))
    words = spark.createDataFrame(list(count.items()), "word string, n long")
    assert sorted(str(tuple(r)) for r in spelling.group_variants(words).collect()) == brute_variants(count)


def test_words_and_variants_of_texts(spark, odd):
    rng = random.Random(9)
    stock = ["".join(rng.choice("aeioubcdlmnrstÉéß×") for _ in range(rng.randint(3, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(stock).title() if rng.random() < 0.2 else rng.choice(stock) for _ in range(120)) + ", x1y") for i in range(60)]
    docs = with_clashes(spark.createDataFrame(rows, DOCS)).unionByName(odd)
    held = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(str(tuple(r)) for r in spelling.spelling_variants(docs).collect()) == brute_variants(brute_words(held))
    assert spelling.spelling_variants(docs.limit(0)).count() == 0 and spelling.spelling_variants(docs.where("text IS NULL")).count() == 0
    whole = Counter(re.sub("[A-Z]", lambda m: m[0].lower(), w) for _, t in held for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    got = {r.word: r.n for r in spelling.vocabulary(spelling.corpus_words(docs, drop_every=0), 1, 1).collect()}
    assert got == dict(whole)


def test_roots_follow_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("v", "w5")], "word string, form string")
    assert {tuple(r) for r in spelling.roots_of(forms).collect()} == {(f"w{i}", "w37") for i in range(37)} | {("v", "w37")}


# ---- op10

def test_copies_of_a_query_are_cut_down_in_their_tasks(spark):
    """Two thousand copies of one vector, of which some are queries: each task gives k a query at most, the least ids."""
    from spanloom.llm import ann

    rows = [(i, [1.0, 2.0, 3.0]) for i in range(2000)] + [(5000 + i, [float(i), 0.5, -1.0]) for i in range(50)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    got = ann.nearest(vectors, vectors.where("vec_id IN (0, 700, 5003)"), k=4).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found[0] == [(1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0)] and found[700] == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0)]
    assert found[5003] == [(5002, 1.0), (5004, 1.0), (5001, 2.0), (5005, 2.0)]
