"""Near-duplicate detection with bottom-k sketches from one hash function.

1. One pass hashes every text's distinct shingles; the k least are its sketch.
   Texts whose word sequences are equal form a class, which goes on as one.
2. Every retained value has an inverted list of the classes that hold it. Of the
   k least values of two similar sets' union at least ``s`` are in both, and so
   in both sketches (a certainty for sets of up to k shingles; larger sets share
   fewer with a chance below ``CHANCE`` a link, from which ``s`` follows), so they
   share one among the first ``k - s + 1`` values of either sketch in any common
   order. The order is by the number of classes that hold the value: values that
   nobody shares drop out, and lists of passages that many texts quote are entered
   only by texts that consist of little else. Lists are split by set size, since
   similar sets have similar sizes.
3. Within a list the union sketch's estimate connects the classes that can be
   similar, those that share ``s`` of its k values; sets of up to k shingles are
   their own sketches, which decides by their exact Jaccard. Connected classes
   form clusters: no link leaves one.
4. Clusters get the full shingle sets, and exact Jaccard links their classes, as
   products of shingle incidence matrices.
5. Components of the links give each text the smallest id that it can reach.

Steps 3 and 4 deal lists and clusters of any length out alike, as tiles of
bounded size. First every tile meets the first one (a random part of the
members). What is connected to that tile's largest group is connected with each
other; only the rest, if any, then meets all tiles. So a group of m near copies
costs about 2 m rows, not m squared, and all pairs of which one is in no such
group are still compared. What is emitted is a forest of the connections.

Nothing is capped. A link is lost only by the chance named in 2.

Edge cases: texts that are null or have no words have no set, link with nothing
and are kept; texts with fewer words than a shingle are one shingle; a null id
never is the smallest unless all ids of a component are null, and is kept only
then; repeated rows are copies of each other; ties in size or hash don't matter;
an empty table gives an empty result; extra columns are ignored by
``find_duplicates`` and returned by ``keep_first``.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, release, ship_package
from .components import apart, connected_components

SHINGLE, PERCENT = 5, 80
CHANCE = 1e-9  # of losing a link between two large sets
TILE = 128  # members of a list that are compared together with as many others
BLOCK, BLOCK_SHINGLES = 256, 1 << 18  # the same of a cluster
_UNSIGNED = (1 << 64) - 1
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MULTIPLIERS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                                       0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


@functools.lru_cache
def sketch_size(percent: int) -> tuple[int, int]:
    """k, and how many of the k least values of their union two similar sets share, but for CHANCE."""
    k, p = 32, percent / 100
    while True:
        below = 0.0
        for shared in range(k + 1):
            below += math.comb(k, shared) * p**shared * (1 - p) ** (k - shared)
            if below > CHANCE:
                break
        if shared >= k // 8:
            return k, shared
        k *= 2


# ---- sets and sketches

def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes split at space and \t to \r only


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    short = min(size, len(words))
    n = len(words) - short + 1
    mixed = sum(ids[i : i + n] * _MULTIPLIERS[i] for i in range(short)) + np.uint64(short)
    return np.unique(_mix(mixed))


def fingerprint(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


_ROWS = "doc_id long, n_shingles long, fp binary, sketch array<long>"


def sketch_rows(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Id, set size, fingerprint of the word sequence and sketch of each row."""
    ship_package(docs.sparkSession)
    k, _ = sketch_size(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, sketches = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                found = shingle_set(words, size)
                sizes.append(len(found))
                prints.append(fingerprint(words) if words else None)
                sketches.append(found[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "fp", "sketch"])
        release()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, _ROWS)


# ---- tiles

class Groups:
    """Union-find over the members of a tile, which remembers the edges that joined groups."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((i, j))

    def rest(self, leads: int, first: bool) -> list[int]:
        """Members that are not connected to the largest group of the leads, who come first; of the leads themselves only in the first tile."""
        roots = [self.root(i) for i in range(len(self.parent))]
        main = max(set(roots[:leads]), key=lambda r: (roots[:leads].count(r), -r))
        return [i for i in range(0 if first else leads, len(roots)) if roots[i] != main]


def _meet_first(members: DataFrame, *key: str) -> DataFrame:
    """Each tile of a group with the group's first tile: (*key, again, part, node, lead). members: *key, node, tile, tiles."""
    lead = F.col("tile") == 0
    parts = F.when(lead, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("tile"))
    return members.select(*key, F.lit(-1).alias("again"), F.explode(parts).alias("part"), "node", lead.alias("lead"), (F.col("tiles") > 1).alias("tiled"))


def _meet_rest(members: DataFrame, rest: DataFrame, size: int, *key: str) -> DataFrame:
    """Tiles of what the first meeting left over, with all tiles of their group."""
    left = rest.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("agains"))
    every = members.join(apart(left), list(key)).select(
        *key, F.explode(F.sequence(F.lit(0), F.col("agains") - 1)).alias("again"), F.col("tile").alias("part"), "node", F.lit(False).alias("lead"))
    tiles = members.groupBy(*key).agg(F.max("tiles").alias("tiles"))
    leads = rest.join(apart(left.join(tiles, list(key))), list(key)).select(
        *key, F.pmod(F.xxhash64("node"), F.col("agains")).cast("int").alias("again"),
        F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("part"), "node", F.lit(True).alias("lead"))
    return every.unionByName(leads).withColumn("tiled", F.lit(False))


def _met(members: DataFrame, size: int, compare: Callable[[DataFrame, DataFrame | None], DataFrame], *key: str) -> DataFrame:
    """Edges (a, b) from comparing the members of each group, tile by tile.

    compare: takes rows (*key, again, part, node, lead, tiled), and of which groups (None: all), and returns (*key, a, b);
    b null: a is left over.
    """
    members = materialise(members, "members")
    found = materialise(compare(_meet_first(members, *key), None), "met")
    rest = found.where("b IS NULL").select(*key, F.col("a").alias("node"))
    edges = found.where("b IS NOT NULL").select("a", "b")
    if rest.isEmpty():
        return edges
    again = compare(_meet_rest(members, rest, size, *key), rest.select(*key).distinct())
    return edges.unionByName(again.where("b IS NOT NULL").select("a", "b"))


# ---- candidates

def _prefix_length(n: Column, percent: int) -> Column:
    """How many of a sketch's values, rarest first, must be looked at."""
    k, shared = sketch_size(percent)
    share = percent / 100
    cut = F.greatest(F.lit(0), F.floor(n / share) - k)  # of a partner's set, this many values may not be in its sketch
    whole = n - (F.ceil(n * share - 1e-9) - cut) + 1
    return F.when(n <= k, F.least(n, whole)).otherwise(k - shared + 1).cast("int")


def _size_class(n: Column, percent: int) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent)).cast("int")


def union_share(a: frozenset[int], b: frozenset[int], k: int) -> int:
    """How many of the k least values of the union of two sketches are in both: k times the estimate of their Jaccard."""
    return sum(v in a and v in b for v in sorted(a | b)[:k])


def _overlaps(percent: int):
    """For mapInArrow: a forest of the pairs in a tile that may be similar by their union sketch, or are, where the sketches are the sets."""
    k, shared = sketch_size(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v, sizes, again, part, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = {}
                for m in sorted(members, key=lambda m: (not m["lead"], m["node"])):
                    held.setdefault(m["node"], m)
                nodes = list(held)
                sketches = [frozenset(x & _UNSIGNED for x in m["sketch"]) for m in held.values()]
                n = [m["n"] for m in held.values()]
                leads = sum(m["lead"] for m in held.values())
                groups, together = Groups(len(nodes)), []  # the leads' groups

                def similar(i, j, sketches=sketches, n=n):
                    both = len(sketches[i] & sketches[j])
                    if max(n[i], n[j]) <= k:  # the sketches are the sets
                        return 100 * both >= percent * (n[i] + n[j] - both)
                    return both >= shared and union_share(sketches[i], sketches[j], k) >= shared

                for j in range(len(nodes)):
                    near = [i for i in (next((i for i in group if similar(i, j)), None) for group in together) if i is not None]
                    for i in near:
                        groups.join(i, j)
                    if j < leads:
                        met = [group for group in together if groups.root(group[0]) == groups.root(j)]
                        together = [group for group in together if groups.root(group[0]) != groups.root(j)] + [[*sum(met, []), j]]
                out += ((v, sizes, nodes[j], nodes[i]) for i, j in groups.edges)
                if again < 0 and members[0]["tiled"]:
                    out += ((v, sizes, nodes[i], None) for i in groups.rest(leads, part == 0))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["v", "sizes", "a", "b"])
        release()

    return run


def candidate_clusters(classes: DataFrame, percent: int) -> DataFrame:
    """(node, root) for the classes that may be similar to another."""
    k, _ = sketch_size(percent)
    held = classes.select("node", "n", F.explode("sketch").alias("v"))
    shared = held.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = held.join(apart(shared), "v").groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "v"))).alias("values"))
    room = _prefix_length(F.col("n"), percent) - (F.least(F.col("n"), F.lit(k)) - F.size("values"))
    first = common.select("node", "n", F.explode(F.slice("values", 1, F.greatest(room, F.lit(0)).cast("int"))).alias("at"))
    size = _size_class(F.col("n"), percent)
    listed = materialise(first.select("node", F.col("at.v").alias("v"), F.explode(F.array(size, size + 1)).alias("sizes")), "lists")
    lengths = listed.groupBy("v", "sizes").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    tiles = F.ceil(F.col("length") / TILE).cast("int")
    members = listed.join(apart(lengths), ["v", "sizes"]).select(
        "v", "sizes", "node", tiles.alias("tiles"), F.pmod(F.xxhash64("node"), tiles).cast("int").alias("tile"))

    def compare(dealt: DataFrame, _: DataFrame | None) -> DataFrame:
        tile = dealt.join(classes.select("node", "n", "sketch"), "node").groupBy("v", "sizes", "again", "part").agg(
            F.collect_list(F.struct("node", "lead", "tiled", "n", "sketch")).alias("members"))  # about two tiles at most
        return tile.mapInArrow(_overlaps(percent), "v long, sizes int, a long, b long")

    return connected_components(_met(members, TILE, compare, "v", "sizes"))


# ---- verification

def similar_pairs(sets: list[np.ndarray], percent: int, leads: int) -> np.ndarray:
    """Index pairs (i < j, i among the first `leads`) of the sets with 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) < 12:
        found = []
        for j in range(1, len(sets)):
            for i in range(min(j, leads)):
                low, high = sorted((sizes[i], sizes[j]))
                if 100 * low >= percent * high:
                    inter = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * inter >= percent * (low + high - inter):
                        found.append((i, j))
        return np.array(found, np.int64).reshape(-1, 2)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = count > 1
    renumber = np.cumsum(often) - 1
    row, column = row[often[column]], renumber[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    inter = np.zeros((leads, len(sets)), np.float32)  # counts below 2^24 are exact
    width = max(1, (1 << 24) // (4 * len(sets)))
    for start in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        tile = np.zeros((len(sets), width), np.float32)
        tile[row[lo:hi], column[lo:hi] - start] = 1
        inter += tile[:leads] @ tile.T
    inter = inter.astype(np.int64)
    return np.argwhere(np.triu(100 * inter >= percent * (sizes[:leads, None] + sizes[None, :] - inter), 1))


def _verify(percent: int):
    """For applyInArrow: a forest of the links in a tile of a cluster."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("node").to_pylist(), table.column("lead").to_pylist(), range(len(table)), strict=True), key=lambda r: (not r[1], r[0]))
        held: dict[int, tuple[bool, int]] = {}
        for node, lead, at in rows:
            held.setdefault(node, (lead, at))
        nodes, leads = list(held), sum(lead for lead, _ in held.values())
        values = table.column("hashes")
        sets = [np.frombuffer(values[at].as_buffer(), np.uint64) for _, at in held.values()]
        groups = Groups(len(nodes))
        for i, j in similar_pairs(sets, percent, leads):
            groups.join(int(i), int(j))
        if len(sets) > BLOCK // 2:
            release()
        out = [(nodes[j], nodes[i]) for i, j in groups.edges]
        if table.column("again")[0].as_py() < 0 and table.column("tiled")[0].as_py():
            out += ((nodes[i], None) for i in groups.rest(leads, table.column("part")[0].as_py() == 0))
        root = table.column("root")[0].as_py()
        return pa.table({"root": pa.array([root] * len(out), pa.int64()), "a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _cluster_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, hashes) for the wanted classes (node, id, fp): the full sets, from the texts."""
    # a table of its own: so Spark knows its size and shuffles the texts only where the ids are too many to broadcast
    ids = materialise(wanted.select(F.col("id").alias("wanted_id")).distinct(), "wanted")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen = chosen.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, hashes = [], []
            for text in batch.column(0):
                words = words_of(text.as_py())
                if words:
                    prints.append(fingerprint(words))
                    hashes.append(shingle_set(words, size).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(hashes, pa.binary())], ["fp", "hashes"])
        release()

    return chosen.mapInArrow(run, "fp binary, hashes binary").join(wanted.select("fp", "node"), "fp").select("node", "hashes")


def find_links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(node, root) of the classes that are linked to another one."""
    clusters = materialise(candidate_clusters(classes, percent).join(classes.select("node", "id", "n", "fp"), "node"), "clusters")
    total = clusters.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("tiles"))
    members = clusters.join(apart(total), "root").select("root", "node", "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"))

    def compare(dealt: DataFrame, roots: DataFrame | None) -> DataFrame:
        wanted = clusters if roots is None else clusters.join(roots, "root", "left_semi")
        return dealt.join(_cluster_sets(docs, wanted, id_col, text_col, size), "node").groupBy("root", "again", "part").applyInArrow(
            _verify(percent), "root long, a long, b long")

    return connected_components(_met(members, BLOCK, compare, "root"))


def find_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT,
                    with_fingerprint: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    rows = materialise(sketch_rows(docs, id_col, text_col, size, percent).withColumn("row_id", F.monotonically_increasing_id()), "sketches")
    classes = materialise(rows.where("fp IS NOT NULL").groupBy("fp").agg(
        F.min("row_id").alias("node"), F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    linked = materialise(find_links(docs, classes, id_col, text_col, size, percent), "linked")
    least = classes.join(linked, "node").groupBy("root").agg(F.min("id").alias("least"))
    reached = linked.join(least, "root").select("node", "least")
    named = classes.select("fp", "node", "id").join(reached, "node", "left").select("fp", F.coalesce("least", "id").alias("least"))
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    out = rows.select("doc_id", "n_shingles", "fp").join(named, "fp", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "fp")
    return out if with_fingerprint else out.drop("fp")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, of which one stays of each component: the one with its smallest id."""
    found = materialise(find_duplicates(docs, id_col, text_col, size, percent, with_fingerprint=True), "duplicates")
    repeated = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if not repeated:
        gone = materialise(found.where("NOT kept").select(F.col("doc_id").alias("gone_id")), "gone")  # its own size decides the join
        return docs.join(gone, docs[id_col].cast("long").eqNullSafe(F.col("gone_id")), "left_anti")
    # ids repeat: a row is known by its id and its words, and of equal rows one stays
    ship_package(docs.sparkSession)
    at, name = docs.columns.index(text_col), f"__fp_{len(docs.columns)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(text.as_py()) for text in batch.column(at)]
            prints = pa.array([fingerprint(w) if w else None for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], [*batch.schema.names, name])

    marked = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))
    kept = found.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("fp").alias("kept_fp")).distinct()
    stay = marked.join(kept, marked[id_col].cast("long").eqNullSafe(F.col("kept_id")) & marked[name].eqNullSafe(F.col("kept_fp")), "left_semi")
    empty = stay.where(F.col(name).isNull())  # texts without words are linked with nothing: each stays
    return stay.where(F.col(name).isNotNull()).dropDuplicates([id_col, name]).unionByName(empty).drop(name)
