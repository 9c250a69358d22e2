"""URL filtering with a sorted digest array.

Rules (host, path, verdict) become one sorted array of 64-bit xxhash keys of
host and path plus the full strings, written to one index file. Executors get
the file through Spark, memory-map it, and probe it with a vectorised binary
search for every (host suffix, path prefix) of a batch of urls; a hit counts
only if the stored full string equals the probed one, so that colliding digests
cannot block anything. Path prefixes and host suffixes are probed at the lengths that rules have.

The longest fitting rule wins (host plus path in code points; of equally long
ones the one with the longer host). A url without a fitting rule gets the
operator's default verdict.

Edge cases: a null url, or one without ``://``, has an empty host and path,
which no rule fits (rules have a host); an empty rule list allows everything by default;
repeated rules count once, block before allow; repeated urls are judged alike;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .common import ship_package

SCHEMA = "page_id long, host string, path string, rule string, verdict string"
_MAGIC = b"SPURLIX1"
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    if not url or (start := url.find("://")) < 0:
        return "", ""
    start += 3
    end = min((i for i in (url.find(c, start) for c in "?#") if i >= 0), default=len(url))
    slash = url.find("/", start, end)
    cut = slash if slash >= 0 else end
    return url[start:cut].translate(_LOWER), url[cut:end]


def build_index(rules: Sequence[tuple[str, str, str]]) -> bytes:
    """The index file: header, host and path lengths, sorted keys, string offsets, strings, verdicts."""
    verdicts: dict[str, str] = {}
    for host, path, verdict in rules:
        name = host.translate(_LOWER) + "\0" + path
        verdicts[name] = "block" if "block" in (verdict, verdicts.get(name)) else "allow"
    names = sorted(verdicts, key=lambda name: xxhash.xxh64_intdigest(name))
    keys = np.array([xxhash.xxh64_intdigest(name) for name in names], "<u8")
    blobs = [name.encode() for name in names]
    offsets = np.cumsum([0, *map(len, blobs)]).astype("<u8")
    parts = [name.partition("\0") for name in names]
    hosts = np.array(sorted({len(host) for host, _, _ in parts}), "<u8")
    paths = np.array(sorted({len(path) for _, _, path in parts}), "<u8")
    blocked = np.array([verdicts[name] == "block" for name in names], "u1")
    head = _MAGIC + struct.pack("<QQQ", len(names), len(hosts), len(paths))
    return head + hosts.tobytes() + paths.tobytes() + keys.tobytes() + offsets.tobytes() + b"".join(blobs) + blocked.tobytes()


class Index:
    """A memory-mapped index file."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        if data[:8].tobytes() != _MAGIC:
            raise ValueError(f"{path} is no url index")
        n, n_hosts, n_paths = struct.unpack("<QQQ", data[8:32].tobytes())
        at = 32
        self.host_lengths = data[at : at + 8 * n_hosts].view("<u8").astype(int).tolist()
        at += 8 * n_hosts
        self.path_lengths = data[at : at + 8 * n_paths].view("<u8").astype(int).tolist()
        at += 8 * n_paths
        self.keys = data[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.offsets = data[at : at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        size = int(self.offsets[-1])
        self.strings = data[at : at + size]
        self.blocked = data[at + size : at + size + n]

    def find(self, names: list[bytes]) -> np.ndarray:
        """The entry of each name, or -1."""
        found = np.full(len(names), -1, np.int64)
        if not len(self.keys) or not names:
            return found
        keys = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            for j in range(at[i], len(self.keys)):  # equal digests stand next to each other
                if self.keys[j] != keys[i]:
                    break
                if self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes() == names[i]:
                    found[i] = j
                    break
        return found

    def judge(self, urls: list[str | None], default: str) -> list[tuple[str, str, str | None, str]]:
        parts = [split_url(url) for url in urls]
        names, owner, size = [], [], []
        for i, (host, path) in enumerate(parts):
            ends = [path[:n] for n in self.path_lengths if n <= len(path)]
            for n in self.host_lengths:
                if n == len(host) or (n < len(host) and host[-n - 1] == "."):
                    for end in ends:
                        names.append(f"{host[-n:]}\0{end}".encode("utf-8", "surrogatepass"))
                        owner.append(i)
                        size.append((n + len(end), n))
        best: dict[int, tuple[tuple[int, int], int, int]] = {}
        for k in np.flatnonzero((hits := self.find(names)) >= 0):
            if owner[k] not in best or size[k] > best[owner[k]][0]:
                best[owner[k]] = (size[k], k, hits[k])
        out = []
        for i, (host, path) in enumerate(parts):
            if i in best:
                _, k, entry = best[i]
                rule = names[k].decode("utf-8", "surrogatepass").replace("\0", "", 1)
                out.append((host, path, rule, "block" if self.blocked[entry] else "allow"))
            else:
                out.append((host, path, None, default))
        return out


def ship_index(spark, rules: Sequence[tuple[str, str, str]]) -> str:
    """Hands the index file to every executor; returns the name by which SparkFiles knows it."""
    data = build_index(rules)
    name = f"url-index-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="url-index-"), name)
    if name not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
        with open(path, "wb") as out:
            out.write(data)
        spark.sparkContext.addFile(path)
    return name


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow",
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict."""
    ship_package(pages.sparkSession)
    name = ship_index(pages.sparkSession, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(SparkFiles.get(name))
        for batch in batches:
            rows = index.judge(batch.column(1).to_pylist(), default)
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(column, pa.string()) for column in columns)],
                ["page_id", "host", "path", "rule", "verdict"])

    chosen = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"))
    return chosen.mapInArrow(run, SCHEMA)
