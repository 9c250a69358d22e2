"""Token counts of flat token files, by a separator scan.

A flat token file is nothing but little-endian token ids of a fixed width, each
document ended by an end-of-document id; there is no index. Files are cut into
blocks, which are read as byte ranges; one vectorised comparison finds a block's
separators. Each block gives the runs between its separators and the tokens left
after the last; a prefix scan over a file's blocks (counts of separators, and
tokens carried in since the last one) puts together the documents that cross
block borders, however many blocks they span.

``write_token_files`` makes such files from texts. A task writes one file under
a name of its attempt, and only the rows of the attempt that succeeded name
their file, so a lost executor leaves at most a file that nobody reads.

Edge cases: a document of no tokens counts 0; tokens after a file's last
separator are a document that is not closed; an empty file or no files give an
empty result; a file whose size is no multiple of the width is an error; null
texts are empty documents; a special token's string in a text is ordinary text,
so that texts cannot hold the separator; repeated rows count each; extra columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialise, release, ship_package
from .tokens import default_paths, encode_texts

END_OF_DOCUMENT = 50256
WIDTH = 2  # bytes: the vocabulary has less than 65536 ids
BLOCK_TOKENS = 4 << 20
_KINDS = {1: "u1", 2: "<u2", 4: "<u4"}


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_OF_DOCUMENT,
                      width: int = WIDTH, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """Writes the texts' ids to flat files in a folder that all machines share; returns (file, ordinal, doc_id)."""
    ship_package(docs.sparkSession)
    paths = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        name = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        system.create_dir(base, recursive=True)
        at = 0
        with system.open_output_stream(f"{base}/{name}") as out:
            for batch in batches:
                for ids in encode_texts(batch.column(1).to_pylist(), paths, specials_as_text=True):
                    out.write(np.append(ids, np.uint32(end_id)).astype(_KINDS[width]).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{folder}/{name}"] * n, pa.string()), pa.array(range(at, at + n), pa.int64()), batch.column(0)],
                    ["file", "ordinal", "doc_id"])
                at += n
        release()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # a task's rows count only once it has ended, and so closed its file
    return materialise(chosen.mapInArrow(run, "file string, ordinal long, doc_id long"), "token-manifest")


def scan_separators(ids: np.ndarray, end_id: int) -> tuple[np.ndarray, int]:
    """Lengths of the runs that separators end, and the tokens after the last."""
    at = np.flatnonzero(ids == end_id)
    return np.diff(at, prepend=-1) - 1, int(len(ids) - (at[-1] + 1 if len(at) else 0))


def count_tokens(spark: SparkSession, files: DataFrame | Sequence[str], end_id: int = END_OF_DOCUMENT, width: int = WIDTH,
                 block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document of the files (paths, or a table with a column file): file, ordinal, n_tokens, closed."""
    ship_package(spark)
    if not isinstance(files, DataFrame):
        files = spark.createDataFrame([(f,) for f in files], "file string")
    files = files.select("file").distinct()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri in batch.column(0).to_pylist():
                system, path = _open(uri)
                size = system.get_file_info(path).size
                if size is None or size % width:
                    raise ValueError(f"{uri}: {size} bytes are no whole number of {width}-byte ids")
                found.append(-(-size // (width * block_tokens)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], ["file", "blocks"])

    blocks = files.mapInArrow(sizes, "file string, blocks int").where("blocks > 0")
    blocks = blocks.select("file", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).repartition("file", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = _open(uri)
                with system.open_input_file(path) as data:
                    data.seek(block * block_tokens * width)
                    raw = data.read(block_tokens * width)
                runs, rest = scan_separators(np.frombuffer(raw, _KINDS[width]), end_id)
                n = len(runs) + 1  # the last row is the block's own
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * n, pa.string()), pa.array(np.full(n, block, np.int32)), pa.array(np.arange(n, dtype=np.int64)),
                     pa.array(np.append(runs, rest).astype(np.int64)), pa.array([False] * (n - 1) + [True])],
                    ["file", "block", "nth", "run", "rest"])
        release()

    found = materialise(blocks.mapInArrow(scan, "file string, block int, nth long, run long, rest boolean"), "separators")
    by_block = Window.partitionBy("file").orderBy("block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    ends = found.where("rest").select("file", "block", F.col("nth").alias("separators"), F.col("run").alias("tail"))
    ends = ends.withColumn("chain", F.sum((F.col("separators") > 0).cast("int")).over(by_block))
    ends = ends.withColumn("open", F.sum("tail").over(Window.partitionBy("file", "chain").orderBy("block")))
    carried = ends.select(
        "file", "block", "separators", F.coalesce(F.sum("separators").over(before), F.lit(0)).alias("ended"),
        F.coalesce(F.lag("open").over(by_block), F.lit(0)).alias("carried"), "open",
        F.lead("block").over(by_block).isNull().alias("last"))
    closed = found.where("NOT rest").join(carried, ["file", "block"]).select(
        "file", (F.col("ended") + F.col("nth")).alias("ordinal"),
        (F.col("run") + F.when(F.col("nth") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("closed"))
    unclosed = carried.where("last AND open > 0").select(
        "file", (F.col("ended") + F.col("separators")).alias("ordinal"), F.col("open").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(unclosed)


def document_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, counted from flat files written for it."""
    folder = fresh_path(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, folder, id_col, text_col)
    counted = count_tokens(docs.sparkSession, manifest)
    return manifest.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
