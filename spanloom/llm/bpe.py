"""Byte-level BPE through a sentencepiece model that is serialised from the vocabulary.

Each byte has a printable character; a token of the rank file becomes the string
of its bytes' characters, a NORMAL piece whose score is its negative rank.
sentencepiece's BPE merges the neighbouring pair whose joined piece scores
highest, leftmost first, which is the merge of least rank. Normalisation is the
identity: no prefix space, no collapsed or escaped white space. Text is cut by
the split pattern, each pre-token is encoded on its own, and decoding maps the
pieces' characters back to bytes.

The split runs on the regex module's Unicode tables; letters and numbers that
are newer than those tables are split as other symbols.

Edge cases: a null text is the empty text (no ids, hashes of nothing); very long
texts are encoded whole (merging is n log n in a pre-token); repeated rows give
repeated results; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_bounded, ship_package
from .tokens import read_ranks

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CACHE_LIMIT = 400_000  # pre-tokens whose ids a worker remembers
_CACHED_LENGTH = 64  # longer pre-tokens are not remembered
_MODEL_LIMIT = 64 << 20
_UNKNOWN = "<unk>"


@functools.lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """A printable character for each byte: the byte's own where that is printable, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def to_characters(data: bytes) -> str:
    return data.decode("latin-1").translate(_to_characters())


@functools.lru_cache(maxsize=1)
def _to_characters() -> dict[int, str]:
    return dict(enumerate(byte_characters()))


@functools.lru_cache(maxsize=1)
def _to_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_characters())}


def serialise_model(ranks: Mapping[bytes, int]) -> bytes:
    """The sentencepiece ModelProto of a rank vocabulary. Ids are ranks; the unknown piece comes after the last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    if not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("every single byte must be a token")
    model = pb.ModelProto()
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        model.pieces.add(piece=to_characters(token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece=_UNKNOWN, score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    trainer, normalizer = model.trainer_spec, model.normalizer_spec
    trainer.model_type = pb.TrainerSpec.BPE
    trainer.vocab_size = len(ranks) + 1
    trainer.unk_id, trainer.bos_id, trainer.eos_id, trainer.pad_id = len(ranks), -1, -1, -1
    trainer.unk_piece = _UNKNOWN
    normalizer.name = "identity"
    normalizer.add_dummy_prefix = normalizer.remove_extra_whitespaces = normalizer.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes and decodes with a serialised model and a split pattern."""

    def __init__(self, model: bytes, pattern: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        back = _to_bytes()
        self.token_bytes = [bytes(back[c] for c in self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size() - 1)]
        self.whole = self._encode_new([token.decode() for token in self.token_bytes if _valid(token)])  # looked up more often than others

    def _encode_new(self, tokens: list[str]) -> dict[str, bytes]:
        mapped = [to_characters(token.encode()) for token in tokens]
        return {token: np.array(ids, "<u4").tobytes() for token, ids in zip(tokens, self.pieces.encode(mapped, num_threads=1), strict=True)}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        tokens = self.split(text)
        known = self.known
        new = [token for token in set(tokens) if token not in known]
        if new:
            if len(known) > CACHE_LIMIT:
                known.clear()
                new = list(set(tokens))
            found = {token: self.whole[token] for token in new if token in self.whole}
            found |= self._encode_new([token for token in new if token not in found])
            known.update(found)
            out = b"".join(map(known.__getitem__, tokens))
            for token in new:
                if len(token) > _CACHED_LENGTH:
                    del known[token]
            return out
        return b"".join(map(known.__getitem__, tokens))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(model: bytes, pattern: str) -> Codec:
    """A worker's codec; it stays, with its remembered pre-tokens, from one task to the next."""
    return Codec(model, pattern)


def _valid(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    spark = docs.sparkSession
    ship_package(spark)
    data = serialise_model(read_ranks(ranks_path))
    model = broadcast_bounded(spark, data, len(data), _MODEL_LIMIT, "the sentencepiece model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value, pattern)
        for batch in batches:
            sizes, hashes, back = [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py() or "")
                sizes.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, SCHEMA)
