"""Token ids of the byte-level BPE vocabulary, as the tokenizers library gives them, at several times its speed.

Texts of Latin script go through the rank-file encoder, whose ids are the same
(``tests/llm`` holds the two against each other); texts with other characters,
or with a special token's string, go to the tokenizers library itself, because
only there the two libraries' Unicode tables or special tokens could differ.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator, Sequence

import numpy as np

_OTHER = re.compile("[^\x00-ɏ‐-‧‰-⁞€]")
_SPECIAL = re.compile("<\\|")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


@functools.lru_cache(maxsize=2)
def _fast(rank_path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(rank_path), special_tokens={})


@functools.lru_cache(maxsize=2)
def _library(json_path: str, specials_as_text: bool):
    """The tokenizers library's encoder; only workers that meet a text for it load one."""
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(json_path)
    held.encode_special_tokens = specials_as_text
    return held


def default_paths() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_texts(texts: Sequence[str | None], paths: tuple[str, str, str] | None = None, specials_as_text: bool = False) -> Iterator[np.ndarray]:
    """The ids (uint32) of each text, None as the empty text; no special tokens are added.

    A special token's string in a text is that token, as is the library's default, or ordinary text.
    """
    json_path, rank_path, pattern = paths or default_paths()
    fast = _fast(rank_path, pattern)
    for text in texts:
        if not text:
            yield np.empty(0, np.uint32)
        elif _OTHER.search(text) or (not specials_as_text and _SPECIAL.search(text)):
            yield np.array(_library(json_path, specials_as_text).encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            yield np.array(fast.encode_ordinary(text), np.uint32)
