"""Settings from the environment (SPANLOOM_...), with defaults. A value that can't be read leaves the default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

PREFIX = "SPANLOOM_"
# Spellings of true.
TRUE = ("1", "true", "yes", "on", "y")


@dataclass(frozen=True)
class Settings:
    frame_stride: int = 1
    max_frames: int = 0  # 0: all
    ball: str = "purchase"
    frame_height: float = 1000.0
    format: str = "parquet"
    embeddings: bool = True  # whether links use appearance where vectors are given


def load_settings(env: Mapping[str, str] | None = None) -> Settings:
    """Each field from the variable of its name."""
    env = os.environ if env is None else env
    found = {}
    for field in fields(Settings):
        raw = env.get(PREFIX + field.name.upper(), "").strip()
        if raw:
            try:
                found[field.name] = raw.lower() in TRUE if isinstance(field.default, bool) else type(field.default)(raw)
            except ValueError:
                continue
    return Settings(**found)
