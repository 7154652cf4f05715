"""Settings, from the environment where it sets them."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _int(name: str, default: int) -> int:
    """A setting that isn't a whole number counts as not set."""
    try:
        return int(os.environ.get(name, ""))
    except ValueError:
        return default


@dataclass(frozen=True)
class Config:
    warehouse: str = field(default_factory=lambda: os.path.expanduser(os.environ.get("QUERN_WAREHOUSE", "~/.quern")))
    model: str = field(default_factory=lambda: os.environ.get("QUERN_MODEL", "nomic-embed-text"))
    dims: int = field(default_factory=lambda: _int("QUERN_DIMS", 768))
    max_file_kb: int = field(default_factory=lambda: _int("QUERN_MAX_FILE_KB", 512))
    batch_size: int = field(default_factory=lambda: _int("QUERN_BATCH_SIZE", 50))
    concurrency: int = field(default_factory=lambda: _int("QUERN_CONCURRENCY", 4))
    model_url: str = field(default_factory=lambda: os.environ.get("QUERN_MODEL_URL", "http://localhost:11434"))

    def __post_init__(self) -> None:
        if self.batch_size < 1 or self.concurrency < 1 or self.dims < 1:
            raise ValueError("batch size, concurrency and dimension must be at least 1")
