"""Settings from the environment, then from a file of NAME=value lines."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Names and defaults are fixed values: existing environments and stores rely on them."""

    llm_base_url: str | None = None
    llm_model: str = "llama3.1"
    llm_api_key: str | None = None
    embedding_model: str = "BAAI/bge-m3"
    vector_store_path: str = "data/index"
    sources_path: str = "data/samples"
    collection_name: str = "matchmaker"


def get_settings(env_file: str = ".env") -> Settings:
    """Unknown names are ignored; names are read in any case."""
    found = {}
    if Path(env_file).is_file():
        for line in Path(env_file).read_text().splitlines():
            name, sign, value = line.partition("=")
            if sign and not name.lstrip().startswith("#"):
                found[name.strip().lower()] = value.strip().strip("\"'")
    found |= {k.lower(): v for k, v in os.environ.items()}
    return Settings(**{f.name: found[f.name] for f in fields(Settings) if f.name in found})
