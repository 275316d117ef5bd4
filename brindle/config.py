"""Defaults that change results. The values are fixed: results must be the same as those of other users of these settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Chunking:
    size: int = 1000
    overlap: int = 150
    separators: tuple[str, ...] = ("\n\n", "\n- ", "\n* ", "\n", ". ", " ")
    min_paragraph_words: int = 30
    max_paragraph_chars: int = 1500


@dataclass(frozen=True)
class Quality:
    base: float = 0.5
    per_term: float = 0.1
    most_terms: float = 0.4
    few_words: float = 0.2
    low_ocr: float = 0.3
    low_density: float = 0.2
    illegible: float = 0.4
    min_score: float = 0.3
    min_words: int = 10
    min_ocr: float = 0.8
    min_density: float = 0.4


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 50
    rrf_k: int = 60
    rerank_n: int = 5
    context_chars: int = 6000
    preview_chars: int = 100
    image_top_k: int = 8
    image_min_score: float | None = 0.0
    max_assets: int = 6
    history: int = 8
    min_top_score: float = 0.0
    enforce_citations: bool = True


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = field(default_factory=Chunking)
    quality: Quality = field(default_factory=Quality)
    retrieval: Retrieval = field(default_factory=Retrieval)
    paragraph_gap: float = 32.0


# Kinds, buckets, words and patterns that results depend on.
TARGET_TYPES = ("text", "ocr_text", "table_md", "image_caption")
SPLIT_TYPES = ("text", "table_md", "ocr_text")
SCORE_BUCKETS = ((0.3, "0.0-0.3"), (0.5, "0.3-0.5"), (0.7, "0.5-0.7"), (0.9, "0.7-0.9"))
LAST_BUCKET = "0.9-1.0"
CHUNK_TYPES = ("text", "table_md", "image_caption", "ocr_text")
ILLEGIBLE = ("not legible", "unreadable", "blur", "unknown")
PLACEHOLDER_NAMES = ("unknown", "component", "n/a", "not visible", "")
PLACEHOLDER_PARTS = ("not visible", "n/a")
VISUAL_WORDS = ("diagram", "schematic", "figure", "table", "chart", "plot", "image", "photo", "picture")
IMAGE_SUFFIX = "(?i)\\.(png|jpg|jpeg|webp)$"
UPLOAD_NAME = "^[a-f0-9]{32}\\.(jpg|png|webp)$"
MOST_QUERY_CHARS = 4000
MOST_UPLOAD_BYTES = 10 * 1024 * 1024
MOST_PIXELS = 40_000_000
NO_ANSWER = "I don't know."


def csv(text: str) -> list[str]:
    """Comma-separated parts, trimmed, empty ones dropped."""
    return [p.strip() for p in (text or "").split(",") if p.strip()]


def from_env(prefix: str = "BRINDLE_", env: dict[str, str] | None = None) -> Retrieval:
    """Retrieval settings with overrides such as BRINDLE_TOP_K=20."""
    env = os.environ if env is None else env
    found = {}
    for f in fields(Retrieval):
        raw = env.get(prefix + f.name.upper())
        if raw is None:
            continue
        default = getattr(Retrieval(), f.name)
        if isinstance(default, bool):
            found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
        elif isinstance(default, int):
            found[f.name] = int(raw)
        else:
            found[f.name] = float(raw)
    return Retrieval(**found)


def from_yaml(path: str) -> Settings:
    """Settings from a YAML file with sections chunking, quality and retrieval; a missing file is an error."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}

    def part(kind, name):
        given = raw.get(name) or {}
        known = {x.name for x in fields(kind)}
        return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known})

    return Settings(part(Chunking, "chunking"), part(Quality, "quality"), part(Retrieval, "retrieval"), float(raw.get("paragraph_gap", 32.0)))
