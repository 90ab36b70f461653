"""Settings of a workspace. A missing or broken file means the defaults; nothing here ever raises."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from zoneinfo import ZoneInfo

from kairolog.functions.grammar import Vocabulary
from kairolog.functions.textprep import merged_words


@dataclass(frozen=True)
class Config:
    user_name: str = "user"
    ai_name: str = "assistant"
    model_name: str = "unknown"
    data_dir: str = "./logs"
    raw_log_dir: str | None = None
    ingest_format: str = "plain"
    timezone: str = "UTC"
    wake_word: str = "good morning"
    bridge_minutes: int = 30
    daemon_interval: int = 600
    topic_words: tuple[str, ...] = ()
    protected_names: tuple[str, ...] = ()
    asr_corrections: str | None = None
    origin_log: str | None = None
    warnings: tuple[str, ...] = field(default=(), compare=False)


def load(path: str | None = None) -> Config:
    """Settings from a JSON file (``path``, or ``KAIROLOG_CONFIG``, or config.json here). Keys that begin with ``_`` are comments."""
    where = Path(path or os.environ.get("KAIROLOG_CONFIG", "config.json"))
    try:
        raw = json.loads(where.read_text(encoding="utf-8"))
        assert isinstance(raw, dict)
    except (OSError, ValueError, AssertionError):
        return Config()
    known = {f.name for f in fields(Config)} - {"warnings"}
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known and v is not None}
    return checked(replace(Config(), **given))


def checked(config: Config) -> Config:
    """An unknown zone becomes UTC, with a warning."""
    try:
        ZoneInfo(config.timezone)
        return config
    except (KeyError, ValueError, OSError):
        return replace(config, timezone="UTC", warnings=(*config.warnings, f"unknown timezone {config.timezone!r}, using UTC"))


def word_list(config: Config, name: str, default: list[str]) -> list[str]:
    """A list of words that a file of the data folder replaces."""
    found = read_json(Path(config.data_dir) / name)
    words = [w for w in found if isinstance(w, str) and w.strip()] if isinstance(found, list) else []
    return words or default


def read_json(path: Path | str | None) -> object:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8")) if path else None
    except (OSError, ValueError):
        return None


def corrections(config: Config) -> dict[str, str]:
    """Wrong spellings and their right ones, flat or under ``corrections``."""
    raw = read_json(config.asr_corrections)
    if not isinstance(raw, dict):
        return {}
    inner = raw.get("corrections")
    return {k: v for k, v in (inner if isinstance(inner, dict) else raw).items() if isinstance(v, str)}


def vocabulary(config: Config) -> Vocabulary:
    """The words of ``rag_filters.json`` in the data folder, each list given by ``include`` and ``exclude``, over the fixed ones; protected names also from the settings."""
    raw = read_json(Path(config.data_dir) / "rag_filters.json")
    rules = raw if isinstance(raw, dict) else {}
    base = Vocabulary()
    lists = {name: tuple(merged_words(default, rules.get(key))) for name, key, default in (("fillers", "fillers", base.fillers), ("tails", "tail_fillers", base.tails), ("stopwords", "stopwords", base.stopwords), ("protected", "protected_names", config.protected_names))}
    return Vocabulary(**lists)
