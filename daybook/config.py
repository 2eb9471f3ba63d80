"""Settings: a typed tree read from TOML, with the checks that carry meaning."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path

from .functions.text import resolve_merges


class Invalid(ValueError):
    """A setting that can't be used, named by its place."""


def _tag(name: str) -> str:
    return name.strip().lstrip("#").lower()


@dataclass
class Vault:
    path: str = "."
    date_format: str = "%Y-%m-%d"
    split: str = r"^##\s+(\d{4}-\d\d-\d\d)\b.*$"
    notes_path: str = "Links"
    other_files: str | None = None
    ignore: list[str] = field(default_factory=list)
    private_tags: list[str] = field(default_factory=list)
    mood_scale_min: float = 1.0
    mood_scale_max: float = 10.0

    def __post_init__(self):
        if self.mood_scale_max <= self.mood_scale_min:
            raise Invalid("vault.mood_scale_max must be over mood_scale_min")
        try:
            re.compile(self.split)
        except re.error as wrong:
            raise Invalid(f"vault.split is no pattern: {wrong}") from wrong
        self.private_tags = [_tag(t) for t in self.private_tags]


@dataclass
class Indexing:
    min_section: int = 200
    detail_min_words: int = 400
    detail_long_words: int = 1000

    def __post_init__(self):
        if self.detail_long_words < self.detail_min_words:
            raise Invalid("indexing.detail_long_words must not be under detail_min_words")


@dataclass
class Tags:
    merge: dict[str, str] = field(default_factory=dict)
    ignore: list[str] = field(default_factory=list)

    def __post_init__(self):
        try:
            self.merge = resolve_merges({_tag(a): _tag(b) for a, b in self.merge.items()})
        except ValueError as wrong:
            raise Invalid(f"tags.merge: {wrong}") from wrong
        self.ignore = [_tag(t) for t in self.ignore]


@dataclass
class Metrics:
    keys: list[str] = field(default_factory=list)
    mood_key: str = "mood"


@dataclass
class Insights:
    min_sample: int = 3
    deviation: float = 0.8


@dataclass
class Themes:
    count: int | None = None
    min_entries: int = 5
    stale_share: float = 0.2


@dataclass
class History:
    path: str | None = None
    keep: int = 500


@dataclass
class Config:
    vault: Vault = field(default_factory=Vault)
    indexing: Indexing = field(default_factory=Indexing)
    tags: Tags = field(default_factory=Tags)
    metrics: Metrics = field(default_factory=Metrics)
    insights: Insights = field(default_factory=Insights)
    themes: Themes = field(default_factory=Themes)
    history: History = field(default_factory=History)
    withheld_tags: list[str] = field(default_factory=list)
    withheld_kinds: list[str] = field(default_factory=list)

    def __post_init__(self):
        if self.history.path and Path(self.history.path).resolve().is_relative_to(Path(self.vault.path).resolve()):
            raise Invalid("history.path may not lie in the vault")


def _build(kind, values: dict, place: str):
    known = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise Invalid(f"unknown setting: {place}{sorted(unknown)[0]}")
    built = {}
    for name, value in values.items():
        default = known[name].default_factory() if callable(known[name].default_factory) else None
        built[name] = _build(type(default), value, f"{place}{name}.") if is_dataclass(default) else value
    return kind(**built)


def load(path: str) -> Config:
    """Settings from a TOML file, with or without a byte-order mark."""
    return _build(Config, tomllib.loads(Path(path).read_text(encoding="utf-8-sig")), "")
