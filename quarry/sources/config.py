"""Configuration from TOML: every key is known, every value is checked."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class CorpusConfig:
    name: str
    path: str
    ignore: tuple[str, ...] = ()


@dataclass(frozen=True)
class SearchConfig:
    k1: float = 1.2
    b: float = 0.75
    rrf_k: int = 60
    limit: int = 50
    candidates: int = 200
    graph_weight: float = 0.0


@dataclass(frozen=True)
class EmbedderConfig:
    """factory: "module:function", which gives an embedder; none where it is empty."""

    factory: str = ""
    dim: int = 384


@dataclass(frozen=True)
class Config:
    store: str
    corpora: tuple[CorpusConfig, ...]
    search: SearchConfig = field(default_factory=SearchConfig)
    debounce_ms: int = 250
    embedder: EmbedderConfig = field(default_factory=EmbedderConfig)


def _known(table: dict, cls: type, where: str) -> dict:
    names = {f.name for f in fields(cls)}
    if extra := sorted(set(table) - names):
        raise ConfigError(f"{where}: unknown key {extra[0]!r}; known: {', '.join(sorted(names))}")
    return table


def parse_config(text: str) -> Config:
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    _known(raw, Config, "configuration")
    try:
        corpora = tuple(CorpusConfig(**{**_known(c, CorpusConfig, "corpora"), "ignore": tuple(c.get("ignore", ()))}) for c in raw.get("corpora", []))
        search = SearchConfig(**_known(raw.get("search", {}), SearchConfig, "search"))
        out = Config(raw["store"], corpora, search, raw.get("debounce_ms", 250), EmbedderConfig(**_known(raw.get("embedder", {}), EmbedderConfig, "embedder")))
    except (TypeError, KeyError) as e:
        raise ConfigError(f"missing value: {e}") from e
    if not 1 <= len(corpora) <= 256 or len({c.name for c in corpora}) < len(corpora):
        raise ConfigError("between 1 and 256 corpora with different names are needed")
    if search.k1 < 0 or not 0 <= search.b <= 1 or not 1 <= search.limit <= 1000 or not 0 <= search.graph_weight <= 4 or search.rrf_k < 1:
        raise ConfigError("search: a value is out of range")
    if out.embedder.factory and (":" not in out.embedder.factory or out.embedder.dim < 1):
        raise ConfigError("embedder: the factory is module:function, dim 1 or more")
    if out.debounce_ms < 0:
        raise ConfigError("debounce_ms: a value is out of range")
    return out


def load_config(path: str) -> Config:
    return parse_config(Path(path).read_text())
