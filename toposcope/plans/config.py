"""Declarative gazetteer configuration and its validation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
SAFE = re.compile(r"^[A-Za-z0-9][A-Za-z0-9_-]*$")
TYPES = {"text": "string", "integer": "bigint", "real": "double", "geometry": "binary"}


class ConfigError(ValueError):
    pass


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


@dataclass
class Attribute:
    name: str
    type: str

    def __post_init__(self) -> None:
        _require(bool(NAME.match(self.name)), f"attribute name {self.name!r} is not an identifier")
        _require(self.type in TYPES, f"attribute {self.name}: type {self.type!r} is none of {', '.join(TYPES)}")


@dataclass
class Source:
    name: str
    attributes: list[Attribute]
    url: str | None = None
    path: str | None = None
    file: str | None = None
    delimiter: str | None = None
    quote: str | None = None
    skip_rows: int = 0
    layer: str | None = None
    crs: str | None = None
    sha256: str | None = None

    @property
    def tabular(self) -> bool:
        return self.delimiter is not None

    def __post_init__(self) -> None:
        self.attributes = [a if isinstance(a, Attribute) else Attribute(**a) for a in self.attributes]
        _require(bool(NAME.match(self.name)), f"source name {self.name!r} is not an identifier")
        _require((self.url is None) != (self.path is None), f"source {self.name}: exactly one of url and path")
        names = [a.name for a in self.attributes]
        _require(bool(names), f"source {self.name}: no attributes")
        _require(len({n.lower() for n in names}) == len(names), f"source {self.name}: attribute names repeat")
        spatial = [a.name for a in self.attributes if a.type == "geometry"]
        if self.tabular:
            _require(not spatial, f"source {self.name}: a delimited source has no geometry")
        else:
            _require(spatial == ["geometry"], f"source {self.name}: a spatial source has one geometry attribute named geometry")
            _require(self.quote is None and not self.skip_rows, f"source {self.name}: quote and skip_rows are for delimited sources")
        if self.sha256 is not None:
            self.sha256 = self.sha256.lower()
            _require(bool(re.fullmatch("[0-9a-f]{64}", self.sha256)), f"source {self.name}: sha256 needs 64 hex digits")


_ALIAS = re.compile(r"^(?P<e>.+?)\s+AS\s+(?:\"(?P<q>[^\"]+)\"|(?P<a>[A-Za-z_]\w*))\s*$", re.I | re.S)
_COLUMN = re.compile(r"^\s*(?:[A-Za-z_]\w*\.)?(?:\"([^\"]+)\"|([A-Za-z_]\w*))\s*$")


def split_alias(item: str) -> tuple[str, str | None]:
    """Expression and key of a data item: a trailing AS alias, or the name of a plain column."""
    m = _ALIAS.match(item)
    if m:
        return m["e"].strip(), m["q"] or m["a"]
    m = _COLUMN.match(item)
    return item.strip(), (m[1] or m[2]) if m else None


@dataclass
class Block:
    source: str
    identifier: str
    names: list[str]
    data: list[str] = field(default_factory=list)
    joins: list[str] = field(default_factory=list)
    geometry: str | None = None

    def __post_init__(self) -> None:
        _require(bool(self.names) and all(n.strip() for n in self.names), f"block {self.source}: names are missing or blank")
        _require(all(j.strip() for j in self.joins), f"block {self.source}: a join is blank")
        keys = [split_alias(d)[1] for d in self.data]
        _require(all(keys), f"block {self.source}: a data expression needs AS alias")
        _require(len(set(keys)) == len(keys), f"block {self.source}: data keys repeat")


@dataclass
class Config:
    name: str
    sources: list[Source]
    features: list[Block]
    crs: str = "EPSG:4326"
    disk_gb: float | None = None

    def __post_init__(self) -> None:
        self.sources = [s if isinstance(s, Source) else Source(**s) for s in self.sources]
        self.features = [b if isinstance(b, Block) else Block(**b) for b in self.features]
        _require(bool(SAFE.match(self.name)), f"gazetteer name {self.name!r} is not safe as a folder")
        _require(self.disk_gb is None or self.disk_gb > 0, "disk_gb must be positive")
        names = [s.name for s in self.sources]
        _require(len(set(names)) == len(names), "source names repeat")
        used = [b.source for b in self.features]
        _require(len(set(used)) == len(used), "two feature blocks of one source")
        for b in self.features:
            _require(b.source in names, f"block source {b.source!r} is not declared")

    @classmethod
    def load(cls, path: str) -> Config:
        """From YAML; relative source paths are taken from the file's folder."""
        import yaml

        raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        for s in raw.get("sources", []):
            if s.get("path") and "://" not in s["path"] and not Path(s["path"]).is_absolute():
                s["path"] = str(Path(path).resolve().parent / s["path"])
        return cls(**raw)
