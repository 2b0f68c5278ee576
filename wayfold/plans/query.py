"""The immutable tag query.  Every change returns a new query; nothing is executed here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import DataFrame

from .rules import DEFAULTS

Filter = Mapping[str, Sequence[str]]


def _union(first: Sequence[str], second: Sequence[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys([*first, *second]))


def merge_filters(first: Filter | None, second: Filter | None) -> dict[str, tuple[str, ...]]:
    """Key-wise union of two filters; an empty list means any value and absorbs the other side."""
    if first is None and second is None:
        raise ValueError("one of the two filters must be given")
    merged = {k: tuple(v) for k, v in (first or {}).items()}
    for key, values in (second or {}).items():
        if key not in merged:
            merged[key] = tuple(values)
        else:
            merged[key] = _union(merged[key], values) if merged[key] and values else ()
    return merged


@dataclass(frozen=True)
class OsmQuery:
    """What to select.

    ``tags``: True for the whole map, False for none, or the keys that become columns.
    ``must_tags``: at least one of these keys is present.  ``keep`` and ``exclude`` map keys to
    values, an empty list standing for any value; with ``keep_first`` an element passes if it
    is kept and not excluded, otherwise if it is not excluded or kept.  ``topology`` needs
    ways and geometry.  ``defaults`` names a ready-made query merged into this one.
    """

    nodes: bool = False
    ways: bool = False
    relations: bool = False
    must_tags: Sequence[str] | None = None
    keep: Filter | None = None
    exclude: Filter | None = None
    keep_first: bool = True
    tags: bool | Sequence[str] = True
    node_ids: Sequence[int] | DataFrame | None = None
    way_ids: Sequence[int] | DataFrame | None = None
    relation_type: Sequence[str] | None = None
    metadata: bool = False
    geometry: bool = False
    topology: bool = False
    defaults: str | None = None

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        for name in ("must_tags", "node_ids", "way_ids", "relation_type"):
            value = getattr(self, name)
            # a table of ids stays a table
            put(name, value if value is None or isinstance(value, DataFrame) else tuple(dict.fromkeys(value)))
        for name in ("keep", "exclude"):
            value = getattr(self, name)
            put(name, None if value is None else {k: tuple(v) for k, v in value.items()})
        if not isinstance(self.tags, bool):
            put("tags", tuple(dict.fromkeys(self.tags)))
        if self.defaults is not None:
            merged = self._with(self.defaults)
            for f in fields(self):
                put(f.name, getattr(merged, f.name))
        self._check()

    def _check(self) -> None:
        if self.topology and not (self.ways and self.geometry):
            raise ValueError("topology needs ways and geometry")
        if self.relation_type is not None and not self.relation_type:
            raise ValueError("relation_type cannot be an empty list")
        if self.keep_first and self.keep is None and self.exclude is not None:
            raise ValueError("with keep_first, exclude needs keep (an empty one keeps all)")
        if not self.keep_first and self.exclude is None and self.keep is not None:
            raise ValueError("without keep_first, keep needs exclude")

    def _with(self, name: str) -> OsmQuery:
        if name not in DEFAULTS:
            raise ValueError(f"default must be one of {', '.join(DEFAULTS)}")
        change: dict[str, Any] = {"defaults": None, "topology": False}
        for key, value in DEFAULTS[name].items():
            if key == "tags":
                change[key] = merge_tags(self.tags, value)
            elif key in ("keep", "exclude"):
                change[key] = merge_filters(getattr(self, key), value)
            else:
                change[key] = value
        # topology is looked at again once the default has named the element types
        return replace(replace(self, **change), topology=self.topology) if self.topology else replace(self, **change)

    def set_default(self, name: str) -> OsmQuery:
        return self._with(name)

    def append_tags(self, tags: bool | Sequence[str]) -> OsmQuery:
        return replace(self, tags=merge_tags(self.tags, tags))

    def append_keep(self, keep: Filter) -> OsmQuery:
        return replace(self, keep=merge_filters(self.keep, keep))

    def append_exclude(self, exclude: Filter) -> OsmQuery:
        return replace(self, exclude=merge_filters(self.exclude, exclude))

    def append_relation_type(self, types: Sequence[str]) -> OsmQuery:
        return replace(self, relation_type=_union(self.relation_type or (), types))

    def copy(self, **change: Any) -> OsmQuery:
        return replace(self, **change)

    def as_dict(self) -> dict[str, Any]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def all_strings(self) -> set[str]:
        """Every key and value that the query names."""
        named: set[str] = set()
        for part in (self.keep, self.exclude):
            for key, values in (part or {}).items():
                named |= {key, *values}
        return named | set(self.must_tags or ()) | set(self.relation_type or ()) | (set(self.tags) if not isinstance(self.tags, bool) else set())


def merge_tags(first: bool | Sequence[str], second: bool | Sequence[str]) -> bool | tuple[str, ...]:
    """True asks for all keys; a list after all narrows to the list; two lists are united in order."""
    if second is True:
        return True
    if second is False:
        return first if isinstance(first, bool) else tuple(first)
    return tuple(second) if isinstance(first, bool) else _union(first, second)
