"""The registry of structured-data types: required fields, constraints and inheritance."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

from auditloom.schema.types import as_registry


@dataclass
class Property:
    expected: list[str] = field(default_factory=list)
    is_date: bool = False
    is_url: bool = False
    enum: list[str] = field(default_factory=list)


@dataclass
class Type:
    name: str
    parent: str = ""
    properties: dict[str, Property] = field(default_factory=dict)
    required: list[str] = field(default_factory=list)
    google_required: list[str] = field(default_factory=list)
    google_recommended: list[str] = field(default_factory=list)
    eligible: bool = False


def _type(name: str, t: dict) -> Type:
    props = {k: Property(v.get("expected_types") or [], bool(v.get("is_date")), bool(v.get("is_url")), v.get("enum_values") or []) for k, v in (t.get("properties") or {}).items()}
    return Type(name, t.get("parent") or "", props, t.get("required_fields") or [], t.get("google_required") or [], t.get("google_recommended") or [], bool(t.get("google_eligible")))


@lru_cache(maxsize=8)
def load_registry(path: str | None = None) -> dict[str, Type]:
    """Types by name, each with the properties of its ancestors; a file that can't be read gives the built-in one.

    A parent outside the registry ends the chain; required lists are not inherited.
    """
    try:
        raw = json.loads(Path(path).read_text()) if path else as_registry()
        types = {k: _type(k, v) for k, v in raw["types"].items()}
    except (OSError, ValueError, KeyError, AttributeError):
        if not path:
            raise
        return load_registry(None)
    out = {}
    for name, t in types.items():
        props, seen, p = dict(t.properties), {name}, t.parent
        while p in types and p not in seen:
            seen.add(p)
            for k, v in types[p].properties.items():
                props.setdefault(k, v)
            p = types[p].parent
        out[name] = Type(name, t.parent, props, t.required, t.google_required, t.google_recommended, t.eligible)
    return out

