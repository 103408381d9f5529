"""Layered configurations: files with comments, task sections, overrides and a fingerprint."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import MISSING, fields
from typing import Any

_TOKENS = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)


def loads(text: str) -> dict[str, Any]:
    """JSON with // and /* */ comments."""
    return json.loads(_TOKENS.sub(lambda m: m[0] if m[0].startswith('"') else " ", text))


def merge(*layers: dict[str, dict[str, Any]]) -> dict[str, dict[str, Any]]:
    """Sections of all layers; a later layer's values replace those of an earlier one."""
    out: dict[str, dict[str, Any]] = {}
    for layer in layers:
        for section, values in layer.items():
            out.setdefault(section, {}).update(values)
    return out


def override(config: dict[str, dict[str, Any]], *texts: str) -> dict[str, dict[str, Any]]:
    """Apply "Section.key=value": a value with a point is a float, of digits an int, else text."""
    out = merge(config)
    for text in texts:
        name, eq, value = text.partition("=")
        section, dot, key = name.partition(".")
        if not (eq and dot and section and key):
            raise ValueError(f"not of the form Section.key=value: {text}")
        for kind in (int, float):
            try:
                value = kind(value)
                break
            except ValueError:
                pass
        out.setdefault(section, {})[key] = value
    return out


def build(kind: type, *sections: dict[str, Any]) -> Any:
    """A dataclass from sections, later ones first asked; unknown keys and missing values are errors."""
    known = {f.name: f for f in fields(kind)}
    values = {k: v for s in sections for k, v in s.items()}
    if unknown := sorted(set(values) - set(known)):
        raise KeyError(f"{kind.__name__} has no {', '.join(unknown)}")
    missing = [n for n, f in known.items() if n not in values and f.default is MISSING and f.default_factory is MISSING]
    if missing:
        raise ValueError(f"{kind.__name__} needs {', '.join(missing)}")
    return kind(**values)


def fingerprint(config: dict[str, Any], leave_out: tuple[str, ...] = ()) -> str:
    """md5 of the sorted JSON of a section, without the keys that do not matter."""
    return hashlib.md5(json.dumps({k: v for k, v in config.items() if k not in leave_out}, sort_keys=True).encode()).hexdigest()
