"""Settings files: discovery, validation, and the merge of typed flags over settings over defaults."""

from __future__ import annotations

import difflib
import json
import os
import re
import tomllib
from dataclasses import dataclass, field
from typing import Any

NAMES = ("textquarry.toml", ".textquarry.toml", "textquarry.json", "pyproject.toml")


class SettingsError(ValueError):
    pass


def parse_size(text: str | int) -> int:
    """Bytes with a decimal suffix k, m or g."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmg]?)b?\s*", str(text).lower())
    if not m:
        raise SettingsError(f"not a size: {text!r}")
    return int(float(m[1]) * {"": 1, "k": 10**3, "m": 10**6, "g": 10**9}[m[2]])


def _number(low, high=None, kind=int):
    def check(name, v):
        if isinstance(v, bool) or not isinstance(v, (int, float)) or (kind is int and not isinstance(v, int)):
            raise SettingsError(f"{name} must be a number, not {v!r}")
        if v < low or (high is not None and v > high):
            raise SettingsError(f"{name} must lie between {low} and {high}, not {v!r}" if high is not None else f"{name} must be at least {low}, not {v!r}")
        return kind(v)

    return check


def _choice(*values):
    def check(name, v):
        if v not in values:
            raise SettingsError(f"{name} must be one of {', '.join(values)}, not {v!r}")
        return v

    return check


def _texts(name, v):
    v = [v] if isinstance(v, str) else v
    if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
        raise SettingsError(f"{name} must be a list of texts")
    return v


def _flag(name, v):
    if not isinstance(v, bool):
        raise SettingsError(f"{name} must be true or false, not {v!r}")
    return v


VALID = {
    "budget": _number(1), "format": _choice("markdown", "xml", "json", "tree"), "mode": _choice("balanced", "coverage", "depth"), "manifest": _choice("full", "paths", "none"),
    "include": _texts, "exclude": _texts, "max_size": lambda n, v: parse_size(v), "max_scan": _number(0), "max_per_dir": _number(0), "max_per_ext": _number(0),
    "dedupe": _flag, "dedupe_threshold": _number(0.01, 1, float), "truncate": _flag, "outline": _flag,
}
LISTS = ("include", "exclude")


@dataclass
class Settings:
    values: dict[str, Any] = field(default_factory=dict)
    source: str | None = None
    unknown: list[str] = field(default_factory=list)

    def hints(self) -> list[str]:
        out = []
        for key in self.unknown:
            near = difflib.get_close_matches(key, VALID, 1, 0.7)
            out.append(f"unknown setting {key!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        return out

    def describe(self) -> str:
        lines = [f"settings from {self.source or 'nowhere'}"]
        return "\n".join(lines + [f"  {k} = {json.dumps(v)}" for k, v in sorted(self.values.items())] + [f"  ! {h}" for h in self.hints()])


def find(start: str) -> str | None:
    """The nearest settings file at or above ``start``; the search ends at a directory that holds .git."""
    here = os.path.abspath(start if os.path.isdir(start) else os.path.dirname(start))
    while True:
        for name in NAMES:
            path = os.path.join(here, name)
            if os.path.isfile(path) and (name != "pyproject.toml" or "textquarry" in _document(path).get("tool", {})):
                return path
        above = os.path.dirname(here)
        if os.path.exists(os.path.join(here, ".git")) or above == here:
            return None
        here = above


def _document(path: str) -> dict:
    try:
        with open(path, "rb") as f:
            raw = f.read()
        data = json.loads(raw) if path.endswith(".json") else tomllib.loads(raw.decode())
    except (OSError, ValueError) as e:
        raise SettingsError(f"{path}: {e}") from e
    if not isinstance(data, dict):
        raise SettingsError(f"{path}: the document is no table")
    return data


def load(path: str, root: str | None = None) -> Settings:
    data = _document(path)
    section = data.get("tool", {}).get("textquarry") or data.get("textquarry") or ({} if path.endswith("pyproject.toml") else data)
    out = Settings(source=path)
    for key, value in section.items():
        name = key.replace("-", "_")
        if name in VALID:
            out.values[name] = VALID[name](name, value)
        else:
            out.unknown.append(key)
    shift = os.path.relpath(os.path.dirname(os.path.abspath(path)), os.path.abspath(root)) if root else "."
    if shift not in (".", "") and not shift.startswith(".."):
        for name in LISTS:
            if name in out.values:
                out.values[name] = [f"{shift}/{p}" if "/" in p else p for p in out.values[name]]
    return out


def merge(defaults: dict[str, Any], settings: Settings | None, typed: dict[str, Any]) -> dict[str, Any]:
    """Typed flags over settings over defaults; lists add up."""
    out = dict(defaults)
    for layer in (settings.values if settings else {}, typed):
        for key, value in layer.items():
            out[key] = list(dict.fromkeys([*(out.get(key) or []), *value])) if key in LISTS else value
    return out
