"""Compact specifications, paths and options: driver-side Python without data."""

from __future__ import annotations

import dataclasses
import os
import re
from collections.abc import Iterable
from pathlib import Path
from typing import Any


def _value(text: str) -> int | str:
    text = text.strip()
    return int(text.replace("_", "")) if re.fullmatch(r"[0-9][0-9_]*", text) else text


def parse_spec(spec: str) -> tuple[str | None, dict[str, Any]]:
    """`name[k:v,n:5_000]` to (name, {...}) with whole numbers as ints; `a=1,b=2` to (None, {...}) with strings."""
    spec = spec.strip()
    found = re.fullmatch(r"([^\[\]]*)(?:\[(.*)\])?", spec, re.S)
    if not found:
        raise ValueError(f"not a specification: {spec!r}")
    name, inside = found[1].strip(), found[2]
    if inside is None and "=" in name:
        pairs = [p.partition("=") for p in name.split(",") if p.strip()]
        if any(not sep for _, sep, _ in pairs):
            raise ValueError(f"a part without '=': {spec!r}")
        return None, {k.strip(): v.strip() for k, _, v in pairs}
    out: dict[str, Any] = {}
    for part in (inside or "").split(","):
        if part.strip():
            key, sep, value = part.partition(":")
            if not sep:
                raise ValueError(f"a part without ':': {part!r}")
            out[key.strip()] = _value(value)
    return name, out


def split_specs(specs: str) -> list[tuple[str | None, dict[str, Any]]]:
    """Parts between | or + outside brackets; an empty text raises."""
    parts = [p for p in re.split(r"[|+](?![^\[]*\])", specs) if p.strip()]
    if not parts:
        raise ValueError("empty specification")
    return [parse_spec(p) for p in parts]


#: Fixed: the setting that holds the folder of relative dataset paths.
BASE_ENV = "BASE_DATASETS_DIR"


def resolve_path(path: str, env: str) -> str:
    """Absolute or existing paths, addresses with a scheme, and all where env is unset, as they are; else below the folder in env, where it has to exist."""
    base = os.environ.get(env, "")
    if os.path.isabs(path) or re.match(r"\w+:/", path) or os.path.exists(path) or not base:
        return path
    joined = Path(base) / path
    if not joined.exists():
        raise FileNotFoundError(f"{path} is neither here nor below ${env}: {joined}")
    return str(joined)


def name_matches(name: str, needle: str | Iterable[str]) -> bool:
    """The name contains (or ends with) the needle, or any of them."""
    return any(n in name for n in ([needle] if isinstance(needle, str) else needle))


def token_list(text: str | Iterable[int] | None) -> list[int]:
    """`[1;2]`, `1;2` or a list to ints; null or empty to []."""
    if text is None:
        return []
    if not isinstance(text, str):
        return [int(x) for x in text]
    return [int(x) for x in text.strip().strip("[]").split(";") if x.strip()]


def merge_options(cls: type, source: Any, **overrides: Any) -> Any:
    """An options record of cls: overrides win, other fields come from source (dataclass or mapping) or the defaults."""
    have = dataclasses.asdict(source) if dataclasses.is_dataclass(source) else dict(source or {})
    names = {f.name for f in dataclasses.fields(cls)}
    return cls(**({k: v for k, v in have.items() if k in names} | {k: v for k, v in overrides.items() if k in names and v is not None}))
