"""Words of UTF-8 texts in Python workers, in bounded pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def segments(data: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """Consecutive parts of data, each about `size` bytes and ended by white space (\\x20, \\x09-\\x0D), so that no word is cut."""
    at = 0
    while len(data) - at > size:
        cut = _SPACE.search(data, at + size)
        if cut is None:
            break
        yield data[at : cut.start()]
        at = cut.end()
    yield data[at:] if at else data


def words(data: bytes) -> list[bytes]:
    """[^\\x20\\x09-\\x0D]+ with A-Z lower-cased: bytes.lower and bytes.split know ASCII only, which is the rule."""
    return data.lower().split()
