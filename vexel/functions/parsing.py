"""Parameters given as text."""

from __future__ import annotations

import re

_UNITS = {"": 1, "k": 10**3, "m": 10**6, "b": 10**9}


def scale(name: str) -> int:
    """'10m' is 10,000,000; a data set's name in front of the number does not count."""
    if not (m := re.fullmatch(r"[a-z_]*?(\d+)([kmb]?)", name.strip().lower())):
        raise ValueError(f"scale {name!r}")
    return int(m[1]) * _UNITS[m[2]]


def numbers(text: str, kind=int) -> list:
    return [kind(x) for x in text.split(",") if x.strip()]


def pairs(text: str) -> list[tuple[float, float]]:
    """'0.1:0.2,0:0.5' as pairs."""
    out = []
    for x in text.split(","):
        if x.strip():
            a, sep, b = x.partition(":")
            if not sep:
                raise ValueError(f"pair {x!r}: a:b")
            out.append((float(a), float(b)))
    return out
