"""Labelled spans as text: kind:start:end by start, then kind, comma-joined."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from hashlib import sha256

Span = tuple[str, int, int]


def joined(spans: Iterable[Span], kinds: Sequence[str]) -> str:
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (s[1], rank[s[0]], s[2])))


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()
