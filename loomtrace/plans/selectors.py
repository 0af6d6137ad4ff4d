"""Command-line selectors: shard lists and name=path assignments."""

from __future__ import annotations


def shard_ids(text: str, count: int) -> list[int]:
    """``"0,2-4"`` as sorted shard numbers below ``count``; repeats and numbers out of range raise."""
    found: list[int] = []
    for part in text.split(","):
        first, _, last = part.partition("-")
        found += range(int(first), int(last or first) + 1)
    if len(set(found)) != len(found) or any(not 0 <= i < count for i in found):
        raise ValueError(f"invalid shards: {text}")
    return sorted(found)


def assignments(items: list[str]) -> dict[str, str]:
    """``name=path`` items as a table; names must differ, neither side may be empty."""
    out: dict[str, str] = {}
    for item in items:
        name, _, path = item.partition("=")
        if not name or not path or name in out:
            raise ValueError(f"invalid assignment: {item}")
        out[name] = path
    return out
