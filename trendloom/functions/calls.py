"""Calls of a caller's functions, such as models, whose failures stay with the items that cause them."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

Item, Found = TypeVar("Item"), TypeVar("Found")


def each_or_none(fn: Callable[[list[Item]], list[Found | None]], items: list[Item]) -> list[Found | None]:
    """What `fn` gives for the items; a call that raises, or gives another number of results, is repeated with either half, so that only items that fail alone have none."""
    if not items:
        return []
    try:
        found = list(fn(items))
        if len(found) == len(items):
            return found
    except Exception:  # whatever a caller's model raises
        pass
    if len(items) == 1:
        return [None]
    half = len(items) // 2
    return each_or_none(fn, items[:half]) + each_or_none(fn, items[half:])
