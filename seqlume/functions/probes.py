"""How often a short probe matches, by chance and when it is there."""

from __future__ import annotations

from math import comb, fsum


def detection(length: int, error_rate: float, allowed: int) -> float:
    """Chance that a probe that is there has no more than ``allowed`` errors."""
    if allowed < 0:
        raise ValueError(f"allowed must not be negative, got {allowed}")
    return fsum(comb(length, n) * error_rate**n * (1 - error_rate) ** (length - n) for n in range(allowed + 1))


def by_chance(length: int, allowed: int) -> float:
    """Chance that a random place matches a probe with ``allowed`` free positions at most."""
    return fsum(comb(length, n) / 4 ** (length - n) for n in range(allowed + 1))


def false_positives(length: int, bases: int, allowed: int) -> float:
    """Chance of a match anywhere among ``bases`` random places."""
    return 1 - (1 - by_chance(length, allowed)) ** bases
