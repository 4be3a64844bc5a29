from __future__ import annotations

import random
from datetime import datetime, timedelta

BASE = datetime(2024, 3, 1)


def at(minutes: float) -> datetime:
    return BASE + timedelta(minutes=minutes)


def random_rows(seed: int, n: int, keys: int = 3, ties: bool = True) -> list[tuple]:
    """(event_id, ts, key): one key holds most rows, and some times are equal."""
    rng = random.Random(seed)
    rows, minute = [], 0.0
    for i in range(n):
        minute += rng.choice([0, 0.5, 1, 3, 20] if ties else [0.5, 1, 3, 20])
        rows.append((i, at(minute), "hot" if rng.random() < 0.7 else f"k{rng.randrange(keys)}"))
    rng.shuffle(rows)
    return rows


def by_key(rows: list[tuple]) -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {}
    for row in sorted(rows, key=lambda r: (r[1], r[0])):
        out.setdefault(row[2], []).append(row)
    return out
