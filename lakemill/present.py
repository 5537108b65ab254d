"""Values as text, and result tables for the terminal."""

from __future__ import annotations

import datetime

import numpy as np


def text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return "NaN" if value != value else "inf" if value > 0 else "-inf"
        return np.format_float_positional(value, trim="-")
    return value.isoformat(sep=" ") if isinstance(value, datetime.datetime) else str(value)


def grid(columns: list[tuple[str, str]], rows: list[tuple]) -> str:
    """Aligned columns, numbers to the right."""
    cells = [[text(v) for v in r] for r in rows]
    widths = [max([len(n), *(len(r[i]) for r in cells)]) for i, (n, _) in enumerate(columns)]
    right = [t in ("BIGINT", "DOUBLE") for _, t in columns]
    line = lambda r: " | ".join(x.rjust(w) if a else x.ljust(w) for x, w, a in zip(r, widths, right, strict=True)).rstrip()
    head = " | ".join(n.center(w) for (n, _), w in zip(columns, widths, strict=True)).rstrip()
    count = f"({len(rows)} row{'s' * (len(rows) != 1)})"
    return "\n".join([" " + head, "-" + "-+-".join("-" * w for w in widths) + "-", *(" " + line(r) for r in cells), count])
