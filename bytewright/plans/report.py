"""The report of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.recompress import savings


def _size(n: float) -> str:
    unit = ""
    for nxt in "KMG":
        if n <= 1024:
            break
        n, unit = n / 1024, nxt
    return f"{n:.2f}{unit}B" if unit else f"{int(n)}B"


def report(results: DataFrame) -> str:
    """Files, savings and share, in words."""
    row = savings(results, []).first()
    if not row.files:
        return "No compatible files found"
    files = f"Processed {row.files} file{'s' if row.files != 1 else ''}"
    if row.saved < 0:
        return f"{files}\nResult is bigger"
    return f"{files}\nSaved {_size(row.saved)} out of {_size(row.bytes)} ({row.pct:.4f}%)"
