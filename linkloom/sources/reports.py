"""Small result frames as Markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def markdown(title: str, results: DataFrame, limit: int = 200) -> str:
    """A heading and a table of at most ``limit`` rows, for frames of one row a route or experiment."""
    rows = results.limit(limit).collect()
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(results.columns) + " |", "|" + "---|" * len(results.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"
