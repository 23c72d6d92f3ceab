"""Console reports of small metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row


def metric_lines(row: Row, title: str = "Metrics", width: int = 60) -> list[str]:
    """A title and one line per metric, doubles with four digits."""
    bar = "=" * width
    body = [f"  {k:.<{width - 10}} {v:.4f}" if isinstance(v, float) else f"  {k:.<{width - 10}} {v}" for k, v in row.asDict().items()]
    return [bar, f"{title:^{width}}", bar, *body, bar]


def print_metrics(df: DataFrame, title: str = "Metrics", most: int = 100) -> None:
    for r in df.limit(most).collect():
        print("\n".join(metric_lines(r, title)))
