"""How finely ordered work is cut. Sizes change the number of pieces, never the form of a plan or what it accepts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Scale:
    """``chunk_rows``: rows aimed at per ordered chunk.
    ``bins``: histogram bins per open quantile; ``collected``: most bin rows brought to the driver."""

    chunk_rows: int = 2_000_000
    bins: int = 4_096
    collected: int = 400_000

    def chunks(self, rows: int) -> int:
        return max(1, -(-rows // self.chunk_rows))


DEFAULT = Scale()


def row_count(df: DataFrame) -> int:
    """Rows of a frame; for plain Parquet this is answered from the file footers."""
    return df.count()
