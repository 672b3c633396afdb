"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, *by: str) -> None:
    """Parquet, in folders by the given columns."""
    (df.write.partitionBy(*by) if by else df.write).parquet(path)


def write_lines(df: DataFrame, path: str, compression: str = "none") -> None:
    """Text of the column value."""
    df.select("value").write.option("compression", compression).text(path)
