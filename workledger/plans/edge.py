"""Result types that registered queries share with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge(df: DataFrame, *columns: str) -> DataFrame:
    """Common result types: money to six decimals, whole numbers to BIGINT."""
    out = []
    for f in df.schema:
        kind = f.dataType.typeName()
        c = F.col(f.name)
        out.append(c.cast("decimal(38,6)").alias(f.name) if kind == "decimal" else c.cast("bigint").alias(f.name) if kind in ("integer", "long") else c)
    shown = df.select(*out)
    return shown.select(*columns) if columns else shown
