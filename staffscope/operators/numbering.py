"""Row numbers over data that does not fit one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage


def numbered(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "n") -> DataFrame:
    """`n` from 1 in `order` within each `by` group, whatever the size of a group.

    Rows are range-partitioned by the order, numbered inside their partition and shifted by the number of rows
    the earlier partitions hold. Only one small row per partition and group is added up in a single place.
    """
    by = by or []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    placed = cut_lineage(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part", *by).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_part", *by, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    return (placed.withColumn("_inside", inside).join(shifts, ["_part", *by])
            .withColumn(name, F.col("_inside") + F.col("_shift")).drop("_part", "_inside", "_shift"))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> tuple[DataFrame, dict]:
    """One page and its place: a number out of range is brought to the last page."""
    total = df.count()
    pages = max(1, -(-total // size))
    at = min(max(number, 1), pages)
    rows = df.orderBy(*order).offset((at - 1) * size).limit(size)
    return rows, {"page": at, "pages": pages, "total": total, "from": (at - 1) * size + 1 if total else 0}
