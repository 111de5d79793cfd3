"""Shared shapes: texts without nulls, rows that keep the caller's columns apart from the operator's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space, the only separators of words and of normalised text.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def same_text() -> Column:
    """A digest that tells texts of one document number apart."""
    return F.xxhash64(whole())


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """(doc, **columns): the caller's row as one struct, so that no name can clash with the operator's own."""
    every = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("doc")
    return docs.select(every, *[column.alias(name) for name, column in columns.items()])


def chosen_rows(docs: DataFrame, chosen: DataFrame, **keys: Column) -> DataFrame:
    """(doc, and what `chosen` has besides its keys): one row of `docs` for each row of `chosen`, found by `keys`, which
    may be null. Rows of `docs` that agree in all keys are one document.

    The keys are one struct, in which nulls are equal, so dropping repeats and joining share one exchange of the texts.
    """
    held = boxed(docs, _key=F.struct(*[column.alias(name) for name, column in keys.items()]))
    wanted = chosen.select(F.struct(*keys).alias("_wanted"), *[name for name in chosen.columns if name not in keys])
    one = held.dropDuplicates(["_key"])
    return one.join(wanted, one["_key"] == wanted["_wanted"]).drop("_key", "_wanted")
