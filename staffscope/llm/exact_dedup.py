"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the normalised text (each run of ASCII white space becomes
one space). New rows are reduced to one entry per digest before anything else moves, anti-joined to the index by sort
merge (the index side needs no exchange) and appended in the same buckets: what is new with the row it keeps, what is
known with the count of the batch. Reading adds the counts up.

Batches are numbered in the order they come and may be named by the caller. A batch sees what came before it and nothing
else: one that is given again, because its answer was lost after the index had taken it, replaces its entries and gives
the same answer.

Scale: texts are read once, only digests and row numbers travel. Counting combines on the map side, so copies in the
millions are one row per task; rows get their group's answer by a join that AQE may split on a hot digest.

Cases: null text is empty, and empty texts are equal to each other; white space at the ends is kept as one space; of
equal texts the row with the smallest known `doc_id` stays, of rows with that id one, and a group without any id keeps
one row; an empty table gives an empty result and adds nothing; other columns are not touched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpoint_dir, cut_lineage, made_folder
from .common import SPACE, chosen_rows, whole


class DigestIndex:
    """An index in `folder`, `buckets` fixed when it is made; another session finds it again by its folder."""

    COLUMNS = "digest binary, keep_id bigint, rows bigint, number int, batch string"

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.folder = made_folder(spark, folder or f"{checkpoint_dir(spark).rstrip('/')}/digests-{uuid.uuid4().hex}")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({self.COLUMNS}) USING parquet PARTITIONED BY (number, batch) "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'")
        spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def number(self, batch: str) -> int:
        """The place of a batch: where it was taken before, else behind all others."""
        rows = [row[0] for row in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()]
        held = {name: int(number) for number, name in (row.removeprefix("number=").split("/batch=") for row in rows)}
        return held.get(batch, max(held.values(), default=0) + 1)

    def stored(self, before: int | None = None) -> DataFrame:
        """An entry per content and batch, of the batches before a number if one is given."""
        rows = self.spark.table(self.name)
        return rows if before is None else rows.filter(F.col("number") < before)

    def entries(self, before: int | None = None) -> DataFrame:
        """Each digest once, with the row its first batch named and the rows of all batches."""
        return self.stored(before).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("rows").alias("rows"))

    def put(self, entries: DataFrame, batch: str, number: int) -> None:
        """The entries of a batch, in place of those it had."""
        placed = entries.select("digest", "keep_id", "rows").repartition(self.buckets, "digest").sortWithinPartitions("digest")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (number = {number}, batch = '{batch}') SELECT * FROM {{placed}}", placed=placed)
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Forgets the name; the files stay for the next session."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, lower-case hex."""
    return F.sha2(normalised(text).cast("binary"), 256)


def decide(rows: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """`rows` (row, doc_id, digest) with keep_id, group_size and kept; contents and how often they were met go into the index.

    A content that an earlier batch brought keeps the row named there, so none of the new rows is kept. `batch` names the
    batch (letters and digits): give it to make the call repeatable.
    """
    batch = batch or uuid.uuid4().hex
    if not batch.isalnum():
        raise ValueError("a batch is named by letters and digits")
    number = index.number(batch)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row"))
    groups = rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("rows"))
    groups = cut_lineage(groups.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "rows"))
    earlier = index.stored(number).hint("merge")
    fresh = cut_lineage(groups.hint("merge").join(earlier, "digest", "left_anti").select("digest", F.lit(True).alias("fresh")))
    groups = cut_lineage(groups.join(fresh, "digest", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False))))
    index.put(groups.withColumn("keep_id", F.when(F.col("fresh"), F.col("keep_id"))), batch, number)
    known = index.entries(number + 1).select("digest", F.col("keep_id").alias("known_id"), F.col("rows").alias("group_size"))
    answers = cut_lineage(groups.join(known, "digest").select("digest", F.col("known_id").alias("keep_id"), "keep_row", "fresh", "group_size"))
    return rows.join(answers, "digest").withColumn("kept", F.col("fresh") & (F.col("row") == F.col("keep_row")))


def dedup(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row."""
    return decide(_rows(docs), index, batch).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _rows(docs: DataFrame) -> DataFrame:
    """Written once, so that the row numbers hold."""
    return cut_lineage(docs.select("doc_id", F.unhex(digest(whole())).alias("digest"), F.monotonically_increasing_id().alias("row")))


def keep_new(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    stays = cut_lineage(decide(_rows(docs), index, batch).filter("kept").select("doc_id", "digest"))
    return chosen_rows(docs, stays, doc_id=F.col("doc_id"), digest=F.unhex(digest(whole()))).select("doc.*")
