"""Stored answers by digest of what was asked: asked once, whoever asks again and in whatever session.

The cache is a table partitioned by identity (the standard or model that answers) and batch, bucketed and sorted by the
digest. A look-up is a sort-merge join whose cache side is read bucket by bucket, so what is stored is never shuffled,
however much it is. A batch is one writer's answers: written again it replaces itself, so a run that died between writing and
using its answers repeats the batch without leaving anything twice. Of several answers to one question the first
written holds. Compaction rewrites the batches of an identity as one, without what is superseded or no longer valid.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage, made_folder


class AnswerCache:
    """A cache in `folder`. Its number of buckets and the type of its answers are fixed when the folder is made.

    The table is named for this session only; `close` forgets the name, the files stay.
    """

    def __init__(self, spark: SparkSession, folder: str, answer: str = "string", buckets: int | None = None):
        self.spark, self.folder, self.answer = spark, made_folder(spark, folder), answer
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"answers_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (digest STRING, answer {answer}, written_at BIGINT, identity STRING, batch STRING) USING parquet "
                  f"PARTITIONED BY (identity, batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'")
        spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def stored(self, identity: str) -> DataFrame:
        """Every answer written for the identity."""
        return self.spark.table(self.name).filter(F.col("identity") == identity)

    def entries(self, identity: str, valid: Column | None = None) -> DataFrame:
        """(digest, answer): the first answer written to each question, of the valid ones. No exchange: digests of one
        value lie in one bucket."""
        rows = self.stored(identity).filter(F.coalesce(valid, F.lit(False))) if valid is not None else self.stored(identity)
        order = F.row_number().over(Window.partitionBy("digest").orderBy("written_at", "batch"))
        return rows.withColumn("_n", order).filter("_n = 1").select("digest", "answer")

    def batches(self, identity: str) -> list[str]:
        rows = self.spark.sql(f"SHOW PARTITIONS {self.name} PARTITION (identity = '{identity}')").collect()
        return [row[0].rsplit("batch=", 1)[1] for row in rows]

    def write(self, identity: str, answers: DataFrame, batch: str | None = None, written_at: int | None = None) -> str:
        """Store (digest, answer) as a batch, in place of what the batch held; its name."""
        batch = batch or uuid.uuid4().hex
        stamp = F.lit(time.time_ns() // 1000 if written_at is None else written_at).cast("long").alias("written_at")
        # names of batches and identities become folder names
        if not (identity + batch).replace("-", "").replace("_", "").replace(".", "").isalnum():
            raise ValueError("an identity or batch is made of letters, digits, '-', '_' and '.'")
        placed = (answers.select("digest", F.col("answer").cast(self.answer).alias("answer"), stamp)
                  .repartition(self.buckets, "digest").sortWithinPartitions("digest"))
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (identity = '{identity}', batch = '{batch}') SELECT * FROM {{placed}}", placed=placed)
        self.spark.catalog.refreshTable(self.name)
        return batch

    def look_up(self, asked: DataFrame, identity: str, valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """(known: digest, answer; missing: rows of `asked`) for `asked` (digest, ...), one row per digest."""
        held = self.entries(identity, valid)
        return (asked.select("digest").hint("merge").join(held, "digest"), asked.hint("merge").join(held.select("digest"), "digest", "left_anti"))

    def ask(self, df: DataFrame, identity: str, answer: Callable, valid: Column | None = None, batch: str | None = None) -> DataFrame:
        """(text, answer) of each distinct text of `df` (text); null where there is no valid answer.

        `answer` is a `mapInPandas` function from (text, digest) to (text, digest, answer). It gets the texts without a
        valid answer, and what it says is stored before it is used.
        """
        asked = df.select("text").filter("text is not null").distinct().withColumn("digest", F.sha2("text", 256))
        missing = self.look_up(asked, identity, valid)[1]
        said = missing.select("text", "digest").mapInPandas(answer, f"text string, digest string, answer {self.answer}").filter("answer is not null")
        self.write(identity, cut_lineage(said), batch)  # a table is not overwritten, not even a batch of it, by what reads it
        return asked.hint("merge").join(self.entries(identity, valid), "digest", "left").select("text", "answer")

    def compact(self, identity: str, valid: Column | None = None) -> None:
        """One batch instead of many. Batches written meanwhile stay; a run that dies in between leaves both, which
        says the same."""
        old = self.batches(identity)
        if not old:
            return
        rows = self.stored(identity).filter(F.col("batch").isin(old))
        rows = rows.filter(F.coalesce(valid, F.lit(False))) if valid is not None else rows
        order = F.row_number().over(Window.partitionBy("digest").orderBy("written_at", "batch"))
        first = cut_lineage(rows.withColumn("_n", order).filter("_n = 1").select("digest", "answer", "written_at"))
        earliest = first.agg(F.min("written_at")).first()[0]
        self.write(identity, first, f"compact-{uuid.uuid4().hex}", earliest)
        jvm = self.spark.sparkContext._jvm
        for batch in old:
            self.spark.sql(f"ALTER TABLE {self.name} DROP PARTITION (identity = '{identity}', batch = '{batch}')")
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/identity={identity}/batch={batch}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.spark.catalog.refreshTable(self.name)


def checked_vectors(dim: int) -> Column:
    """The condition under which a stored vector holds: vectors of another size are asked for again."""
    return F.size("answer") == dim
