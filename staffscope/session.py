"""Session settings, small literal tables and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # one hot person, phrase or company is split even where the split costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tuned for. On a cluster leave `master` to spark-submit."""
    builder = SparkSession.builder.appName("staffscope")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def literal_table(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """A handful of fixed rows as a local relation: the planner knows its size and may broadcast it."""
    struct = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    columns = [[row[at] for row in rows] for at in range(len(struct))]
    arrow = to_arrow_schema(struct)
    table = pa.table([pa.array(values, type=field.type) for values, field in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, struct)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder lineage is cut into.

    The cluster names it in `spark.checkpoint.dir`. Where it is unset and driver and executors are one process, as in
    tests, a fresh temporary folder is named; anywhere else its absence is an error, as others could not read it back.
    """
    context = spark.sparkContext
    named = (context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
             or context.getConf().get("spark.checkpoint.dir"))
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
        named = tempfile.mkdtemp(prefix="staffscope-checkpoint-")
        context.setCheckpointDir(named)
    return named


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system: the default one of the cluster where it names none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return target.getFileSystem(conf).makeQualified(target).toString()


def made_folder(spark: SparkSession, path: str) -> str:
    """The same, and the folder is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(qualified(spark, path))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    return target.toString()


def cut_lineage(df: DataFrame, even: bool = False, at_once: int | None = None) -> DataFrame:
    """Write `df` once as a table in the checkpoint folder and go on from there.

    Unlike `checkpoint()` this computes the input a single time, and the planner sees the real size of the
    result. Losing an executor costs nothing that was written. `even` asks for files of like size, whatever the
    skew of the input: worth one exchange where a large table is read many times. `at_once` is for rows of megabytes: a
    reader unpacks so many together, not all that a file holds.
    """
    if even:
        df = df.hint("rebalance")
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    sized = {"parquet.block.row.count.limit": str(at_once)} if at_once else {}
    df.write.options(compression="zstd", **sized).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def laid_by(df: DataFrame, key: str, dealt: bool = False) -> DataFrame:
    """`cut_lineage` for a large table that is joined by `key` again and again: written in buckets of it, so that such joins
    and groupings find both sides in place and shuffle nothing. `dealt` says that the plan deals rows by the key already;
    the buckets are right in any case, only the number of files depends on it.

    For keys with few rows each: a bucket is read by one task. The table's name is known to this session only.
    """
    spark = df.sparkSession
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"laid_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    placed = df if dealt else df.repartition(buckets, key)
    placed.write.format("parquet").option("compression", "zstd").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return spark.table(name)


class LazyTables(Mapping):
    """Named DataFrames that are planned when first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers = makers
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self):
        return len(self._makers)


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """`df` with the columns of a frame that is one row by construction (an aggregate without keys)."""
    return df.crossJoin(scalars)
