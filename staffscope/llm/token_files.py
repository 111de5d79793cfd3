"""Token ids of a corpus in wavelet files, one per shard, in ascending document order.

Documents are dealt by ranges of `doc_id` (with a digest of the text behind it, so that one id held by very many rows
still spreads), sorted, encoded and written by the task that holds them; a task starts a new file when one is full, so
memory is bounded by a file and its longest document. Files are named anew by every attempt, and a manifest written by
Spark's committer lists those of the attempts that counted: a lost executor leaves an unlisted file, never a wrong row.
Files lie in a folder of the shared storage (`spark.checkpoint.dir` by default).

Only one row per file is ever added up in one place (the first token of each file).

Cases: null text is empty; an empty document holds the end id alone; null `doc_id`s come first and stay null; rows with
one `doc_id` stand together in the order of their texts' digests; other columns are not read; no rows, no files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import checkpoint_dir, cut_lineage, qualified
from . import wavelet
from .chunks import lower_word_memory, packed
from .common import whole

END = 1
FILE_TOKENS = 4_000_000
MANIFEST = "part int, file int, path string, documents long, tokens long"
ROW = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_files(docs: DataFrame, folder: str | None = None, tokenizer: str = "word_bpe_49k.json", end: int = END,
                file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the files and gives their manifest with `start`, the number of tokens in all files before."""
    spark = docs.sparkSession
    folder = qualified(spark, folder or f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = whole()
    placed = (docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_same"))
              .repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.col("_same"))
              .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("_same"))
              .select("doc_id", "text", F.spark_partition_id().alias("part")))
    manifest = cut_lineage(placed.mapInArrow(_writer(folder, tokenizer, end, file_tokens), MANIFEST))
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(parts).mapInArrow(_reader, ROW)


def open_file(path: str) -> wavelet.WaveletFile:
    """One file for lookups: `access`, `count`, `locate`."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as file:
        return wavelet.WaveletFile(file.read())


def _writer(folder: str, tokenizer: str, end: int, file_tokens: int):
    base = folder if "://" in folder else "file://" + folder.removeprefix("file:")  # Spark writes file:/path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(base)
        store.create_dir(top, recursive=True)
        memory = lower_word_memory(tokenizer)
        last, number = packed([end]), 0
        held, ids, counts, size = [], [], [], 0

        def flush(part: int) -> pa.RecordBatch:
            nonlocal number, size
            path = f"{top}/{part:05d}-{number:04d}-{uuid.uuid4().hex}.wavelet"
            data = wavelet.write(np.frombuffer(b"".join(held), np.uint32), ids, counts)
            with store.open_output_stream(path) as file:
                file.write(data)
            row = [part, number, f"{base}/{path.rsplit('/', 1)[1]}", len(ids), sum(counts)]
            number, size = number + 1, 0
            held.clear(), ids.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _MANIFEST_TYPES)], _MANIFEST_NAMES)

        part = 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for doc_id, kept in zip(batch.column("doc_id").to_pylist(), memory.encode(batch.column("text").to_pylist())):
                held.append(b"".join(kept) + last)
                ids.append(doc_id)
                counts.append(len(held[-1]) // 4)
                size += counts[-1]
                if size >= file_tokens:
                    yield flush(part)
        if ids:
            yield flush(part)
    return run


_MANIFEST_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
_MANIFEST_NAMES = ["part", "file", "path", "documents", "tokens"]


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            file = open_file(path)
            doc_ids, counts = file.table()
            ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            plain = memoryview(file.tokens().astype("<u4").tobytes())
            crcs = [zlib.crc32(plain[4 * int(a):4 * int(b)]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(ends[:-1] + start), pa.array(counts.astype(np.int64)),
                 pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
