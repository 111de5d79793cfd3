"""Exact nearest words by cosine: the pool in blocks around pivots, of which only those that may matter are searched."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import NEIGHBOURS
from ..session import cut_lineage

#: Words of a block, and most pivots: their vectors are sent to every task.
BLOCK_ROWS, PIVOTS = 10_000, 1024
#: Cosines this near to a bound are looked at: products in blocks differ in the last digits.
MARGIN = 1e-9
#: Due words compared with a block at once.
AT_ONCE = 256


def unit(col: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    wide = F.transform(col, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda total, x: total + x * x))
    return F.transform(wide, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _to_pivots(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """`df` with `cosines`, an array with one to each pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.clip(_matrix(batch.column("v")) @ pivots.T, -1.0, 1.0)
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(pivots))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], [*batch.schema.names, "cosines"])
    kinds = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in df.schema)
    return df.mapInArrow(run, f"{kinds}, cosines array<double>")


def _search(k: int):
    """Best k of a block for each due word; a block's words arrive first, then the due words sent to it, in batches."""
    def best(names, order, matrix, rows) -> Iterator[pa.RecordBatch]:
        words, vectors = rows.column("word").to_pylist(), _matrix(rows.column("v"))
        out = [[], [], [], []]
        for start in range(0, len(words), AT_ONCE):
            rough = vectors[start:start + AT_ONCE] @ matrix.T
            for at, word in enumerate(words[start:start + AT_ONCE]):
                near = np.flatnonzero(names != word)
                if len(near) > k:
                    least = np.partition(rough[at, near], len(near) - k)[len(near) - k]
                    near = near[rough[at, near] >= least - MARGIN]
                # the product row by row does not depend on the block, so equal vectors score equally
                exact = (matrix[near] * vectors[start + at]).sum(axis=1)
                chosen = near[np.lexsort((order[near], -exact))[:k]]
                score = dict(zip(near.tolist(), exact.tolist()))
                for column, values in zip(out, ([word] * len(chosen), names[chosen], order[chosen], [score[n] for n in chosen.tolist()])):
                    column.extend(values)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64())],
                                         ["word", "near", "pos", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ready = None, [], None
        for batch in batches:
            blocks, due = batch.column("block").to_numpy(), batch.column("due").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (due[1:] != due[:-1])])) if len(blocks) else []
            for start, end in zip(starts, [*starts[1:], len(blocks)]):
                rows = batch.slice(start, end - start)
                if blocks[start] != block:
                    block, held, ready = blocks[start], [], None
                if not due[start]:
                    held.append(rows)
                elif held:
                    if ready is None:
                        table = pa.Table.from_batches(held).combine_chunks()
                        ready = (np.array(table.column("word").to_pylist(), object), np.array(table.column("pos").to_pylist(), object),
                                 np.concatenate([_matrix(part) for part in table.column("v").chunks]))
                    yield from best(*ready, rows)
    return run


def nearest(pool: DataFrame, due: DataFrame, k: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(word, near, place, score): the k pool words nearest each due word, itself left out.

    The pool holds (word, embedding, pos), due words (word, embedding); `pos`, a text, is the order that decides ties.
    Pool words lie in blocks around the pivot they are nearest to, of about `block_rows` words. A due word is first
    compared with the blocks around its own nearest pivots; its k-th score there is a bound, and of the other blocks only
    those are searched that can hold a better one: a block's words lie within an angle of its pivot, so none is nearer to
    the due word than the angle between that and the pivot, less this angle. The pool is shuffled once, by block; due
    words go to the blocks that are left. A task holds one block and streams what is sent to it, and returns k rows per
    due word. The driver sees the pivots' vectors (at most `PIVOTS`) and a row per block.
    """
    pool = cut_lineage(pool.select("word", unit(F.col("embedding")).alias("v"), "pos"))
    due = cut_lineage(due.select("word", unit(F.col("embedding")).alias("v")))
    number = min(max(1, -(-pool.count() // block_rows)), PIVOTS)
    chosen = pool.orderBy(F.xxhash64("word"), "word").select("v").limit(number).collect()
    if not chosen:
        return due.sparkSession.createDataFrame([], "word string, near string, place int, score double")
    pivots = np.array([row.v for row in chosen])
    placed = _to_pivots(pool, pivots)
    cosine = F.array_max("cosines")
    pivot = (F.array_position("cosines", cosine) - 1).cast("int")
    placed = cut_lineage(placed.select("word", "v", "pos", pivot.alias("pivot"), cosine.alias("cosine")))
    sizes = {row.pivot: row["count"] for row in placed.groupBy("pivot").count().collect()}
    # a pivot with more words than a block holds has several
    parts = F.element_at(F.array(*[F.lit(max(1, -(-sizes.get(at, 0) // block_rows))) for at in range(number)]), F.col("pivot") + 1)
    # sizes of blocks vary a little: words are dealt by their hash
    block = F.col("pivot") * F.lit(1 << 20) + F.pmod(F.xxhash64("word"), parts).cast("int")
    placed = cut_lineage(placed.withColumn("block", block))
    blocks = placed.groupBy("block").agg(F.first("pivot").alias("pivot"), F.min("cosine").alias("cosine"), F.count("*").alias("rows")).orderBy("block").collect()
    to_pivot = np.array([row.pivot for row in blocks])
    angle = np.arccos(np.clip([row.cosine for row in blocks], -1, 1))
    rows, names = np.array([row["rows"] for row in blocks]), np.array([row.block for row in blocks])

    def homes(found: np.ndarray) -> list[list[int]]:
        """Per due word the blocks of its nearest pivots, until they hold more than k words."""
        out = []
        for row in found:
            order = np.argsort(-row[to_pivot], kind="stable")
            enough = int(np.searchsorted(np.cumsum(rows[order]), k, "right")) + 1
            out.append(names[order[:enough]].tolist())
        return out

    def others(found: np.ndarray, bound: np.ndarray, been: list[list[int]]) -> list[list[int]]:
        """Per due word the other blocks that may hold a word as near as its bound."""
        nearest_angle = np.maximum(0.0, np.arccos(np.clip(found, -1, 1))[:, to_pivot] - angle)
        may = np.cos(nearest_angle) >= bound[:, None] - MARGIN
        return [sorted(set(names[row].tolist()) - set(seen)) for row, seen in zip(may, been)]

    def sent(choose, *columns: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    lists = choose(_matrix(batch.column("cosines")), *(batch.column(c).to_numpy() if c == "bound" else batch.column(c).to_pylist() for c in columns))
                    yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("v"), batch.column("cosines"), pa.array(lists, pa.list_(pa.int32()))],
                                                     ["word", "v", "cosines", "blocks"])
        return run
    shape = "word string, v array<double>, cosines array<double>, blocks array<int>"
    left = placed.select("block", F.lit(False).alias("due"), "word", "v", "pos")

    def searched(asked: DataFrame) -> DataFrame:
        to = asked.select(F.explode("blocks").alias("block"), F.lit(True).alias("due"), "word", "v", F.lit("").alias("pos"))
        wanted = left.join(to.select("block").distinct(), "block", "left_semi").unionByName(to)
        return cut_lineage(wanted.repartition("block").sortWithinPartitions("block", "due").mapInArrow(_search(k), "word string, near string, pos string, score double"))
    asked = cut_lineage(_to_pivots(due, pivots).mapInArrow(sent(homes), shape))
    first = searched(asked)
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "pos"))
    best = first.withColumn("place", place).filter(F.col("place") <= k)
    bounds = best.groupBy("word").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(-2.0)).alias("bound"))
    more = asked.withColumnRenamed("blocks", "been").join(bounds, "word", "left").withColumn("bound", F.coalesce("bound", F.lit(-2.0)))
    again = cut_lineage(more.mapInArrow(sent(others, "bound", "been"), shape))
    found = best.drop("place").unionByName(searched(again.filter(F.size("blocks") > 0)))
    return found.withColumn("place", place).filter(F.col("place") <= k).select("word", "near", "place", "score")
