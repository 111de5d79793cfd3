"""Near-duplicates by SimHash: a byte-position inverted index with count filtering.

A fingerprint is 64 bits from the XXH64 of all word shingles. Fingerprints that differ in at most 3 bits differ in at
most 3 of their 8 bytes, so a pair has to share at least 5 positional bytes: that is the guaranteed minimum of the
count filter. Lists of single bytes would hold 1/256 of all fingerprints each and be read pairwise, so the index keeps
them intersected: a posting list per set of 5 positions and their 5 bytes (56 sets), in which every pair of the required
tally occurs. In a list, the positional bytes each pair shares are tallied, pairs that reach the minimum are retained, and
those are verified by their bits.

Scale: texts are read once and never shuffled; equal fingerprints are one entry before the index, so a group of copies
of any size is one row. A posting list can hold at most 2**24 fingerprints, whatever the corpus; a list is not paired
out: in short ones each entry meets those not reached yet, long ones are probed with all 2,324 patterns of up to 3 bits
in 24, which is linear; either yields one link per entry at most. Tasks reduce what they find to a forest (a link per fingerprint at most); links go through a distributed
connected-components job. Nothing of the corpus reaches the driver.

Cases: null, empty and blank texts have fingerprint zero and link like any other; texts of fewer words than a shingle
are one shingle; repeated rows are rows; a null `doc_id` keeps its row, and its component is named by the smallest known
id, null if there is none; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.graph import connected_components
from ..session import cut_lineage
from .common import chosen_rows, same_text, whole

SHINGLE, SEED, BITS = 3, 42, 3
#: Positions that must agree, and all their sets; positions are bytes of the fingerprint from the lowest.
SHARED = 8 - BITS
SETS = tuple(combinations(range(8), SHARED))
#: Lists up to this length are searched by comparing, longer ones by probing; both find the same groups.
PAIRWISE = 4096
#: Most shingles whose bits are counted at once.
COUNTED = 1 << 16
PATTERNS = np.array([sum(1 << b for b in bits) for n in range(1, BITS + 1) for bits in combinations(range(24), n)], np.uint32)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a text; zero without words."""
    import xxhash
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[at:] for at in range(shingle))))
    number = max(1, len(words) - shingle + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, number, COUNTED):
        size = min(COUNTED, number - at)
        hashes = np.fromiter((digest(next(shingles), SEED) for _ in range(size)), np.uint64, size)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (2 * ones > number).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of each text as a signed 64-bit integer."""
    @F.arrow_udf("long")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(np.array([fingerprint(t or "", shingle) for t in batch.to_pylist()], np.uint64).view(np.int64))
    return of(text)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): pairs of fingerprints within `BITS` bits that connect all that are connected. `distinct` has each `fp` once."""
    masks = [sum(0xFF << 8 * at for at in chosen) for chosen in SETS]
    keys = F.array(*[F.struct(F.lit(n).alias("set"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("bytes"))
                     for n, mask in enumerate(masks)])
    lists = distinct.select("fp", F.explode(keys).alias("key")).select("key.set", "key.bytes", "fp")
    placed = lists.repartition("set", "bytes").sortWithinPartitions("set", "bytes")
    return placed.mapInArrow(_links_of_lists, "a long, b long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _links_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the posting lists of a task, which arrive one after the other."""
    forest = _Forest()
    last, rest = None, []  # the list that may go on in the next batch
    for batch in batches:
        sets, known, fps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("set", "bytes", "fp"))
        if not len(fps):
            continue
        starts = np.flatnonzero(np.concatenate([[True], (sets[1:] != sets[:-1]) | (known[1:] != known[:-1])]))
        ends = np.append(starts[1:], len(fps))
        if last != (sets[0], known[0]):
            forest.connect(last, rest)
            rest = []
        rest.append(fps[:ends[0]])
        last = (sets[0], known[0])
        if len(starts) > 1:
            forest.connect(last, rest)
            for at in np.flatnonzero(ends[1:-1] - starts[1:-1] > 1) + 1:
                forest.connect((sets[starts[at]], known[starts[at]]), [fps[starts[at]:ends[at]]])
            rest, last = [fps[starts[-1]:]], (sets[starts[-1]], known[starts[-1]])
    forest.connect(last, rest)
    yield pa.RecordBatch.from_arrays([pa.array(forest.a, pa.int64()), pa.array(forest.b, pa.int64())], ["a", "b"])


class _Forest:
    """Links between fingerprints, kept only where they join two trees."""

    def __init__(self):
        self.a: list[int] = []
        self.b: list[int] = []
        self._up: dict[int, int] = {}

    def _root(self, node: int) -> int:
        up = self._up
        while (above := up.get(node, node)) != node:
            up[node] = node = up.get(above, above)
        return node

    def _link(self, one: int, other: int) -> bool:
        """Whether the link joined two trees."""
        a, b = self._root(one), self._root(other)
        if a != b:
            self._up[max(a, b)] = min(a, b)
            self.a.append(one)
            self.b.append(other)
        return a != b

    def connect(self, key, pieces: list[np.ndarray]) -> None:
        fps = np.concatenate(pieces) if pieces else np.empty(0, np.int64)
        if len(fps) < 2:
            return
        for one, other in (_pairwise(fps) if len(fps) <= PAIRWISE else _probed(fps, SETS[int(key[0])])):
            self._link(one, other)


def _tally(differ: int) -> int:
    """Positional bytes that two fingerprints share, by the bits in which they differ."""
    return sum(not differ >> at & 0xFF for at in range(0, 64, 8))


def _near(differ: np.ndarray) -> np.ndarray:
    """Which candidates are near: those whose tally of shared positional bytes reaches the minimum are verified by bits."""
    near = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1, dtype=np.int8) >= SHARED
    near[near] = np.bitwise_count(differ[near]) <= BITS
    return near


def _pairwise(fps: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that connect what is near in a list: each fingerprint is compared once with those not reached so far."""
    if len(fps) == 2:
        one, other = fps.view(np.uint64).tolist()
        if _tally(one ^ other) >= SHARED and (one ^ other).bit_count() <= BITS:
            yield int(fps[0]), int(fps[1])
        return
    apart = fps.view(np.uint64)
    while len(apart):
        reached, apart = [apart[0]], apart[1:]
        while reached and len(apart):
            one = reached.pop()
            near = _near(apart ^ one)
            if near.any():
                found = apart[near]
                apart = apart[~near]
                reached.extend(found)
                for other in found.view(np.int64):
                    yield int(one.view(np.int64)), int(other)


def _probed(fps: np.ndarray, shared: tuple[int, ...]) -> Iterator[tuple[int, int]]:
    """The same for a long list: its 3 free bytes index a table in which each pattern of up to 3 bits is looked up, and
    the smallest position reached spreads until nothing changes."""
    values, free = fps.view(np.uint64), [at for at in range(8) if at not in shared]
    own = np.zeros(len(values), np.uint32)
    for place, at in enumerate(free):
        own |= ((values >> np.uint64(8 * at)) & np.uint64(0xFF)).astype(np.uint32) << np.uint32(8 * place)
    where = np.full(1 << 24, -1, np.int32)
    where[own] = np.arange(len(own), dtype=np.int32)
    smallest = np.arange(len(own), dtype=np.int32)
    while True:
        before = smallest.copy()
        for pattern in PATTERNS:
            other = where[own ^ pattern]
            met = other >= 0
            smallest[met] = np.minimum(smallest[met], smallest[other[met]])
        smallest = smallest[smallest]
        if np.array_equal(before, smallest):
            break
    for at in np.flatnonzero(smallest != np.arange(len(own))):
        yield int(fps[at]), int(fps[smallest[at]])


def components(fps: DataFrame) -> DataFrame:
    """(fp, label) of each fingerprint that is linked to another; the label is the smallest one reachable."""
    found = cut_lineage(links(fps.select("fp").distinct()))
    return connected_components(found).select(F.col("node").alias("fp"), F.col("component").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row."""
    return _labelled(cut_lineage(docs.select("doc_id", fingerprints(whole()).alias("fp")))).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _labelled(fps: DataFrame) -> DataFrame:
    """Rows with `doc_id` and `fp` get the `component_id` and its `label`."""
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    groups = distinct.join(components(distinct), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    groups = cut_lineage(groups)
    named = groups.groupBy("label").agg(F.min("first").alias("component_id"))
    of_fp = cut_lineage(groups.select("fp", "label").join(named, "label"))
    return fps.join(of_fp, "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of each component the row with the smallest `doc_id` (of
    rows with that id, or of rows without any id, one)."""
    fps = cut_lineage(docs.select("doc_id", same_text().alias("same"), fingerprints(whole()).alias("fp")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "same")).alias("first")
    stays = cut_lineage(_labelled(fps).groupBy("label").agg(first).select("first.doc_id", "first.same"))
    return chosen_rows(docs, stays, doc_id=F.col("doc_id"), same=same_text()).select("doc.*")
