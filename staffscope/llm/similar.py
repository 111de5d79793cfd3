"""Near-duplicates by exact shingle similarity: the SimHash index and a prefix filter over all word shingles, candidates verified on whole sets.

At a Jaccard similarity of 0.8 two SimHashes differ in about 10 of 64 bits, too many for a guaranteed minimum of shared
bytes, so this stage compares the shingles themselves. Shingles stand in one order, rare ones first. Two sets of
similarity `p/q` or more share one of the first `n - ceil(n p / q) + 1` shingles of each: a pair that is similar enough
shares a posting list, and none is missed. Parities of the sets, two to four bits a shingle, rule out candidates that
differ in too much; the others are verified by the sizes of their sets and of the intersection. Shingles and texts are
told apart by 64-bit hashes.

First the SimHash index (`simhash.links`, fingerprints of the same shingles) names pairs: near copies of few different bits,
verified like any other pair. The prefix filter finds what 3 bits of 64 miss.

Scale: lists of one text, nearly all, end in the task that meets them. Each longer list first pairs its texts with its
shortest one, each text with the shortest of all it meets, which joins a group of copies in linear work. Lists that still hold several components are then searched
where they lie, with the parities of their texts beside them: of the pairs that may be similar a list gives as many as
connect them, one per component at most, not all of them, and lists of one task do not repeat each other's. Once these are verified, what may be similar and is not
connected yet, which is little, is given in full; so every pair is compared or connected by others. Long lists are cut in
chunks that meet pairwise, so no task holds more than two. The order comes from counts in a sample: it decides what lists
hold, never what is found. At most `RANKED` counts reach the driver. Only texts in pairs that are left are read as sets.

Cases: texts of fewer words than a shingle are one shingle, and texts without words are equal to each other; a very long
text has more and longer rows but passes like any other; words are cut at ASCII white space, and A-Z are small; null
`doc_id` and repeated rows as in `simhash.keep_one`; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import connected_components
from ..operators.numbering import numbered
from ..session import cut_lineage
from . import simhash
from .common import chosen_rows, same_text, whole

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: One text in so many is counted for the order; a shingle met so often in them is common; most common ones told apart.
SAMPLE, COMMON, RANKED = 16, 4, 1 << 17
#: Pairs, and postings, that a task gathers before it passes them on.
GATHERED = 1 << 18
#: Texts of a list that are compared as a whole; longer lists in chunks of so many.
LIST = 2048


def shingles(text: str, size: int) -> np.ndarray:
    """The distinct shingles of a text, as sorted hashes; one at least."""
    import xxhash
    words = text.encode("utf-8", "surrogatepass").lower().split()
    number = max(1, len(words) - size + 1)
    joined = map(b" ".join, zip(*(words[at:] for at in range(size)))) if len(words) >= size else iter([b" ".join(words)])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(one, SEED) for one in joined), np.uint64, number))


def _keys(hashes: np.ndarray) -> np.ndarray:
    """What lists are named by: half a hash. Shingles that share it share a list, and candidates are verified."""
    return (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _common(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of common lists in order, and how often each was met in the sample."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_keys(shingles(text, size)))], ["key"])
    sample = texts.filter(F.pmod(F.shiftright("same", 7), F.lit(SAMPLE)) == 0).select("text")
    met = sample.mapInArrow(counted, "key int").groupBy("key").count().filter(F.col("count") >= COMMON)
    top = sorted((row.key, row["count"]) for row in met.orderBy(F.desc("count"), "key").limit(RANKED).collect())
    return np.array([key for key, _ in top], np.int32), np.array([count for _, count in top], np.int64)


def _parities(hashes: np.ndarray) -> bytes:
    """A bit per place, odd or even number of hashes there; two places a hash at least, a power of two."""
    places = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _apart(one: bytes, other: bytes) -> int:
    """At most the number of hashes that only one of two sets has: places where their parities differ."""
    x, y = sorted((np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def _read(texts: DataFrame, size: int, least: Fraction) -> DataFrame:
    """(key, same, n, parities): a row per posting, and for each text one without a key that has its parities."""
    names, counts = _common(texts, size)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sames, sizes, maps, held = [], [], [], [], 0

        def out() -> list[pa.RecordBatch]:
            each = [len(k) for k in keys]
            same, n = np.array(sames, np.int64), np.array(sizes, np.int32)
            lists = pa.array(np.concatenate([*keys, np.empty(0, np.int32)]))
            names_of = ["key", "same", "n", "parities"]
            return [pa.RecordBatch.from_arrays([lists, pa.array(np.repeat(same, each)), pa.array(np.repeat(n, each)), pa.nulls(len(lists), pa.binary())], names_of),
                    pa.RecordBatch.from_arrays([pa.nulls(len(same), pa.int32()), pa.array(same), pa.array(n), pa.array(maps, pa.binary())], names_of)]
        for batch in batches:
            for same, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = shingles(text, size)
                n, key = len(hashes), _keys(hashes)
                first = n - -(-n * least.numerator // least.denominator) + 1
                rank = np.zeros(n, np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, key), len(names) - 1)
                    rank = np.where(names[at] == key, counts[at], 0)
                keys.append(np.unique(key[np.lexsort((hashes, key, rank))[:first]]))
                sames.append(same)
                sizes.append(n)
                maps.append(_parities(hashes))
                held += first
                if held > GATHERED:
                    yield from out()
                    keys, sames, sizes, maps, held = [], [], [], [], 0
        yield from out()
    return cut_lineage(texts.mapInArrow(rows, "key int, same long, n int, parities binary"))


def _shared(read: DataFrame) -> DataFrame:
    """(key, same, n): the posting lists that hold more than one text."""
    placed = read.filter("key is not null").select("key", "same", "n").repartition("key").sortWithinPartitions("key")
    return cut_lineage(cut_lineage(placed.mapInArrow(_longer_lists, "key int, same long, n int")).distinct())


def _longer_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lists of two or more, which arrive one after the other."""
    rest = None  # the last row met, which may go on in the next batch, and whether its list is long already
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if rest is None else [rest[0], batch]).combine_chunks()
        key = table.column("key").to_numpy()
        equal = key[1:] == key[:-1]
        long = np.concatenate([[rest is not None and rest[1]], equal]) | np.concatenate([equal, [False]])
        rest = (table.slice(len(key) - 1).to_batches()[0], bool(long[-1]))
        yield from table.slice(0, len(key) - 1).filter(pa.array(long[:-1])).to_batches()
    if rest is not None and rest[1]:
        yield rest[0]


def _open_lists(labelled: DataFrame, read: DataFrame, least: Fraction) -> DataFrame:
    """(key, i, j, chunk, same, n, label, parities): the lists that hold several components, each text with its parities.

    A list of up to `LIST` texts is (i, j) = (0, 0). A longer one is cut by size in chunks of so many, and each two chunks
    whose sizes allow the similarity are a task's work, so none grows with the list.
    """
    p, q = least.numerator, least.denominator
    members = [F.bit_xor(F.xxhash64(F.lit(seed), "same")).alias(f"x{seed}") for seed in (1, 2)]
    mixed = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("rows"), *members).filter("least <> most")
    # shingles of one passage have the same texts: of lists with equal members one is enough
    one = mixed.groupBy("rows", "x1", "x2").agg(F.min("key").alias("key"))
    known = cut_lineage(labelled.join(one.select("key", "rows"), "key"))
    long = numbered(known.filter(F.col("rows") > LIST).drop("rows"), [F.col("n"), F.col("same")], by=["key"], name="number")
    cut = cut_lineage(long.withColumn("chunk", F.floor((F.col("number") - 1) / LIST).cast("int")).drop("number"))
    bounds = cut.groupBy("key", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    spans = bounds.groupBy("key").agg(F.collect_list(F.struct("chunk", "low", "high")).alias("chunks"))
    own = cut.join(bounds, ["key", "chunk"]).join(spans, "key")
    meets = F.filter("chunks", lambda other: (other["low"] * p <= F.col("high") * q) & (F.col("low") * p <= other["high"] * q))
    spread = own.select("key", F.explode(meets).alias("other"), "chunk", "same", "n", "label")
    blocks = spread.select("key", F.least("chunk", "other.chunk").alias("i"), F.greatest("chunk", "other.chunk").alias("j"), "chunk", "same", "n", "label")
    none = F.lit(0)
    whole_lists = known.filter(F.col("rows") <= LIST).select("key", none.alias("i"), none.alias("j"), none.alias("chunk"), "same", "n", "label")
    maps = read.filter("key is null").dropDuplicates(["same"]).select("same", "parities")
    return whole_lists.unionByName(blocks).join(maps, "same")


def _hits(n: np.ndarray, chunk: np.ndarray, maps: list[bytes], least: Fraction) -> Iterator[tuple[int, np.ndarray]]:
    """Per text of a list, by size, the later ones that sizes and parities allow to be similar to it.

    Maps are powers of two long, so those of texts whose sizes allow the similarity are equal or one is twice the other.
    """
    p, q = least.numerator, least.denominator
    widths = np.array([len(one) for one in maps])
    for width in np.unique(widths):
        short, long = np.flatnonzero(widths == width), np.flatnonzero(widths == 2 * width)
        first = np.frombuffer(b"".join(maps[at] for at in short), np.uint64).reshape(len(short), -1)
        folded = np.frombuffer(b"".join(maps[at] for at in long), np.uint64).reshape(len(long), 2, first.shape[1])
        every, held = np.concatenate([short, long]), np.concatenate([first, folded[:, 0] ^ folded[:, 1]])
        for at, row in enumerate(short):
            until = int(np.searchsorted(n[every], n[row] * q // p, "right"))
            apart = np.bitwise_count(held[at + 1:until] ^ held[at]).sum(axis=1, dtype=np.int64)
            others = every[at + 1:until]
            fits = (apart * (p + q) <= (n[others] + n[row]) * (q - p)) & ((chunk[others] != chunk[row]) if chunk[0] != chunk[-1] else True)
            if fits.any():
                yield int(row), others[fits]


def _crossing(least: Fraction, every: bool):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of a list of different components that may be similar: enough to connect all that may be, or all of them.
        Lists arrive one after the other, by size. What one list of the task has connected the next does not connect
        again; a list that holds nothing else is named in a row without a pair."""
        last, rest, found, held, forest = None, [], [], 0, simhash._Forest()

        def out() -> pa.RecordBatch:
            made = np.unique(np.concatenate([*found, np.empty((0, 3), np.int64)]), axis=0)
            bare = made[:, 0] == made[:, 1]
            return pa.RecordBatch.from_arrays([pa.array(made[:, 0], mask=bare), pa.array(made[:, 1], mask=bare), pa.array(made[:, 2].astype(np.int32))], ["a", "b", "key"])

        def met() -> Iterator[np.ndarray]:
            if not rest:
                return
            table = pa.concat_tables(rest)
            same, n, chunk = (table.column(name).to_numpy().astype(np.int64) for name in ("same", "n", "chunk"))
            label = table.column("label").to_numpy()
            _, part = np.unique(label, return_inverse=True)
            named = False
            for row, others in _hits(n, chunk, table.column("parities").to_pylist(), least):
                others = others[part[others] != part[row]]
                if not every and len(others):
                    merged, at = np.unique(part[others], return_index=True)  # one link to each component not met yet
                    others = others[at]
                    part[np.isin(part, merged)] = part[row]
                    new = [forest._link(int(label[row]), int(label[other])) for other in others]
                    if not (named or any(new)):
                        yield np.array([[0, 0, last[0]]])
                    named, others = True, others[new]
                if len(others):
                    yield np.stack([np.minimum(same[others], same[row]), np.maximum(same[others], same[row]), np.full(len(others), last[0])], axis=1)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = np.stack([batch.column(name).to_numpy() for name in ("key", "i", "j")], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]).any(axis=1)])) if len(names) else []
            for start, end in zip(starts, [*starts[1:], len(names)]):
                if last is None or (names[start] != last).any():
                    for some in met():
                        found.append(some)
                        held += len(some)
                        if held > GATHERED:
                            yield out()
                            found, held = [], 0
                    last, rest = names[start], []
                rest.append(table.slice(start, end - start))
        for some in met():
            found.append(some)
            held += len(some)
            if held > GATHERED:
                yield out()
                found, held = [], 0
        yield out()
    return pairs


def _possible(pairs: DataFrame, read: DataFrame, least: Fraction) -> DataFrame:
    """The pairs whose parities do not rule the similarity out."""
    p, q = least.numerator, least.denominator

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "of_a", "of_b"))
            fits = [_apart(x, y) * (p + q) <= (n + m) * (q - p) for n, m, x, y in zip(*columns)]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))
    maps = read.filter("key is null").dropDuplicates(["same"])
    one, other = (maps.select(F.col("same").alias(name), F.col("n").alias(f"n_{name}"), F.col("parities").alias(f"of_{name}")) for name in "ab")
    return cut_lineage(pairs.join(one, "a").join(other, "b").mapInArrow(kept, "a long, b long"))


def _verified(texts: DataFrame, pairs: DataFrame, size: int, least: Fraction) -> DataFrame:
    """The pairs whose similarity is `least` or more, by whole sets."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = pa.array([shingles(text, size).view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([same], pa.int64()), held], ["same", "held"])
    named = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("same")).distinct())
    sets = cut_lineage(texts.join(named, "same", "left_semi").dropDuplicates(["same"]).select("same", "text")
                       .mapInArrow(read, "same long, held array<long>"))
    one, other = (sets.select(F.col("same").alias(name), F.col("held").alias(f"of_{name}")) for name in "ab")
    both = pairs.join(one, "a").join(other, "b")
    p, q = least.numerator, least.denominator
    shared = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    return cut_lineage(both.filter(shared * (p + q) >= (F.size("of_a") + F.size("of_b")).cast("long") * p).select("a", "b"))


def _by_fingerprint(texts: DataFrame, size: int) -> DataFrame:
    """(a, b): texts the SimHash index links, to be verified like other pairs. Of texts with one fingerprint the smallest
    stands for it and is paired with each of the others: a link per text, and one per link of the index."""
    rows = cut_lineage(texts.select("same", simhash.fingerprints(F.col("text"), size).alias("fp")).distinct())
    first = cut_lineage(rows.groupBy("fp").agg(F.min("same").alias("first")))
    alike = rows.join(first, "fp").filter(F.col("same") != F.col("first")).select(F.col("first").alias("a"), F.col("same").alias("b"))
    near = cut_lineage(simhash.links(first.select("fp")))
    of = lambda end: first.select(F.col("fp").alias(end), F.col("first").alias(f"_{end}"))
    linked = near.join(of("a"), "a").join(of("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return alike.unionByName(linked)


def components(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(same, label) of each text that is similar to another; `same` names a text, the label is the smallest one reachable."""
    least = Fraction(str(similarity))
    texts = docs.select(same_text().alias("same"), whole().alias("text"))
    read = _read(texts, shingle, least)
    shared = _shared(read)
    heads = shared.groupBy("key").agg(F.min(F.struct("n", "same")).alias("head"))
    fits = F.col("head.n") * F.lit(least.denominator).cast("long") >= F.col("n") * F.lit(least.numerator).cast("long")
    to_head = shared.join(heads, "key").filter((F.col("same") != F.col("head.same")) & fits)
    # of all heads it meets a text tries the shortest: a link per text, however many lists it is in
    best = to_head.groupBy("same").agg(F.min("head").alias("head"))
    heads = best.select(F.least("same", "head.same").alias("a"), F.greatest("same", "head.same").alias("b"))
    tried = cut_lineage(_by_fingerprint(texts, shingle).unionByName(heads).distinct())
    found = _verified(texts, _possible(tried, read, least), shingle, least)
    known = cut_lineage(_labels(connected_components(found)))
    lists = None
    for every in (False, False, True):  # what a link that failed had kept apart is connected before all pairs are given
        labelled = cut_lineage(shared.join(known, "same", "left").select("key", "same", "n", F.coalesce("label", "same").alias("label")))
        if lists is not None:  # the others hold nothing that may be similar and is not connected
            labelled = labelled.join(lists, "key", "left_semi")
        placed = _open_lists(labelled, read, least).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "same")
        met = cut_lineage(placed.mapInArrow(_crossing(least, every), "a long, b long, key int"))
        crossing = cut_lineage(met.filter("a is not null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
        lists = met.select("key").distinct()
        if met.isEmpty():
            break
        known = _merged(known, _verified(texts, crossing, shingle, least))
        tried = tried.unionByName(crossing)
    return known


def _labels(components: DataFrame) -> DataFrame:
    return components.select(F.col("node").alias("same"), F.col("component").alias("label"))


def _merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """(same, label) once these links hold too: only the components they join are connected, not their texts again."""
    of = lambda end: known.select(F.col("same").alias(end), F.col("label").alias(f"_{end}"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = cut_lineage(named.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).distinct())
    moved = cut_lineage(connected_components(joined).select(F.col("node").alias("label"), F.col("component").alias("to")))
    lone = moved.select(F.col("label").alias("same"), "label").join(known.select("same"), "same", "left_anti")  # texts no link had met
    return cut_lineage(known.unionByName(lone).join(moved, "label", "left").select("same", F.coalesce("to", "label").alias("label")))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of each component the row with the smallest `doc_id` (of
    rows with that id, or of rows without any id, one)."""
    rows = cut_lineage(docs.select("doc_id", same_text().alias("same")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "same")).alias("first")
    labelled = rows.join(components(docs, shingle, similarity), "same", "left").withColumn("label", F.coalesce("label", "same"))
    stays = cut_lineage(labelled.groupBy("label").agg(first).select("first.doc_id", "first.same"))
    return chosen_rows(docs, stays, doc_id=F.col("doc_id"), same=same_text()).select("doc.*")
