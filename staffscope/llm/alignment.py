"""Alignment of two tokenizers' ids over a corpus, exact one-to-one groups by a map and only the others as pairs.

Both tokenizers cut a text's bytes; where tokens of both end, a group ends, and every token of one side in a group is
linked with every token of the other. Most groups hold one token of either side and the same bytes. For them a map made
once from the two vocabularies names the partner, so an A id alone stands for the pair: such pairs are counted in a
vector as long as the vocabulary, per task. Only pairs the map does not name enter a shuffle as pairs.

Scale: texts are read once and encoded a piece at a time (`chunks.pieces`; both tokenizers keep to its cuts, and each
distinct piece is encoded and aligned once per worker, a bounded memory). Documents are gathered in blocks of at most
`BLOCK_TOKENS` tokens (or one longer document); a block names each of its pairs once, so what is shuffled are pairs of
blocks, not of documents. The number of documents that hold a pair travels back to the blocks by a join on the pair and
a cogroup on the block. Two vectors of at most the A vocabulary's length reach the driver.

Cases: null and empty texts, and texts whose tokens do not give back a space and the text (U+2581 is a space to B), have
no tokens: zeros and an empty digest; every row counts as a document, repeated rows and rows without `doc_id` too; groups
without a common end for long are counted by distinct ids, so their links are not written out; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, literal_table
from .chunks import BYTE_CHARS, Memory, packed, pieces, slices, vocabulary_path
from .common import whole

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Tokens of both sides, and documents, of a block; bytes of text aligned together.
BLOCK_TOKENS, BLOCK_DOCS, SLICE = 1_000_000, 4096, 1_000_000
#: Pieces a worker remembers, and the longest one worth it; links of a group that are written out one by one.
REMEMBERED, LONGEST, LINKS = 200_000, 64, 4096
#: Pieces the memory of A keeps besides, for their stems; blocks a reader of the written blocks unpacks together.
STEMS, READ_BLOCKS = 50_000, 4
#: Distinct pairs a task adds up before it passes them on.
GATHERED = 1 << 21
BLOCK = ("block long, doc_ids array<long>, numbers array<long>, shas array<string>, pairs array<int>, docs array<int>, "
         "ends array<long>, at array<int>, times array<long>")
ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


#: B joins a carriage return with marks before it, so no cut is made there.
_NO_RETURN = re.compile(r"(?<=\S)(?=[\t\n\x0b\x0c ])")


class Vocabularies:
    """Both tokenizers, the bytes of their ids, and `same`: per A id the B id of the same bytes, or -1."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of parallelism
        tokenizer = Tokenizer.from_file(vocabulary_path(a))
        tokenizer.encode_special_tokens = True  # special strings in texts are text
        self.a = Memory(tokenizer, packed, remembered=STEMS)
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(b))
        byte_of = {char: byte for byte, char in enumerate(BYTE_CHARS)}
        vocabulary = tokenizer.get_vocab()
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            known = [byte_of.get(char) for char in token]
            a_bytes[number] = token.encode() if None in known else bytes(known)
        names = [self.b.id_to_piece(number) for number in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(name[3:-1], 16)]) if self.b.is_byte(n) else b"" if self.b.is_control(n) or self.b.is_unknown(n)
                   else name.replace("▁", " ").encode() for n, name in enumerate(names)]
        if any("▁" in name.lstrip("▁") or len(name) > 1 and set(name) & set(" \t\n\x0b\x0c") for name in names):
            raise ValueError(f"{b} has pieces that go on behind white space: texts cannot be cut there")
        if len(a_bytes) * len(names) > 1 << 31:
            raise ValueError("pairs of these vocabularies do not fit in 32 bits")
        of_bytes: dict[bytes, int] = {}
        for n in sorted(range(len(names)), key=lambda n: (self.b.is_byte(n), n)):
            if b_bytes[n]:
                of_bytes.setdefault(b_bytes[n], n)
        self.same = np.array([of_bytes.get(token, -1) for token in a_bytes], np.int64)
        self.a_lengths, self.b_lengths = (np.array([len(token) for token in side], np.int64) for side in (a_bytes, b_bytes))
        # the names of ids with what stands behind them, inside a group and at its end
        self.a_names, self.b_names = ([np.array([f"{n}{mark}" for n in range(size)], object) for mark in marks]
                                      for size, marks in ((len(a_bytes), ",|"), (len(b_bytes), ",;")))

    def ids(self, new: set[str]) -> Iterator[tuple[str, bytes, list[int]]]:
        """Ids of pieces on both sides, those of A packed. B puts a space before what it is given: that space is the piece's own first one,
        and where the piece starts with other white space, which joins no token, it is taken off again."""
        a, listed = self.a.encode_pieces(new), list(new)
        for piece, ids in zip(listed, self.b.encode([p[1:] if p[0] == " " else p for p in listed], num_threads=1)):
            yield piece, a[piece], ids if piece[0] == " " and len(piece) > 1 else self.b.encode("\n")[:1] if piece == " " else ids[1:]


@lru_cache(maxsize=None)
def vocabularies(a: str, b: str) -> Vocabularies:
    return Vocabularies(a, b)


class Pieces:
    """A worker's memory of pieces: the ids of both sides as little-endian 32-bit integers."""

    def __init__(self, both: Vocabularies):
        self.both, self.known = both, {}

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Per text the ids of both sides; nothing for an empty text."""
        cuts = [_NO_RETURN.split(" " + text) if "\r" in text else pieces(" " + text) if text else [] for text in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = {piece for cut in cuts for piece in cut if piece not in known}
        long = {}
        for piece, a, b in self.both.ids(new) if new else ():
            (known if len(piece) <= LONGEST else long)[piece] = (a, packed(b))
        found = [[long[p] if p in long else known[p] for p in cut] if long else list(map(known.__getitem__, cut)) for cut in cuts]
        return ([b"".join([a for a, _ in one]) for one in found], [b"".join([b for _, b in one]) for one in found])


class Aligned:
    """Texts encoded on both sides, cut in groups: arrays over all their tokens, groups and pairs, document by document."""

    def __init__(self, memory: Pieces, texts: list[str]):
        both = memory.both
        a, b = memory.encode(texts)
        # the tokens give a text back if their bytes are as many: B only ever turns U+2581, three bytes, into one
        size = [len(text.encode("utf-8", "surrogatepass")) + 1 if text else 0 for text in texts]
        lengths = [(int(both.a_lengths[np.frombuffer(x, np.int32)].sum()), int(both.b_lengths[np.frombuffer(y, np.int32)].sum())) for x, y in zip(a, b)]
        whole_text = [x == y == n for (x, y), n in zip(lengths, size)]
        a, b = ([ids if fits else b"" for ids, fits in zip(side, whole_text)] for side in (a, b))
        self.n_a, self.n_b = (np.array([len(ids) // 4 for ids in side], np.int64) for side in (a, b))
        self.a, self.b = (np.frombuffer(b"".join(side), np.int32).astype(np.int64) for side in (a, b))
        a_ends, b_ends = np.cumsum(both.a_lengths[self.a]), np.cumsum(both.b_lengths[self.b])
        at = np.searchsorted(b_ends, a_ends)
        self.a_last = b_ends[at] == a_ends if len(at) else np.zeros(0, bool)  # tokens that end a group
        self.b_last = np.zeros(len(b_ends), bool)
        self.b_last[at[self.a_last]] = True
        self.a_group, self.b_group = np.cumsum(self.a_last) - self.a_last, np.cumsum(self.b_last) - self.b_last
        self.a_stop, self.b_stop = np.flatnonzero(self.a_last) + 1, np.flatnonzero(self.b_last) + 1  # per group, behind its last token
        self.a_size, self.b_size = np.diff(self.a_stop, prepend=0), np.diff(self.b_stop, prepend=0)
        self.doc = np.repeat(np.arange(len(texts)), self.n_a)[self.a_stop - 1]  # of a group
        self.n_groups = np.bincount(self.doc, minlength=len(texts))
        self.n_links = np.zeros(len(texts), np.int64)
        np.add.at(self.n_links, self.doc, self.a_size * self.b_size)
        self.both = both

    def _coded(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """A pair as one number: `-1 - a` where the map names `b`, else `a * size of B + b`."""
        return np.where(self.both.same[x] == y, -1 - x, x * len(self.both.b_lengths) + y)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times it is linked there), each pair once per document, documents in order."""
        links = self.a_size * self.b_size
        one = links == 1
        found = [(self.doc[one], self._coded(self.a[self.a_stop[one] - 1], self.b[self.b_stop[one] - 1]), np.ones(int(one.sum()), np.int64))]
        some = np.flatnonzero((links > 1) & (links <= LINKS))
        number = links[some]
        group = np.repeat(some, number)
        at = np.arange(len(group)) - np.repeat(np.cumsum(number) - number, number)
        x = self.a[self.a_stop[group] - self.a_size[group] + at // self.b_size[group]]
        y = self.b[self.b_stop[group] - self.b_size[group] + at % self.b_size[group]]
        found.append((self.doc[group], self._coded(x, y), np.ones(len(group), np.int64)))
        for group in np.flatnonzero(links > LINKS):  # by distinct ids
            (x, n), (y, m) = (np.unique(ids[stop[group] - size[group]:stop[group]], return_counts=True)
                              for ids, stop, size in ((self.a, self.a_stop, self.a_size), (self.b, self.b_stop, self.b_size)))
            found.append((np.full(len(x) * len(y), self.doc[group]), self._coded(np.repeat(x, len(y)), np.tile(y, len(x))), np.outer(n, m).ravel()))
        doc, pair, times = (np.concatenate(column) for column in zip(*found))
        keys, back = np.unique(doc << 32 | pair & 0xFFFFFFFF, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, back, times)
        return keys >> 32, (keys & 0xFFFFFFFF).astype(np.uint32).view(np.int32), total

    def told(self) -> list[str]:
        """Per document its groups as `a1,a2|b1;a3|b2`."""
        both = self.both
        out = np.empty(len(self.a) + len(self.b), object)
        b_start, a_stop = self.b_stop - self.b_size, self.a_stop
        for last, at_a, at_b in ((False, ~self.a_last, ~self.b_last), (True, self.a_last, self.b_last)):
            out[np.flatnonzero(at_a) + b_start[self.a_group[at_a]]] = both.a_names[last][self.a[at_a]]
            out[np.flatnonzero(at_b) + a_stop[self.b_group[at_b]]] = both.b_names[last][self.b[at_b]]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(out[begin:end].tolist())[:-1] for begin, end in zip([0, *ends], ends)]


def _blocks(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Pieces(vocabularies(a, b))
        doc_ids, numbers, shas, held, tokens, number = [], [], [], [], 0, 0

        def out(part: int) -> pa.RecordBatch:
            nonlocal tokens, number
            doc, pair, times = (np.concatenate(column) for column in zip(*held))
            every, where = np.unique(pair, return_inverse=True)
            row = [(part << 32) + number, doc_ids, np.concatenate(numbers).ravel(), shas, every, np.bincount(where, minlength=len(every)).astype(np.int32),
                   np.searchsorted(doc, np.arange(len(doc_ids)), "right"), where.astype(np.int32), times]
            made = pa.RecordBatch.from_arrays([pa.array([value], kind) for value, kind in zip(row, _BLOCK_TYPES)], _BLOCK_NAMES)
            tokens, number = 0, number + 1
            for each in (doc_ids, numbers, shas, held):
                each.clear()
            return made

        part = 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for some in slices(batch, "text", SLICE):
                made = Aligned(memory, some.column("text").to_pylist())
                doc, pair, times = made.pairs()
                held.append((doc + len(doc_ids), pair, times))
                doc_ids.extend(some.column("doc_id").to_pylist())
                numbers.append(np.stack([made.n_a, made.n_b, made.n_groups, made.n_links], axis=1))
                shas.extend(hashlib.sha256(text.encode()).hexdigest() if n else "" for text, n in zip(made.told(), made.n_a.tolist()))
                tokens += len(made.a) + len(made.b)
                if tokens >= BLOCK_TOKENS or len(doc_ids) >= BLOCK_DOCS:
                    yield out(part)
        if doc_ids:
            yield out(part)
    return run


_BLOCK_NAMES = ["block", "doc_ids", "numbers", "shas", "pairs", "docs", "ends", "at", "times"]
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_BLOCK_TYPES = [pa.int64(), _LONGS, _LONGS, pa.list_(pa.string()), _INTS, _INTS, _LONGS, _INTS, _LONGS]


def _tally(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents per pair: named pairs in a vector over the vocabulary, the others added up in bounded memory."""
        vector, held, number = np.zeros(size, np.int64), [], 0

        def out() -> pa.RecordBatch:
            pair, docs = (np.concatenate([*some, np.empty(0, np.int64)]) for some in (zip(*held) if held else ([], [])))
            every, back = np.unique(pair, return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, back, docs.astype(np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(every.astype(np.int32)), pa.array(total)], ["pair", "docs"])
        for batch in batches:
            for pairs, docs in zip(batch.column("pairs"), batch.column("docs")):
                pair, n = pairs.values.to_numpy(), docs.values.to_numpy()
                named = pair < 0  # each pair once in a block
                vector[-1 - pair[named]] += n[named]
                held.append((pair[~named].astype(np.int64), n[~named].astype(np.int64)))
                number += len(pair)
            if number > GATHERED:
                yield out()
                number = 0
        yield out()
        met = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array((-1 - met).astype(np.int32)), pa.array(vector[met])], ["pair", "docs"])
    return run


def _answer(size_b: int, best: np.ndarray, named: np.ndarray):
    def of(found: pa.Table, blocks: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in _ANSWER.items()})
        row = {name: blocks.column(name).combine_chunks() for name in _BLOCK_NAMES}
        flat = {name: row[name][0].values for name in _BLOCK_NAMES[1:]}
        pairs, at, ends, times = (flat[name].to_numpy() for name in ("pairs", "at", "ends", "times"))
        count = np.zeros(len(pairs), np.int64)
        count[found.column("pos").to_numpy()] = found.column("docs").to_numpy()
        own = pairs < 0
        count[own] = named[-1 - pairs[own]]
        top = count == best[np.where(own, -1 - pairs, pairs // size_b)]
        doc = np.searchsorted(ends, np.arange(len(at)), "right")
        total, good = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        np.add.at(total, doc, times * count[at])
        np.add.at(good, doc, times * top[at])
        numbers = flat["numbers"].to_numpy().reshape(-1, 4)
        columns = [flat["doc_ids"], *[pa.array(np.ascontiguousarray(column)) for column in numbers.T], pa.array(good), pa.array(total), flat["shas"]]
        return pa.table(dict(zip(_ANSWER, columns)))
    return of


_ANSWER = {name: pa.int64() for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")} | {"groups_sha256": pa.string()}


def align(docs: DataFrame, a: str = A, b: str = B) -> tuple[DataFrame, DataFrame]:
    """The aligned documents in blocks, and (pair, docs): how many documents hold each pair."""
    blocks = cut_lineage(docs.select("doc_id", whole().alias("text"), F.spark_partition_id().alias("part")).mapInArrow(_blocks(a, b), BLOCK),
                         at_once=READ_BLOCKS)
    met = blocks.select("pairs", "docs").mapInArrow(_tally(len(vocabularies(a, b).a_lengths)), "pair int, docs long")
    return blocks, cut_lineage(met.groupBy("pair").agg(F.sum("docs").alias("docs")))


def pair_counts(counts: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """(a, b, docs): how many documents link the two ids."""
    both = vocabularies(a, b)
    size = len(both.b_lengths)
    named = F.col("pair") < 0
    rows = [(-1 - number, other) for number, other in enumerate(both.same.tolist()) if other >= 0]
    known = counts.join(literal_table(counts.sparkSession, rows, "pair int, same int"), "pair", "left")
    return known.select(F.when(named, -1 - F.col("pair")).otherwise(F.floor(F.col("pair") / size)).cast("int").alias("a"),
                        F.when(named, F.col("same")).otherwise(F.col("pair") % size).cast("int").alias("b"), "docs")


def alignments(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    both = vocabularies(a, b)
    blocks, counts = align(docs, a, b)
    size_a, size_b = len(both.a_lengths), len(both.b_lengths)
    best, named = np.zeros(size_a, np.int64), np.zeros(size_a, np.int64)
    own = F.when(F.col("pair") < 0, -1 - F.col("pair")).otherwise(F.floor(F.col("pair") / size_b)).cast("int")
    for row in counts.groupBy(own.alias("a")).agg(F.max("docs").alias("best"), F.max(F.when(F.col("pair") < 0, F.col("docs"))).alias("named")).collect():
        best[row.a], named[row.a] = row.best, row.named or 0
    asked = blocks.select(F.col("block").alias("asked"), F.posexplode("pairs").alias("pos", "pair")).filter("pair >= 0")
    found = asked.join(counts.filter("pair >= 0"), "pair").select("asked", "pos", "docs")
    return found.groupBy("asked").cogroup(blocks.groupBy("block")).applyInArrow(_answer(size_b, best, named), ROW)
