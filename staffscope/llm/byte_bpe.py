"""Byte-level BPE by a rank file, with the tokenizers library over Arrow batches.

The library merges printable characters that stand for bytes. Its table of merges is made from the ranks: every way to
cut a token in two tokens is a merge, in the order of the token's rank, so the lowest rank merges first as in the rank
file's own scheme; a match that is a token as a whole is taken as it is. Decoding reverses the byte table and joins
bytes, so characters split between tokens come together again. Offsets come from the token's numbers of bytes and a
byte-to-character map.

Scale: no shuffle; a batch at a time; the vocabulary is read once per worker from the path given.

Cases: null and empty texts have no ids and decode to no bytes; very long texts are one row in memory; special strings
are ordinary text; other columns pass through; an empty table gives an empty result. Ids outside the vocabulary raise.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .chunks import BYTE_CHARS, Memory, packed, slices, vocabulary_path
from .common import boxed, whole

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text that are encoded and passed on together.
SLICE = 2_000_000


@lru_cache(maxsize=None)
def read_ranks(name: str) -> dict[bytes, int]:
    with open(vocabulary_path(name), "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(maxsize=None)
def rank_tokenizer(name: str):
    """A tokenizer of the tokenizers library that merges by the ranks of a file."""
    import public_tokenizers
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers
    ranks = read_ranks(name)
    chars = {token: "".join(BYTE_CHARS[byte] for byte in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        cuts = [(token[:at], token[at:]) for at in range(1, len(token)) if token[:at] in ranks and token[at:] in ranks]
        merges += [(chars[a], chars[b]) for a, b in sorted(cuts, key=lambda cut: (ranks[cut[0]], ranks[cut[1]]))]
    made = Tokenizer(models.BPE(vocab={chars[token]: rank for token, rank in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


@lru_cache(maxsize=None)
def rank_memory(name: str) -> Memory:
    """The worker's memory of ids by piece, kept from task to task."""
    return Memory(rank_tokenizer(name), packed)


class ByteTable:
    """The bytes of each id, reversed from the characters that stand for them."""

    def __init__(self, tokenizer):
        byte_of = {char: byte for byte, char in enumerate(BYTE_CHARS)}
        vocabulary = tokenizer.get_vocab()
        self._bytes: list[bytes | None] = [None] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self._bytes[number] = bytes(byte_of[char] for char in token)
        self.lengths = np.array([len(token or b"") for token in self._bytes], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """All bytes of a sequence; tokens that end inside a character are joined with what follows."""
        return b"".join(map(self._bytes.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Per token the first character it touches and the one after the last it touches."""
        ends = np.cumsum(self.lengths[ids])
        heads = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        char = np.cumsum(heads) - 1  # the character of each byte
        begins = ends - self.lengths[ids]
        return char[begins], char[ends - 1] + 1


@lru_cache(maxsize=None)
def byte_table(name: str) -> ByteTable:
    return ByteTable(rank_tokenizer(name))


def encode(text: Column, ranks: str = RANKS) -> Column:
    """The ids of each text, `array<int>`."""
    @F.arrow_udf("array<int>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = rank_memory(ranks)
        for batch in texts:
            rows = [b"".join(kept) for kept in memory.encode([t or "" for t in batch.to_pylist()])]
            ends = np.concatenate([[0], np.cumsum([len(row) // 4 for row in rows], dtype=np.int64)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))
    return of(text)


def decode(ids: Column, ranks: str = RANKS) -> Column:
    """The bytes of each sequence of ids, `binary`; null for null."""
    @F.arrow_udf("binary")
    def of(sequences: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = byte_table(ranks)
        for batch in sequences:
            yield pa.array([None if ids is None else table.decode(np.array(ids, np.int64)) for ids in batch.to_pylist()], pa.binary())
    return of(ids)


def encoded(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, source, n_tokens, ids_sha256, decoded_sha256, ids) of each row, the round trip checked on the way: a text
    that its ids don't give back raises. Rows go out by `SLICE` bytes of text, so memory does not grow with a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, table = rank_memory(ranks), byte_table(ranks)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts, rows, digests = [t or "" for t in part.column("text").to_pylist()], [], []
                for text, kept in zip(texts, memory.encode(texts)):
                    ids = np.frombuffer(b"".join(kept), np.int32)
                    if table.decode(ids) != text.encode():
                        raise ValueError("the ids of a text do not give it back")
                    rows.append(ids)
                    digests.append(_digest(ids, table)[1:3])
                ends = np.cumsum([0, *map(len, rows)], dtype=np.int64).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("source"), pa.array(np.diff(ends).astype(np.int64)), pa.array([a for a, _ in digests], pa.string()),
                     pa.array([b for _, b in digests], pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, np.int32)])))],
                    ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])
    kinds = {name: docs.schema[name].dataType.simpleString() for name in ("doc_id", "source")}
    return docs.select("doc_id", "source", whole().alias("text")).mapInArrow(
        run, f"doc_id {kinds['doc_id']}, source {kinds['source']}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")


def encode_with_offsets(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc, bpe): the rows of `docs`, each as a struct, and a struct of ids, begins and ends (character offsets into the
    text)."""
    @F.arrow_udf("ids array<int>, begins array<int>, ends array<int>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory, table = rank_memory(ranks), byte_table(ranks)
        for batch in texts:
            rows = []
            texts_of = [t or "" for t in batch.to_pylist()]
            for text, kept in zip(texts_of, memory.encode(texts_of)):
                ids = np.frombuffer(b"".join(kept), np.int32)
                begins, ends = table.offsets(ids, text.encode()) if len(ids) else (ids, ids)
                rows.append({"ids": ids, "begins": begins.astype(np.int32), "ends": ends.astype(np.int32)})
            yield pa.array(rows, pa.struct({name: pa.list_(pa.int32()) for name in ("ids", "begins", "ends")}))
    return boxed(docs, bpe=of(whole()))


def round_trip(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_split) of each row: encoded, decoded again from the ids;
    `n_split` counts tokens that begin or end inside a character."""
    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory, table = rank_memory(ranks), byte_table(ranks)
        for batch in texts:
            rows = [_digest(np.frombuffer(b"".join(kept), np.int32), table) for kept in memory.encode([t or "" for t in batch.to_pylist()])]
            counts, ids, decoded, split = zip(*rows) if rows else ([], [], [], [])
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()),
                                              pa.array(split, pa.int64())], ["n_tokens", "ids_sha256", "decoded_sha256", "n_split"])
    return docs.select("doc_id", of(whole()).alias("out")).select("doc_id", "out.*")


def _digest(ids: np.ndarray, table: ByteTable) -> tuple[int, str, str, int]:
    data = table.decode(ids)
    text = ",".join(map(str, ids.tolist()))
    split = 0
    if len(ids) and not data.isascii():
        ends = np.cumsum(table.lengths[ids])
        inside = (np.append(np.frombuffer(data, np.uint8), 0) & 0xC0) == 0x80  # a byte that goes on with a character
        split = int((inside[ends - table.lengths[ids]] | inside[ends]).sum())
    return len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(data).hexdigest(), split
