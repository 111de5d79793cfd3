"""Token counts from a digest cache.

A text is known by the digest of its normalised content (null is empty; nothing else may change, or counts would), a
tokenizer by the digest of its file and of the library's version. Counts are joined from the cache; only texts without
an entry are encoded, one of each content, and appended.

The cache is a table bucketed and sorted by digest (`sources.answers`): what is stored is read bucket by bucket and never
shuffled, so a small increment costs its own digests an exchange and the buckets a read. A batch of counts is written
whole or not at all, and entries written twice do no harm.

Scale: one narrow pass makes the digests, one exchange of the texts by document brings the missing ones to their task
(an equi semi-join on the representative document, so a content with millions of copies stays one text), and the final
join carries ids and digests only, where a hot content is split by AQE. Lost executors recompute tasks.

Cases: null and empty texts count zero tokens and share a digest; null or repeated `doc_id`s keep their rows; other
columns of the input are not read; an empty table gives an empty result and adds nothing to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from ..sources.answers import AnswerCache
from .chunks import counting_memory, vocabulary_path
from .common import whole

#: Tokens above which a document is said to be over the limit.
LIMIT = 512
ENTRY = "digest string, answer long"


def tokenizer_version(name: str) -> str:
    """The digest of a tokenizer: its file and the library that runs it."""
    import tokenizers
    with open(vocabulary_path(name), "rb") as file:
        return hashlib.sha256(file.read() + b"\0tokenizers " + tokenizers.__version__.encode()).hexdigest()


def count_tokens(docs: DataFrame, cache: str, tokenizer: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row; the cache at `cache` then holds every content of `docs`."""
    store, version = AnswerCache(docs.sparkSession, cache, "bigint"), tokenizer_version(tokenizer)
    try:
        text = whole()
        digest = F.sha2(text.cast("binary"), 256).alias("digest")
        keys = cut_lineage(docs.select("doc_id", digest, F.octet_length(text).cast("long").alias("n_bytes")))
        asked = cut_lineage(keys.groupBy("digest").agg(F.min("doc_id").alias("_one")))
        missing = cut_lineage(store.look_up(asked, version)[1])
        texts = docs.select("doc_id", text.alias("text"), digest)
        same = texts["doc_id"].eqNullSafe(missing["_one"]) & (texts["digest"] == missing["digest"])
        encoded = texts.join(missing, same, "left_semi").select("digest", "text").mapInArrow(_counter(tokenizer), ENTRY)
        store.write(version, encoded.dropDuplicates(["digest"]))
        counts = cut_lineage(store.look_up(asked, version)[0])
    finally:
        store.close()
    return keys.join(counts, "digest").select("doc_id", "n_bytes", F.col("answer").alias("n_tokens"), (F.col("answer") > limit).alias("over_limit"))


def _counter(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = counting_memory(tokenizer)
        for batch in batches:
            n_tokens = [sum(kept) for kept in memory.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n_tokens, pa.int64())], ["digest", "answer"])
    return run
