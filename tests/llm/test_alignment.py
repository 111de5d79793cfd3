"""Cross-tokenizer alignment against a plain version over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as tokenizers_at
import pytest
import sentencepiece
from conftest import odd_rows, odd_texts
from tokenizers import Tokenizer

import pyarrow.parquet as pq

from staffscope.llm import alignment
from staffscope.llm.queries import QUERIES

from test_operators import same, tuples


def plain_tokenizers():
    from staffscope.llm.chunks import BYTE_CHARS
    a = Tokenizer.from_file(tokenizers_at.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizers_at.path("piece_bpe_32k.model"))
    byte_of = {char: byte for byte, char in enumerate(BYTE_CHARS)}

    def encode(text):
        """(id, bytes) of both sides; nothing where they do not give the text back."""
        if not text:
            return [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids
        of_a = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in ids]
        of_b = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        data = (" " + text).encode()
        return (of_a, of_b) if b"".join(t for _, t in of_a) == data == b"".join(t for _, t in of_b) else ([], [])
    return encode


def plain_groups(of_a, of_b):
    """Lists of ids of both sides per group, by walking the bytes."""
    out, at, bt, end_a, end_b, some_a, some_b = [], 0, 0, 0, 0, [], []
    while at < len(of_a) or bt < len(of_b):
        if end_a <= end_b and at < len(of_a):
            some_a.append(of_a[at][0])
            end_a += len(of_a[at][1])
            at += 1
        else:
            some_b.append(of_b[bt][0])
            end_b += len(of_b[bt][1])
            bt += 1
        if end_a == end_b:
            out.append((some_a, some_b))
            some_a, some_b = [], []
    return out


def plain_alignments(rows):
    encode = plain_tokenizers()
    cut = [plain_groups(*encode(text)) for _, text in rows]
    links = [Counter((x, y) for some_a, some_b in groups for x in some_a for y in some_b) for groups in cut]
    docs = Counter(pair for held in links for pair in held)
    best = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    for (doc_id, _), groups, held in zip(rows, cut, links):
        told = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        yield (doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(held.values()),
               sum(n for pair, n in held.items() if docs[pair] == best[pair[0]]), sum(n * docs[pair] for pair, n in held.items()),
               hashlib.sha256(told.encode()).hexdigest() if groups else "")


ALPHABET = ["a", "the", " ", "  ", "\n", "\r", "\t", "\r\n", ";", "}", "(", ")", "'s", "9", "é", "́", "Σ", " ", "\x1c", "\x85", "日", "…", "<s>",
            "<|endoftext|>", "!", "_", "\x00", "=", "==", "\x0b", "\x0c", "*/", "ing", "ver", "😀", "　"]


def fuzz(number, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(number)]


@pytest.mark.parametrize("links", [4096, 1])
def test_pieces_give_the_groups_of_the_text(monkeypatch, links):
    monkeypatch.setattr(alignment, "LINKS", links)
    encode, memory = plain_tokenizers(), alignment.Pieces(alignment.vocabularies(alignment.A, alignment.B))
    texts = fuzz(4000) + [t or "" for t in odd_texts()]
    made = alignment.Aligned(memory, texts)
    doc, pair, times = made.pairs()
    held = defaultdict(dict)
    for d, p, n in zip(doc.tolist(), pair.tolist(), times.tolist()):
        x, y = (-1 - p, int(memory.both.same[-1 - p])) if p < 0 else divmod(p, 32000)
        held[d][x, y] = n
    for n, (text, told) in enumerate(zip(texts, made.told())):
        want = plain_groups(*encode(text))
        assert told == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in want), repr(text)
        assert held[n] == Counter((x, y) for some_a, some_b in want for x in some_a for y in some_b)
        assert made.n_links[n] == sum(held[n].values()) and made.n_groups[n] == len(want)


@pytest.mark.parametrize("block", [1_000_000, 50])
def test_alignments(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_TOKENS", block)
    rows = [(r[0], r[1]) for r in odd_rows()] + [(1000 + n, text) for n, text in enumerate(["a▁b", *fuzz(60, 9), "=" * 3000 + "a"])]
    docs = spark.createDataFrame([(*row, 1, "p") for row in rows], "doc_id long, text string, block long, pair string").repartition(3)
    same(tuples(alignment.alignments(docs)), list(plain_alignments(rows)))


def test_counts_of_pairs(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the cat"), (3, "unvorhersehbar")], "doc_id long, text string")
    _, counts = alignment.align(docs)
    encode, want = plain_tokenizers(), Counter()
    for text in ("the cat", "the cat", "unvorhersehbar"):
        want.update({(x, y) for some_a, some_b in plain_groups(*encode(text)) for x in some_a for y in some_b})
    assert {(r.a, r.b): r.docs for r in alignment.pair_counts(counts).collect()} == want


def test_nothing_to_align(spark, none):
    assert alignment.alignments(none).count() == 0
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    same(tuples(alignment.alignments(empty)), [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")])


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_alignment"](spark, sf)
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same(tuples(got), list(plain_alignments(rows)))


def test_few_blocks_are_read_together(spark):
    """However many blocks a file holds, a reader unpacks a few; and a worker's second memory is small."""
    blocks, _ = alignment.align(spark.range(60_000).selectExpr("id as doc_id", "'a' as text").coalesce(1))
    files = [pq.ParquetFile(file.removeprefix("file://")).metadata for file in blocks.inputFiles()]
    assert sum(file.num_rows for file in files) > alignment.READ_BLOCKS
    assert max(file.row_group(n).num_rows for file in files for n in range(file.num_row_groups)) <= alignment.READ_BLOCKS
    assert alignment.vocabularies(alignment.A, alignment.B).a._remembered == alignment.STEMS
