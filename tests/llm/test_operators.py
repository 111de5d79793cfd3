"""Every operator against a plain version, on nulls, odd texts, ties, repeated rows, clashing columns and empty tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import brute
import numpy as np
import public_tokenizers as tokenizers_at
import pyarrow as pa
import pytest
from conftest import odd_rows, odd_texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from staffscope.llm import byte_bpe, chat, chunks, exact_dedup, mixing, quality, sharding, simhash, similar, token_counts, token_files, url_filters, wavelet
from staffscope.llm.common import table
from staffscope.sources.answers import AnswerCache

SF = "/root/testdata/sf0.001"
PAIRS = [(r[0], r[1]) for r in odd_rows()]


def tuples(df):
    return [tuple(r) for r in df.collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# chunks

@pytest.mark.parametrize("name, memory, unpack", [
    ("byte_bpe_50k.json", chunks.counting_memory, None), ("word_bpe_49k.json", chunks.lower_word_memory, "ids")])
def test_pieces_give_the_ids_of_the_text(name, memory, unpack):
    rng = random.Random(1)
    odd = ["ab", " ", "  ", "\n", "\t", ",", "'s", "'", "9", "é", "́", "Σ", "\u00a0", "\x1c", "\x85", "日", "…", "<|endoftext|>", "!", "İ", "_", "²", "-"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [t or "" for t in odd_texts()]
    plain = Tokenizer.from_file(tokenizers_at.path(name))
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for text, kept, ids in zip(texts, memory(name).encode(texts), want):
        if unpack:
            assert np.frombuffer(b"".join(kept), "<u4").tolist() == ids, repr(text)
        else:
            assert sum(kept) == len(ids), repr(text)


# 1

def test_token_counts(odd, none, folder):
    got = tuples(token_counts.count_tokens(odd, folder))
    plain = Tokenizer.from_file(tokenizers_at.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text in PAIRS:
        n = len(plain.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 512))
    same(got, want)
    assert token_counts.count_tokens(none, folder).count() == 0


def test_only_missing_texts_are_encoded(spark, odd, folder):
    version = token_counts.tokenizer_version("byte_bpe_50k.json")
    token_counts.count_tokens(odd.limit(10), folder)
    first = AnswerCache(spark, folder, "bigint")
    before = first.entries(version).count()
    first.close()
    token_counts.count_tokens(odd, folder)
    cache = AnswerCache(spark, folder, "bigint")
    assert before < cache.stored(version).count() == cache.entries(version).count() == len({t or "" for _, t in PAIRS})
    cache.close()
    planted = AnswerCache(spark, f"{folder}/b", "bigint")
    planted.write(version, spark.createDataFrame([(hashlib.sha256(b"one").hexdigest(), 77)], token_counts.ENTRY))
    planted.close()
    held = token_counts.count_tokens(odd, f"{folder}/b").filter("n_tokens = 77").collect()
    assert held  # a stored count is taken, not encoded again


# 2

def test_urls(spark):
    urls = [None, "", "no scheme/fr/", "http://", "http://EXAMPLE.org", "http://a.example.org/es/1", "http://example.org/en/12?x", "http://notexample.org/es/",
            "http://x.com/fr/", "https://com/de/#f", "http://a.net/x.org/", "ftp://u@b.com:80/fr/", "http://b.com#/fr/", "http://É.ORG/", "x://y://z.org/fr/",
            "http://a.org/" + "long/" * 5000, "http://example.org/en/1\n", "http://.org/", "http://org./", "http://a\u0000.org/"]
    rows = [(n, u, "html", "host") for n, u in enumerate(urls + urls[:3])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    for default in ("allow", "block"):
        same(tuples(url_filters.judge_urls(pages, default=default)),
             [(n, *brute.url(u, url_filters.RULES, default)) for n, u, _, _ in rows])
    assert url_filters.judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filters.judge_urls(pages, rules=()).collect()} == {"allow"}


def test_many_globs_over_words():
    rng = random.Random(3)
    globs = ["".join(rng.choice("ab/*") for _ in range(rng.randint(1, 30))) for _ in range(60)] + ["**a", "a**b", "*/b**"]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    import pyarrow as pa
    fits = url_filters.Automaton(globs).fits(pa.array(texts))
    for g, glob in enumerate(globs):
        regex = re.compile("".join({"**": ".*", "*": "[^/]*"}.get(part, re.escape(part)) for part in re.findall(r"\*\*|.", glob)))
        assert [bool(regex.fullmatch(t)) for t in texts] == fits[:, g].tolist(), glob


# 3

@pytest.mark.parametrize("n, top", [(0, 5), (1, 1), (10, 1), (5000, 49408), (200_000, 300), (70_000, 70_000)])
def test_wavelet(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n).astype(np.uint32)
    file = wavelet.WaveletFile(wavelet.write(ids, [3, None, 5], [n, 0, 0]))
    assert (file.tokens() == ids).all() and file.table()[0] == [3, None, 5] and file.table()[1].tolist() == [n, 0, 0]
    for at in rng.integers(0, max(n, 1), 20 if n else 0):
        token, begin = int(ids[at]), int(rng.integers(0, at + 1))
        assert file.access(int(at)) == token
        assert file.count(token, begin, int(at) + 1) == int((ids[begin:at + 1] == token).sum())
        assert file.locate(token, int((ids[:at] == token).sum())) == at
    assert file.count(top + 5) == 0 or top + 5 < 1 << file.levels
    with pytest.raises(IndexError):
        file.locate(top + 1_000_000, 0)


def test_token_files(odd, none, folder):
    manifest = token_files.write_files(odd, folder, file_tokens=3000)
    got = sorted(tuples(token_files.read_files(manifest)), key=lambda r: r[1])
    plain = Tokenizer.from_file(tokenizers_at.path("word_bpe_49k.json"))
    assert [r[0] for r in got] == sorted((d for d, _ in PAIRS), key=lambda d: (d is not None, d))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    ids = [plain.encode(t or "", add_special_tokens=False).ids + [1] for _, t in PAIRS]
    same([(r[0], r[2], r[3]) for r in got], [(d, len(i), brute.crc(i)) for (d, _), i in zip(PAIRS, ids)])
    assert len({r.path for r in manifest.collect()}) > 2
    file = token_files.open_file(manifest.orderBy("part").first().path)
    assert file.access(int(file.table()[1][0]) - 1) == 1
    assert token_files.read_files(token_files.write_files(none, folder)).count() == 0


# 4

def test_near_duplicates(odd, none):
    same(tuples(simhash.near_duplicates(odd)), brute.near(PAIRS))
    assert simhash.near_duplicates(none).count() == 0


def test_links_of_dense_and_sparse_fingerprints(spark, monkeypatch):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(20)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(25)} | {0, 7, 15, (1 << 64) - 1}
    want = brute.groups(fps)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    rows = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(4)
    clusters = Counter(want.values())
    grouped = defaultdict(set)
    for row in simhash.components(rows).collect():
        grouped[row.label].add(row.fp)
    expected = defaultdict(set)
    for f, c in want.items():
        if clusters[c] > 1:
            expected[c].add(signed(f))
    assert sorted(map(sorted, grouped.values())) == sorted(map(sorted, expected.values()))


def test_both_searches_of_a_list_find_the_same_groups():
    rng = random.Random(2)
    shared = simhash.SETS[17]
    free = [at for at in range(8) if at not in shared]
    values = {sum(rng.choice((0, 1, 3, 255, rng.getrandbits(8))) << 8 * at for at in free) for _ in range(400)}
    fps = np.array([v | sum(0x5A << 8 * at for at in shared) for v in values], np.uint64).view(np.int64)

    def trees(pairs):
        forest = simhash._Forest()
        for a, b in pairs:
            forest._link(a, b)
        return sorted(Counter(forest._root(int(f)) for f in fps).values())
    assert trees(simhash._pairwise(fps)) == trees(simhash._probed(fps, shared)) and len(trees(simhash._pairwise(fps))) < len(fps)


def test_keep_one(odd, none):
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(odd).collect()]
    label = brute.groups([brute.fingerprint(t) for _, t in PAIRS])
    assert Counter(label[brute.fingerprint(t)] for _, t in kept) == Counter(set(label.values()))
    component = {(d, brute.fingerprint(t)): c for (d, t), (_, _, c) in zip(PAIRS, brute.near(PAIRS))}
    assert all(component[d, brute.fingerprint(t)] == d for d, t in kept)
    assert simhash.keep_one(odd).columns == odd.columns and simhash.keep_one(none).count() == 0


def near_copies(rng, similarity, words=400):
    """A text and a copy with words changed one by one, as long as they are at least so similar in shingles of five."""
    first = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    copy = list(first)
    while True:
        trial = list(copy)
        trial[rng.randrange(words)] = f"x{rng.randrange(10 ** 6)}"
        a, b = brute.shingles(" ".join(first)), brute.shingles(" ".join(trial))
        if len(a & b) < similarity * len(a | b):
            return " ".join(first), " ".join(copy)
        copy = trial


def similar_rows():
    """Odd texts, near copies of each similarity, what is just too far apart, chains and a line that many texts share."""
    rng = random.Random(8)
    texts = [t for _, t in PAIRS]
    for similarity in (0.7, 0.77, 0.8, 0.85, 0.9, 0.95):
        for words in (40, 150, 400):
            texts += near_copies(rng, similarity, words)
    line = " ".join(f"licence{n}" for n in range(30))
    texts += [line + " " + " ".join(f"v{rng.randrange(10 ** 6)}" for _ in range(rng.choice((3, 5, 9, 60)))) for _ in range(150)]
    chain = [f"c{n}" for n in range(200)]
    for _ in range(40):
        chain[rng.randrange(200)] = f"y{rng.randrange(10 ** 6)}"
        texts.append(" ".join(chain))
    four = [f"e{n}" for n in range(8)]
    texts += [" ".join(four), " ".join(four[:7]), " ".join(four) + " more", " ".join(four[:3]), " ".join(four[:3]).upper()]
    return [(n if n != 12 else None, t) for n, t in enumerate(texts)]


def test_similar_documents(spark, odd, none, monkeypatch):
    rows = similar_rows()
    group = dict(zip((t or "" for _, t in rows), brute.similar([t for _, t in rows])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    smallest = {}
    for doc_id, text in rows:
        if doc_id is not None:
            smallest[group[text or ""]] = min(doc_id, smallest.get(group[text or ""], doc_id))
    for common in (4, 10 ** 9):  # every order of shingles finds the same
        monkeypatch.setattr(similar, "COMMON", common)
        kept = [(r.doc_id, group[r.text or ""]) for r in similar.keep_one(docs).collect()]
        assert Counter(g for _, g in kept) == Counter(set(group.values()))
        assert all(smallest.get(g) == d for d, g in kept)
    assert similar.keep_one(odd).columns == odd.columns and similar.keep_one(none).count() == 0


def test_similar_documents_come_through_the_fingerprint_index(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (3, "other")], "same long, text string")
    assert [tuple(r) for r in similar._by_fingerprint(texts, 5).collect()] == [(1, 2)]

    class Asked(Exception):
        pass

    def asked(distinct):
        raise Asked
    monkeypatch.setattr(simhash, "links", asked)
    with pytest.raises(Asked):
        similar.keep_one(texts.select(F.col("same").alias("doc_id"), "text"))


def test_lists_with_the_same_texts_give_their_links_once():
    rng = np.random.default_rng(3)
    sets = [np.concatenate([np.arange(1, 101), rng.integers(1 << 40, size=2)]).astype(np.uint64) for _ in range(6)]
    batches = [pa.RecordBatch.from_pydict({"key": pa.array([key] * 6, pa.int32()), "i": [0] * 6, "j": [0] * 6, "chunk": [0] * 6, "n": [102] * 6, "same": list(range(6)),
                                           "label": list(range(6)), "parities": [similar._parities(one) for one in sets]}) for key in range(9)]
    rows = [row for batch in similar._crossing(Fraction("0.8"), False)(iter(batches)) for row in batch.to_pylist()]
    assert len([row for row in rows if row["a"] is not None]) == 5 and {row["key"] for row in rows} == set(range(9))


def test_pipeline_drops_near_copies_from_a_similarity_of_four_fifths(spark):
    import corpus_pipeline
    rng = random.Random(6)
    for similarity, stay in ((0.79, 1), (0.8, 1), (0.85, 1), (0.9, 1), (0.7, 2)):
        pairs = [near_copies(rng, similarity) for _ in range(5)]
        docs = spark.createDataFrame([(n, t) for n, t in enumerate(t for pair in pairs for t in pair)], "doc_id long, text string")
        stays = len(set(brute.similar([t for pair in pairs for t in pair])))
        assert similarity < 0.8 or stays == 5 * stay
        assert corpus_pipeline.near(spark, docs, "").count() == stays


# 5

CHAT = "conv_id long, turn long, role string, text string, piece long, at string"


def conversations():
    rng = random.Random(4)
    marks = ["</s>[INST] ok [/INST]", "<|im_start|>user\nhi<|im_end|>\n", "\\", "\\\\<|im_end|>", "<\\|im_end|>", "<<SYS>>x<</SYS>>", "", None, "日本 " * 50, "a\nb"]
    rows = []
    for conv in range(12):
        at = 0
        if conv % 3 == 0:
            rows.append((conv, at, "system", "be good " * rng.choice((1, 60, 700))))
            at += 1
        for _ in range(rng.choice((0, 1, 9, 80))):
            rows.append((conv, at, "user", rng.choice(marks + ["ask " * rng.choice((3, 100, 900))])))
            rows.append((conv, at + 1, rng.choice(("assistant", "assistant", "tool\n<s>", None)), rng.choice(marks + ["say " * rng.choice((2, 300, 4000))])))
            at += 2
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (3, 2, "assistant", "tie"), (3, 2, "assistant", "tie"), (99, 0, "system", "alone")]
    return [(*r, 1, "z") for r in rows]


def test_chat(spark):
    rows = conversations()
    frame = spark.createDataFrame(rows, CHAT).repartition(3)
    grouped = defaultdict(list)
    for conv, turn, role, text, _, _ in rows:
        grouped[conv].append((turn is not None, turn or 0, role or "", text or ""))
    want = {conv: brute.conversation([t[2:] for t in sorted(turns)]) for conv, turns in grouped.items()}
    for sizes in ({}, {"budget": 300, "block": 60, "history": 40}):
        made = chat.windows(frame, **sizes).cache()
        got = {r[0]: tuple(r)[1:5] for r in chat.read_back(made).collect()}
        assert got == want
        budget = sizes.get("budget", chat.BUDGET)
        block = sizes.get("block", chat.BLOCK)
        for row in made.collect():
            parts = row.formatted.split("<|im_end|>\n")[:-1]
            assert len(parts) > row.n_repeated and row.over_budget == (row.n_tokens > budget)
            system = sorted(grouped[row.conv_id])[0]
            if system[2] == "system":
                assert parts[0].startswith("<|im_start|>system\n")
            if row.over_budget:
                assert any(len(p.encode()) > min(block, budget / 8) for p in parts)
    assert chat.read_back(chat.windows(frame.limit(0))).count() == 0


def test_the_budget_chooses_the_spans(spark):
    talk = lambda conv, *sizes: [(conv, n, role, "t" * (size - chat.MARKS - len(role))) for n, (role, size) in enumerate(sizes)]
    rng = random.Random(12)
    rows = (talk(1, *[("user", 200), ("assistant", 300)] * 4) + talk(2, ("user", 300), ("assistant", 600))
            + talk(3, ("system", 1200), *[("user", 400), ("assistant", 440)] * 3) + talk(4, ("user", 1500), ("user", 300), ("assistant", 1700))
            + talk(5, ("system", 1900), *[("user", 60), ("assistant", 70)] * 9) + talk(6, ("system", 300), ("user", 1800), ("assistant", 15)))
    for conv in range(10, 40):
        turns = [(("user", "assistant")[n % 2], rng.choice((15, 40, 300, 900, 1900))) for n in range(rng.randint(1, 30))]
        rows += talk(conv, ("system", rng.choice((11, 140, 1100, 1800))), *turns)
    size = {(conv, n + 1): len(text) + len(role) + chat.MARKS for conv, n, role, text in rows}
    system = {conv: size[conv, 1] for conv, n, role, _ in rows if role == "system"}
    made = defaultdict(list)
    for row in chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect():
        made[row.conv_id].append(row)
    for conv, windows in made.items():
        windows.sort(key=lambda r: r.first_at)
        if sum(n for (c, _), n in size.items() if c == conv) <= chat.BUDGET:
            assert len(windows) == 1
        for row in windows:
            fresh = row.formatted.count("<|im_end|>\n") - row.n_repeated
            if row.over_budget:  # only where a turn does not fit even alone
                assert any(size[conv, row.first_at + n] + system.get(conv, 0) > chat.BUDGET for n in range(fresh))
            elif (before := size.get((conv, row.first_at - 1))) and row.first_at - 1 > (conv in system):
                repeated = row.n_repeated - (conv in system)
                assert repeated or row.n_tokens + before > chat.BUDGET  # a prompt that fits is kept
                at = row.first_at - repeated - 1
                assert at <= (conv in system) or row.n_tokens + size[conv, at] > chat.BUDGET  # and all the room is used
    assert len(made[1]) == len(made[2]) == 1


def test_a_window_within_its_budget_has_no_more_tokens(spark):
    """Counted by the library on what no estimate by characters holds for, and with the counts of the caller."""
    plain = Tokenizer.from_file(tokenizers_at.path("byte_bpe_50k.json"))
    count = lambda text: len(plain.encode(text, add_special_tokens=False).ids)
    rng = random.Random(7)
    kinds = ["8361940275", "日本語の文", "x=[]{}();", "\x00\x07", "plain words here ", "😀", "</s>[INST]"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            text = rng.choice(kinds) * rng.randint(1, 60)
            rows.append((conv, turn, rng.choice(["user", "assistant"]), text, count(text)))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")
    sizes = {}
    for name in (None, "n"):
        made = chat.windows(frame, budget=600, block=200, history=100, counts=name).collect()
        sizes[name] = len(made)
        for row in made:
            marks = row.formatted.count("<|im_start|>") + row.formatted.count("<|im_end|>")
            assert row.over_budget or count(row.formatted.replace("<|im_start|>", "").replace("<|im_end|>", "")) + marks <= 600
    assert sizes["n"] < sizes[None]


# 6

def test_subset_fits_exactly_where_it_can():
    rng = random.Random(8)
    for _ in range(300):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in lengths]
        total = sum(a * b for a, b in zip(lengths, counts))
        budget = rng.randint(0, total)
        took = mixing.fit_subset(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(took, counts))
        sums = {0}
        for a, b in zip(lengths, counts):
            sums = {s + a * k for s in sums for k in range(b + 1)}
        gap = abs(sum(a * t for a, t in zip(lengths, took)) - budget)
        assert gap <= max(lengths)
        if lengths[0] == 1 and counts[0] >= max(lengths):
            assert gap == 0
    assert mixing.fit_subset([5], [3], 15) == [3]


def test_memory_of_a_budget_that_cannot_be_met():
    """Even lengths and an odd budget: nothing stops early, and what is held does not grow with the lengths."""
    import tracemalloc
    peaks = []
    for number in (500, 4000):
        lengths = sorted({2, 40_000, *random.Random(number).sample(range(4, 40_000, 2), number)})
        counts = [1] * len(lengths)
        budget = sum(lengths) // 2 | 1
        tracemalloc.start()
        took = mixing.fit_subset(lengths, counts, budget)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert abs(sum(a * t for a, t in zip(lengths, took)) - budget) == 1 and all(t <= 1 for t in took)
    assert peaks[1] < 3_000_000


def test_mix(odd, none):
    got = mixing.mix(odd).collect()
    sizes = [(r[3], len(brute.words(r[1]))) for r in odd_rows()]
    goal, total = brute.targets(sizes)
    same([(r.doc_id, r.size) for r in got], [(r[0], s) for r, (_, s) in zip(odd_rows(), sizes)])
    taken = Counter()
    by_id = defaultdict(set)
    for doc_id, _, _, source, *_ in odd_rows():
        by_id[doc_id].add(source)
    for row in got:
        (source,) = by_id[row.doc_id]
        assert row.source_size == total[source] and row.target == pytest.approx(goal[source])
        assert row.taken <= 3 * row.size
        taken[source] += row.taken
    for source, target in goal.items():
        assert abs(taken[source] - target) <= max(s for n, s in sizes if n == source)
    assert tuples(mixing.mix(odd).orderBy("doc_id", "size", "taken")) == tuples(mixing.mix(odd.repartition(7)).orderBy("doc_id", "size", "taken"))
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    rows = mixing.mixed(odd)
    assert rows.columns == odd.columns
    assert sum(len(brute.words(r.text)) for r in rows.collect()) == sum(r.taken for r in got)


def test_targets_with_many_limits(spark):
    rng = random.Random(6)
    for _ in range(6):
        sizes = [(rng.choice([None, *map(str, range(9))]), rng.choice((0, 1, 10, 500))) for _ in range(30)]
        goal, total = brute.targets(sizes)
        got = mixing.targets(spark.createDataFrame(sizes, "source string, size long")).collect()
        assert {r.source: pytest.approx(r.target) for r in got} == goal and {r.source: r.source_size for r in got} == dict(total)


# 7

def test_quality_numbers(odd, none):
    got = quality.judge(odd).collect()
    want = []
    for doc_id, text in PAIRS:
        stats = brute.quality(text)
        want.append((doc_id, *stats, stats[0] < 10 or 100 * stats[4] > 20 * stats[0]))
    same([(*tuple(r)[:6], r.base_failed) for r in got], want)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.judge(none).count() == 0 and quality.keep_good(none).count() == 0
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)


def test_quality_verdicts_are_those_of_a_plain_estimation(spark, odd):
    """Over odd texts, and over whole documents: with some that stay in spite of a bad vote."""
    stays, _ = brute.kept([t for _, t in PAIRS])
    same([(r.doc_id, r.kept) for r in quality.judge(odd).collect()], [(d, k) for (d, _), k in zip(PAIRS, stays)])
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    stays, said = brute.kept([r.text for r in docs])
    from staffscope.llm.queries import QUERIES
    same([(r.doc_id, r.kept) for r in QUERIES["op7_quality"](spark, SF).collect()], [(r.doc_id, k) for r, k in zip(docs, stays)])
    assert sum(k and 0 in votes for k, votes in zip(stays, said)) >= 5


def test_quality_against_labels(spark):
    at = "/root/testdata/sf0.01"
    numbers = table(spark, at, "documents").select("doc_id", quality.stats(quality.whole()).alias("stats")).select("doc_id", "stats.*")
    model = quality.fit(numbers)
    bad_vote = quality.F.greatest(*[(rule.vote == 0).cast("int") for rule in quality.RULES]) == 1
    judged = quality.judged(numbers, model).withColumn("bad_vote", bad_vote).join(table(spark, at, "labels"), "doc_id").collect()
    good, bad = [r for r in judged if r.quality and not r.base_failed], [r for r in judged if not r.quality]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.05 * len(bad)
    assert sum(r.kept and r.bad_vote for r in good) >= 0.05 * len(good)  # where filters that all must pass would lose them


def test_estimate_finds_reliable_rules():
    rng = random.Random(3)
    votes = Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        strong = (rng.random() > 0.02) if good else (rng.random() > 0.9)
        other = (rng.random() > 0.02) if good else (rng.random() > 0.7)
        noise = None if rng.random() < 0.3 else rng.random() > 0.3
        votes[int(strong), int(other), None if noise is None else int(noise)] += 1
    model = quality.estimate(list(votes.items()), 3)
    assert model.bad_on_bad[0] > 0.7 and model.bad_on_good[0] < 0.08
    assert abs(model.bad_on_bad[2] - model.bad_on_good[2]) < 0.15 and 0.7 < model.prior < 0.9
    assert quality.estimate([], 3).prior == quality.START_PRIOR


# 8

def reference_encoding():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers_at.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizers_at.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ranks_as_the_other_library_has_them():
    rng = random.Random(11)
    odd = ["a", "b", "the", "ion", "é", "ñ", "ß", "日", "本", "😀", " ", "  ", "\n", "'s", "1", "!", "aa", "ab", "ther", "ung", "\u00a0", "́"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + [t or "" for t in odd_texts()]
    reference = reference_encoding()
    for text, kept in zip(texts, byte_bpe.rank_memory(byte_bpe.RANKS).encode(texts)):
        assert np.frombuffer(b"".join(kept), np.int32).tolist() == reference.encode_ordinary(text), repr(text[:300])


def test_round_trip(spark, odd, none):
    reference = reference_encoding()
    want = []
    for doc_id, text in PAIRS:
        ids = reference.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    same([tuple(r)[:4] for r in byte_bpe.round_trip(odd).collect()], want)
    same([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.encoded(odd).collect()], want)
    assert byte_bpe.round_trip(none).count() == 0 and byte_bpe.encoded(none).count() == 0
    texts = odd.select("text", byte_bpe.encode(odd["text"]).alias("ids"))
    for row in texts.select("text", byte_bpe.decode(texts["ids"]).alias("back")).collect():
        assert bytes(row.back) == (row.text or "").encode()
    for row in byte_bpe.encode_with_offsets(odd).collect():
        text = row.doc.text or ""
        assert len(row.bpe.ids) == len(row.bpe.begins) == len(row.bpe.ends)
        for number, begin, end in zip(row.bpe.ids[:200], row.bpe.begins, row.bpe.ends):
            assert byte_bpe.byte_table(byte_bpe.RANKS).decode(np.array([number])) in text[begin:end].encode()


# 9

def test_shards(odd, none, folder):
    got = sharding.shard(odd, folder).collect()
    same([(r.doc_id, r.size, r.text_crc32) for r in got],
         [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in PAIRS])
    shards = defaultdict(list)
    for row in got:
        shards[row.shard].append(row)
        assert row.law == "bytes" and row.grown_shard is None
    for rows in shards.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert len({(r.virtual_slot, r.shard) for r in got}) == len({r.virtual_slot for r in got})
    assert sharding.shard(none, folder + "/none").count() == 0


def test_the_law_holds_for_repeated_rows(spark, folder):
    rows = [(7, "the same row")] * 20_000 + [(n, f"row {n}") for n in range(1000)] + [(None, None)] * 3000
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder).collect()
    held, slots = Counter(), defaultdict(list)
    for row in got:
        held[row.shard] += row.size
        slots[row.shard].append(row.slot)
    assert len(held) == 8 and max(held.values()) - min(held.values()) < 0.05 * sum(held.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(rows)


def test_the_map_balances_and_its_edits_move_little(spark, folder):
    rng = random.Random(1)
    loads = spark.createDataFrame([(n, rng.randint(500, 1500), 3) for n in range(512)], "slot_no int, bytes long, rows long")
    versions = sharding.ShardMap(spark, folder)
    first = versions.write(sharding.first_map(loads, 8), 1)
    held = [r[1] for r in first.groupBy("shard").sum("bytes").collect()]
    assert len(held) == 8 and max(held) - min(held) <= 1500 and first.count() == 512
    grown = versions.write(sharding.rebalanced(first, loads, 9), 2)
    moved = grown.alias("b").join(first.alias("a"), "slot_no").filter("a.shard <> b.shard")
    assert {r.shard for r in moved.select("b.shard").collect()} == {8} and 512 / 9 * 0.8 < moved.count() < 512 / 9 * 1.2
    held = [r[1] for r in grown.groupBy("shard").sum("bytes").collect()]
    assert len(held) == 9 and max(held) < 1.06 * sum(held) / 9 and {r.version for r in grown.collect()} == {2}
    drift = spark.createDataFrame([(n, 1000 + 4000 * (n < 20), 3) for n in range(512)], "slot_no int, bytes long, rows long")
    third = sharding.rebalanced(grown, drift, 9)
    held = [r[1] for r in third.groupBy("shard").sum("bytes").collect()]
    assert third.count() == 512 and max(held) < 1.12 * sum(held) / 9


# 10

def test_exact_dedup(spark, odd, none):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    got = exact_dedup.dedup(odd, index).collect()
    want = brute.exact(PAIRS)
    same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], want)
    kept = [r for r in got if r.kept]
    assert Counter(r.text_sha256 for r in kept) == Counter({w[3] for w in want}) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.dedup(none, index).count() == 0
    more = spark.createDataFrame([(1000, "one"), (1001, "brand new"), (1002, "brand\tnew")], "doc_id long, text string")
    later = {r.doc_id: (r.kept, r.group_size) for r in exact_dedup.dedup(more, index).collect()}
    assert later == {1000: (False, 2), 1001: (True, 2), 1002: (False, 2)}
    folder = index.folder
    index.close()
    again = exact_dedup.DigestIndex(spark, folder, buckets=4)  # the files outlive the name
    assert again.entries().count() == len({w[3] for w in want}) + 1
    plan = more.select(exact_dedup.F.unhex(exact_dedup.digest(more["text"])).alias("digest")).hint("merge").join(
        again.entries().hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan
    again.close()
    fresh = exact_dedup.DigestIndex(spark)
    out = exact_dedup.keep_new(odd, fresh)
    assert out.columns == odd.columns and out.count() == len(kept)
    fresh.close()


def test_counts_of_three_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=2)
    batches = ([(5, "a"), (6, "a"), (None, "c")], [(1, "a"), (2, "b"), (7, "c")], [(3, "a"), (4, "b"), (9, "d")])
    got = [{(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(spark.createDataFrame(batch, "doc_id long, text string"), index).collect()}
           for batch in batches]
    index.close()
    assert got[0] == {(5, 5, 2, True), (6, 5, 2, False), (None, None, 1, True)}
    assert got[1] == {(1, 5, 3, False), (2, 2, 1, True), (7, None, 2, False)}
    assert got[2] == {(3, 5, 4, False), (4, 2, 2, False), (9, 9, 1, True)}


def test_a_batch_given_again_has_the_same_answer(spark):
    """Its answer was lost after the index had taken it, before or after another batch came."""
    index = exact_dedup.DigestIndex(spark, buckets=2)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first, second = frame([(5, "a"), (6, "a"), (8, "b")]), frame([(1, "a"), (2, "c"), (3, "b")])
    got = lambda rows, batch: sorted(map(tuple, exact_dedup.dedup(rows, index, batch).collect()), key=repr)
    lost = got(first, "one")
    assert [r[3] for r in lost] == [True, False, True] and got(first, "one") == lost
    later = got(second, "two")
    assert got(first, "one") == lost and got(second, "two") == later and {r[0]: r[2] for r in later} == {1: 3, 2: 1, 3: 2}
    assert got(frame([(9, "a")]), "three") == [(9, 5, 4, False, lost[0][4])]
    folder = index.folder
    index.close()
    again = exact_dedup.DigestIndex(spark, folder, buckets=2)
    assert again.number("two") == 2 and again.number("new") == 4
    again.close()


# pipeline

def test_pipeline_is_its_plain_stages(spark, tmp_path):
    """run() over documents, odd texts, exact and near copies against the stages done plainly one after the other."""
    import corpus_pipeline
    rng = random.Random(14)
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    docs += [r[:5] for r in odd_rows()]
    for n, similarity in enumerate((0.7, 0.79, 0.8, 0.85, 0.9, 0.95)):
        for m, text in enumerate(near_copies(rng, similarity, 200)):
            words = text.split()
            text = "\n".join(" ".join(words[at:at + 12]) + "." for at in range(0, len(words), 12)) if m else text
            docs.append((20_000 + 10 * n + m, text, "en", "web", len(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(4).write.parquet(f"{tmp_path}/in/documents.parquet")
    rows = [(d, t or "", s) for d, t, _, s, _ in docs]
    stays, _ = brute.kept([t for _, t, _ in rows])
    rows = [row for row, stay in zip(rows, stays) if stay]
    first = lambda row: (row[0] is None, row[0] or 0)
    for label in (lambda some: [brute.SPACE.sub(" ", t) for _, t, _ in some], lambda some: brute.similar([t for _, t, _ in some])):
        groups = defaultdict(list)
        for row, name in zip(rows, label(rows)):
            groups[name].append(row)
        rows = [min(group, key=first) for group in groups.values()]
    goal, total = brute.targets([(s, len(brute.words(t))) for _, t, s in rows])
    reference, want = reference_encoding(), {}
    for d, t, s in rows:
        ids = reference.encode_ordinary(t)
        want[d, hashlib.sha256(t.encode()).hexdigest()] = (s, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), len(brute.words(t)))
    taken, copies = Counter(), Counter()
    for r in corpus_pipeline.run(spark, f"{tmp_path}/in").collect():
        key = (r.doc_id, r.decoded_sha256)
        assert want[key][:3] == (r.source, r.n_tokens, r.ids_sha256) and len(r.ids) == r.n_tokens
        copies[key] += 1
        taken[r.source] += want[key][3]
    for key, (source, _, _, size) in want.items():
        assert goal[source] // total[source] <= copies[key] <= 3
    for source, target in goal.items():
        assert abs(taken[source] - target) <= max(size for s, _, _, size in want.values() if s == source)
    assert len(rows) > 120


def test_stages_keep_the_columns_of_documents(spark, none, tmp_path):
    import corpus_pipeline
    none.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert number == 4 or out.columns == none.columns
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        assert docs.count() == 0
