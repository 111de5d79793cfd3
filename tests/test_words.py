"""Trees, components, the vocabulary fold and nearest words, against plain Python on small inputs."""

import random
from datetime import datetime

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from staffscope.operators import terms as ops
from staffscope.operators.graph import connected_components
from staffscope.operators.judgments import settle
from staffscope.operators.neighbours import nearest
from staffscope.operators.trees import TreeError, closure, depths, validate_tree

NOW = datetime(2025, 1, 1)


def test_closure_of_a_deep_chain(spark):
    edges = spark.createDataFrame([(str(n), str(n - 1) if n else None) for n in range(11)], "name string, parent string")
    got = {(r["name"], r["ancestor"]): r["depth"] for r in closure(edges).collect()}
    assert got == {(str(a), str(b)): a - b for a in range(11) for b in range(a + 1)}
    assert {r["id"]: (r["root"], r["depth"]) for r in depths(edges, "name", "parent").collect()} == {str(n): ("0", n) for n in range(11)}


@pytest.mark.parametrize("edges", [[("a", "b"), ("b", "a")], [("a", "a")], [("a", "x")], [("a", None), ("a", None)], [("", None)],
                                   [(str(n), str((n + 1) % 7)) for n in range(7)]])
def test_broken_trees_are_refused(spark, edges):
    with pytest.raises(TreeError):
        validate_tree(spark.createDataFrame(edges, "name string, parent string"))


def test_components(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)] + [(f"n{n:02}", f"n{n + 1:02}") for n in range(70, 90)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    for x in list(parent):
        find(x)
    want = {x: find(x) for x in parent}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == want


def table(spark, rows):
    full = [(w, c, sent, p, x, None) for w, c, sent, p, x in rows]
    return spark.createDataFrame(full, ops.TERM_DDL)


def placed(spark, rows, judged):
    df = spark.createDataFrame([(n, *j) for n, j in enumerate(judged)], "id long, word string, verdict string, target string")
    out = ops.apply_judgments(table(spark, rows), df, NOW)
    return {r["word"]: (r["canonical"], r["parent"], r["excluded"], r["reviewed_at"] is not None) for r in out.collect()}


HEADS = [(w, w, False, None, False) for w in "abcd"]


def test_same_joins_whole_items_and_keeps_the_targets_parent(spark):
    rows = [("a", "a", False, None, False), ("a2", "a", False, None, False), ("kid", "kid", False, "a", False), ("b", "b", False, "top", False),
            ("top", "top", False, None, False)]
    got = placed(spark, rows, [("a2", "same", "b")])
    assert got == {"a": ("b", None, False, False), "a2": ("b", None, False, True), "kid": ("kid", "b", False, False), "b": ("b", "top", False, False),
                   "top": ("top", None, False, False)}


def test_sent_back_alias_moves_alone(spark):
    rows = [("a", "a", False, None, False), ("a2", "a", True, None, False), ("b", "b", False, None, False)]
    assert placed(spark, rows, [("a2", "same", "b")])["a"] == ("a", None, False, False)


def test_under_creates_the_parent_and_drops_cycles(spark):
    got = placed(spark, HEADS, [("a", "under", "new"), ("b", "under", "a"), ("a", "under", "b")])
    assert got["new"] == ("new", None, False, False) and got["b"] == ("b", "a", False, True)
    assert got["a"] == ("a", None, False, True)  # would have gone round: the parent is dropped


def test_excluded_releases_and_refuses_links(spark):
    rows = HEADS + [("a2", "a", False, None, False), ("kid", "kid", False, "a", False)]
    got = placed(spark, rows, [("a", "excluded", None), ("b", "same", "a"), ("c", "under", "a")])
    assert got["a"] == ("a", None, True, True) and got["a2"] == ("a2", None, False, False) and got["kid"] == ("kid", None, False, False)
    assert got["b"] == ("b", None, False, False) and got["c"] == ("c", None, False, True)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from(["same", "under", "alone", "excluded"]), st.sampled_from("abcdefghx")), min_size=1, max_size=10))
def test_every_sequence_leaves_a_valid_table(spark, judged):
    judged = [(w, v, t if v in ("same", "under") else None) for w, v, t in judged if w != t]
    if not judged:
        return
    rows = [(w, w, False, None, False) for w in "abcdefgh"]
    df = spark.createDataFrame([(n, *j) for n, j in enumerate(judged)], "id long, word string, verdict string, target string")
    ops.validate_terms(ops.apply_judgments(table(spark, rows), df, NOW))


def test_same_chains_give_one_item_in_any_order(spark):
    for order in ([("a", "b"), ("b", "c"), ("c", "d")], [("c", "d"), ("a", "b"), ("b", "c")]):
        got = placed(spark, HEADS, [(a, "same", b) for a, b in order])
        assert len({row[0] for row in got.values()}) == 1


def straight(rows, judged):
    """All judgments placed over the whole table in one go."""
    held = [dict(zip(ops.ROW, (w, c, sent, p, x, None))) for w, c, sent, p, x in rows]
    return {r["word"]: (r["canonical"], r["parent"], r["excluded"], r["reviewed_at"] is not None) for r in ops.place_all(held, judged, NOW)}


def test_parts_and_followers_give_what_the_whole_table_gives(spark):
    rng = random.Random(12)
    for _ in range(6):
        words = [f"w{n}" for n in range(40)]
        rows = []
        for n, w in enumerate(words):
            alias = n > 12 and rng.random() < 0.5
            head = f"w{rng.randrange(12)}" if alias else w
            up = None if alias or n == 0 or rng.random() < 0.4 else f"w{rng.randrange(min(n, 12))}"
            rows.append((w, head, alias and rng.random() < 0.3, up, False))
        judged = []
        for _ in range(12):
            w, v = rng.choice(words[:20]), rng.choice(["same", "under", "alone", "excluded", "same", "under"])
            t = rng.choice([x for x in words[:20] + ["new"] if x != w])
            judged.append((w, v, t if v in ("same", "under") else None))
        assert placed(spark, rows, judged) == straight(rows, judged)


def random_queue(rng, words=40, judged=12, named=20):
    rows = []
    for n in range(words):
        alias = n > 12 and rng.random() < 0.5
        head = f"w{rng.randrange(12)}" if alias else f"w{n}"
        up = None if alias or n == 0 or rng.random() < 0.4 else f"w{rng.randrange(min(n, 12))}"
        rows.append((f"w{n}", head, alias and rng.random() < 0.3, up, False))
    queue = []
    for _ in range(judged):
        w, v = f"w{rng.randrange(named)}", rng.choice(["same", "under", "alone", "excluded", "same", "under"])
        t = rng.choice([x for x in [f"w{n}" for n in range(named)] + ["new", "newer"] if x != w])
        queue.append((w, v, t if v in ("same", "under") else None))
    return rows, queue


def full(rows):
    """Every column, marks and times included."""
    return sorted((r["word"], r["canonical"], r["alias_sent_back"], r["parent"], r["excluded"], str(r["reviewed_at"])) for r in rows)


def test_rounds_give_what_one_by_one_gives(spark):
    """Forty tables with their queues side by side: their words are told apart by a prefix, their judgments interleave."""
    rng = random.Random(21)
    held, judged, want = [], [], []
    for case in range(40):
        rows, queue = random_queue(rng, words=rng.choice((14, 40)), judged=rng.choice((3, 8)), named=rng.choice((4, 9, 14)))
        own = lambda w: w and f"{case:02}{w}"  # noqa: B023, E731
        mine = [dict(zip(ops.ROW, (own(w), own(c), sent, own(p), x, datetime(2020, 1, 1 + n % 28) if n % 3 else None))) for n, (w, c, sent, p, x) in enumerate(rows)]
        asked = [(own(w), v, own(t)) for w, v, t in queue]
        want += ops.place_all(mine, asked, NOW)
        held += mine
        judged += [(100 * n + case, *j) for n, j in enumerate(asked)]
    terms = spark.createDataFrame([tuple(row.values()) for row in held], ops.TERM_DDL)
    df = spark.createDataFrame(judged, "id long, word string, verdict string, target string")
    settled, left = settle(terms, df, NOW, rounds=8)
    assert left.isEmpty() and full(settled.collect()) == full(want)
    assert full(ops.apply_judgments(terms, df, NOW, rounds=1).collect()) == full(want)  # the rest one by one


def test_a_queue_on_one_hub_is_a_few_rounds(spark):
    """Most of the queue puts words under one hub or makes them the same as it, while the hub itself moves once."""
    rows = [(w, w, False, None, False) for w in ("hub", "top", "other")] + [(f"w{n}", f"w{n}", False, None, False) for n in range(900)]
    queue = [(f"w{n}", ("same", "under")[n % 2], "hub") for n in range(600)]
    queue[300:300] = [("hub", "under", "top")]
    queue += [(f"w{n}", "same", "other") for n in range(600, 900)] + [("w3", "alone", None), ("w5", "same", "w7")]
    df = spark.createDataFrame([(n, *j) for n, j in enumerate(queue)], "id long, word string, verdict string, target string")
    terms, left = settle(table(spark, rows), df, NOW, rounds=3)
    assert left.isEmpty()
    got = {r["word"]: (r["canonical"], r["parent"], r["excluded"], r["reviewed_at"] is not None) for r in terms.collect()}
    assert got == straight(rows, queue) and got["hub"] == ("hub", "top", False, True) and got["w5"] == ("w7", None, False, True)


def test_a_long_chain_ends_one_by_one(spark):
    rows = [(f"c{n}", f"c{n}", False, None, False) for n in range(30)]
    queue = [(f"c{n}", "under", f"c{n + 1}") for n in range(29)] + [(f"c{n}", "same", f"c{n + 1}") for n in range(29)]
    assert placed(spark, rows, queue) == straight(rows, queue)


def test_a_hub_with_thousands_of_followers(spark):
    rows = HEADS + [(f"a{n}", "a", n % 5 == 0, None, False) for n in range(3000)] + [(f"k{n}", f"k{n}", False, "a", False) for n in range(3000)]
    got = placed(spark, rows, [("a", "same", "b"), ("b", "under", "c")])
    assert got["a7"] == ("b", None, False, False) and got["k7"] == ("k7", "b", False, False) and got["b"] == ("b", "c", False, True)
    got = placed(spark, rows, [("a", "same", "b"), ("b", "excluded", None)])
    assert got["a7"] == ("a7", None, False, False) and got["k7"] == ("k7", None, False, False) and len(got) == len(rows)


def test_rename_prefers_writers_and_keeps_ties(spark):
    rows = [("a", "a", False, "p", False), ("a2", "a", False, None, False), ("a3", "a", True, None, False), ("p", "p", False, None, False),
            ("kid", "kid", False, "a", False), ("b", "b", False, None, False), ("b2", "b", False, None, False)]
    writers = spark.createDataFrame([("a", 1), ("a2", 5), ("a3", 9), ("b", 2), ("b2", 2)], "word string, writers long")
    got = {r["word"]: (r["canonical"], r["parent"]) for r in ops.rename_items(table(spark, rows), writers).collect()}
    assert got == {"a": ("a2", None), "a2": ("a2", "p"), "a3": ("a2", None), "p": ("p", None), "kid": ("kid", "a2"), "b": ("b", None), "b2": ("b", None)}


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(60, 16)).astype("float32")
    vectors[7] = 0.0
    vectors[11] = vectors[12]
    words = [f"w{n:02}" for n in range(60)]
    df = spark.createDataFrame([(w, [float(x) for x in v], w) for w, v in zip(words, vectors)], "word string, embedding array<float>, pos string")
    unit = vectors.astype("float64")
    norm = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = unit / np.where(norm == 0, 1, norm)
    scores = np.round(unit @ unit.T, 9)
    got = {}
    for r in nearest(df, df.drop("pos"), 8, block_rows=25).collect():
        got.setdefault(r["word"], {})[r["place"]] = r["near"]
    for at, word in enumerate(words):
        order = sorted((n for n in range(60) if n != at), key=lambda n: (-scores[at, n], words[n]))[:8]
        assert [got[word][place] for place in range(1, 9)] == [words[n] for n in order]


def test_nearest_searches_few_blocks_and_finds_all(spark, monkeypatch):
    """Words in tight groups: most blocks are ruled out by their angle, and the answers stay those of comparing all."""
    from staffscope.operators import neighbours
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 24))
    vectors = np.concatenate([c + 0.05 * rng.normal(size=(40, 24)) for c in centres]).astype("float32")
    vectors[3] = vectors[4] = vectors[5]
    words = [f"w{n:03}" for n in range(len(vectors))]
    df = spark.createDataFrame([(w, [float(x) for x in v], w) for w, v in zip(words, vectors)], "word string, embedding array<float>, pos string")
    sent, real = [], neighbours._search
    monkeypatch.setattr(neighbours, "_search", lambda k: sent.append(k) or real(k))
    unit = vectors.astype("float64")
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 12)
    got = {}
    for r in nearest(df, df.drop("pos"), 5, block_rows=20).collect():
        got.setdefault(r["word"], {})[r["place"]] = r["near"]
    for at, word in enumerate(words):
        order = sorted((n for n in range(len(words)) if n != at), key=lambda n: (-scores[at, n], words[n]))[:5]
        assert [got[word][place] for place in range(1, 6)] == [words[n] for n in order]
    assert nearest(df.limit(0), df.drop("pos"), 5).count() == 0 and nearest(df, df.drop("pos").limit(0), 5).count() == 0
    few = {r["word"]: r["near"] for r in nearest(df.filter("word < 'w002'"), df.drop("pos").filter("word < 'w003'"), 5).collect()}
    assert few["w000"] == "w001" and few["w001"] == "w000" and few["w002"] in ("w000", "w001")


def test_conform_judgments(spark):
    near = [("Go", 3)]
    said = [('{"why":"","kind":"同一件事","target":"Go"}', ("same", "Go")), ('{"why":"","kind":"同一件事","target":"Rust"}', (None, None)),
            ('{"why":"","kind":"属于","target":"后端，"}', ("under", "后端")), ('{"why":"","kind":"属于","target":"go"}', (None, None)),
            ('{"why":"","kind":"自成一项","target":""}', ("alone", None)), ("nonsense", (None, None)),
            ('{"why":"","kind":"属于","target":5}', (None, None)), ('{"why":{},"kind":"自成一项","target":""}', (None, None)), ('[1]', (None, None)), ('{"kind":"自成一项","target":""}', (None, None))]
    df = spark.createDataFrame([(n, "go", near, text) for n, (text, _) in enumerate(said)],
                               "id int, word string, near array<struct<word:string,people:bigint>>, judgment string")
    got = {r["id"]: (r["verdict"], r["target"]) for r in ops.conform_judgments(df).collect()}
    assert got == {n: want for n, (_, want) in enumerate(said)}
