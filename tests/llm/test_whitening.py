"""Whitening against numpy over all rows."""

import math

import numpy as np
import pytest

from staffscope.llm import whitening
from staffscope.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, n long, x string, component int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(vec_id, vector, 5, "x", 7) for vec_id, vector in rows], SCHEMA).repartition(parts)


def plain(vectors, weights=None):
    """n, deviation per vector, whitened up to sign per vector, explained shares."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = (n * x - total) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    used = values > 1e-10 * values.max()
    return ((n * x - total) ** 2).sum(axis=1), centred @ axes[:, used] / np.sqrt(values[used]), values[used] / values.sum()


def check(got, vectors, most=32):
    deviation, whitened, explained = plain([v for _, v in vectors])
    rows = sorted(got.collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.component))
    assert len(rows) == len(vectors) * min(most, len(explained))
    assert all(r.identity_error <= 1e-4 and r.n == len(vectors) for r in rows)
    place = {vec_id: at for at, (vec_id, _) in enumerate(vectors)}
    for r in rows:
        at = place[r.vec_id]
        assert r.deviation == deviation[at]
        assert math.isclose(abs(r.whitened), abs(whitened[at, r.component - 1]), abs_tol=1e-7)
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-4)


def test_whiten(spark):
    rng = np.random.default_rng(3)
    vectors = [(n, (rng.normal(size=6) * [9, 5, 3, 2, 1.5, 1]).astype(np.float32).tolist()) for n in range(80)]
    vectors += [(100 + n, vectors[n % 2][1]) for n in range(60)]  # a hot vector
    bad = [(300, None), (301, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (302, [float("nan")] * 6), (303, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]), (304, []), (305, [1.0])]
    check(whitening.whiten(frame(spark, vectors + bad)), vectors)
    signs = {}
    for r in whitening.whiten(frame(spark, vectors), most=2).collect():
        signs.setdefault((r.vec_id, r.component), r.whitened)
    assert len(signs) == 2 * len(vectors)
    for n in range(60):  # equal vectors have equal answers
        assert signs[100 + n, 1] == signs[n % 2, 1]


def test_repeated_and_unnamed_rows(spark):
    rng = np.random.default_rng(4)
    vectors = [rng.normal(size=3).tolist() for _ in range(9)]
    rows = [(1, v) for v in vectors] + [(None, v) for v in vectors[:4]]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 3 * len(rows) and {r.n for r in got} == {len(rows)}


def test_fit_weights(spark):
    """A vector held often moves the fit; counted once it does not."""
    rng = np.random.default_rng(5)
    once = [(n, rng.normal(size=3).tolist()) for n in range(30)]
    rows = whitening.distinct(whitening.prepared(frame(spark, once + [(100 + n, once[0][1]) for n in range(90)])))
    alone = whitening.fit(rows, weighted=False)
    assert alone.n == 30 and whitening.fit(rows).n == 120
    only = whitening.fit(whitening.distinct(whitening.prepared(frame(spark, once))))
    assert np.allclose(alone.explained, only.explained)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(n, [1.0, 2.0]) for n in range(5)]])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whiten(frame(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_fewer_directions_than_dimensions(spark):
    vectors = [(n, [float(n), 2.0 * n, 1.0]) for n in range(8)]
    got = whitening.whiten(frame(spark, vectors)).collect()
    assert {r.component for r in got} == {1} and all(math.isclose(r.explained, 1, rel_tol=1e-9) for r in got)


def test_very_large_entries(spark):
    got = whitening.whiten(frame(spark, [(1, [3e38, 1.0]), (2, [-3e38, 0.0]), (3, [0.0, 5.0])])).collect()
    assert got and all(math.isfinite(r.whitened) for r in got) and any(r.deviation is None for r in got)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(QUERIES["op11_whitening"](spark, sf), vectors)
