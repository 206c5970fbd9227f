"""Whitening against fractions of whole numbers, with the offset and sizes that plain float64 sums lose."""

import math
from fractions import Fraction

import numpy as np
import pytest

from offerlake.llm import queries, whitening

from .conftest import SF

SCHEMA = "vec_id long, embedding array<double>, n long, id string, vector int"


def integers(vector):
    return [math.floor(64 * c) + 1_000_000 for c in vector]


def moments(xs):
    """Sums and the covariance's numerator (over n cubed), from whole numbers alone."""
    n, sums = len(xs), [sum(c) for c in zip(*xs)]
    centred = [[n * a - s for a, s in zip(x, sums)] for x in xs]
    return sums, centred


def test_query_over_the_whole_table(spark):
    table = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    xs = [integers(map(float, r.embedding)) for r in table]
    n, (sums, centred) = len(xs), moments(xs)
    df = queries.op12_whitening(spark, SF)
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    rows = df.collect()
    assert len(rows) == n * 32 and {r.n for r in rows} == {n}
    assert {(r.vec_id, r.deviation) for r in rows} == {(t.vec_id, sum(c * c for c in x)) for t, x in zip(table, centred)}
    exact = np.array([[float(Fraction(sum(a[i] * a[j] for a in centred), n**3)) for j in range(64)] for i in range(64)])
    values, axes = np.linalg.eigh(exact)
    made = np.zeros((n, 32))
    at = {t.vec_id: k for k, t in enumerate(table)}
    for r in rows:
        made[at[r.vec_id], r.component - 1] = r.whitened
    plain = np.array([[c / n for c in x] for x in centred]) @ axes[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    assert np.abs(np.abs(made) - np.abs(plain)).max() < 1e-8
    assert np.allclose([r.explained for r in rows[:32]], values[::-1][:32] / np.trace(exact), rtol=1e-9)
    covariance = made.T @ made / n
    (error,) = {r.identity_error for r in rows}
    assert error < 1e-10 and abs(covariance - np.eye(32)).max() < 1e-10


@pytest.mark.parametrize("far", [1, 1 << 19, (1 << 20) + 1, 1 << 40, 1 << 61])
def test_products_of_any_size_are_exact(far):
    rng = np.random.default_rng(far)
    z = rng.integers(-far, far, (300, 5), endpoint=True)
    z[0], z[1] = far, -far
    rows = z.tolist()
    assert whitening.gram(z).tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(5)] for i in range(5)]
    full = np.full(((1 << 13) + 5, 2), far)
    assert whitening.gram(full).tolist() == [[((1 << 13) + 5) * far * far] * 2] * 2


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e9, 1e14])
def test_deviations_of_any_size(spark, scale):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(50, 3)) * scale).tolist()
    model = whitening.fit(spark.createDataFrame([(i, v, None, None, None) for i, v in enumerate(vectors)], SCHEMA))
    xs = [integers(v) for v in vectors]
    sums, centred = moments(xs)
    assert model.sums == sums and model.identity_error < 1e-9
    found = {r.vec_id: r.deviation for r in model.transform(spark.createDataFrame([(i, v, None, None, None) for i, v in enumerate(vectors)], SCHEMA)).collect()}
    for i, x in enumerate(centred):
        exact = sum(c * c for c in x)
        assert found[i] == (exact if exact < 10**38 else None)


def test_odd_rows(spark):
    good = [(1, [0.5, 1.0, 7.0], 1, "a", 2), (1, [0.5, 1.0, 7.0], 1, "a", 2), (None, [0.25, -1.0, 7.0], None, None, None), (4, [9.0, 0.0, 7.0], 1, "b", 1)]
    bad = [(5, None, 1, "", 1), (6, [1.0, None, 2.0], 1, "", 1), (7, [1.0, float("nan"), 2.0], 1, "", 1), (8, [1.0, float("-inf"), 2.0], 1, "", 1), (9, [], 1, "", 1), (10, [1.0], 1, "", 1)]
    df = spark.createDataFrame(good + bad, SCHEMA)
    model = whitening.fit(df)
    rows = model.transform(df).collect()
    assert model.n == 4 and model.dim == 3 and sorted((r.vec_id is not None, r.vec_id or 0) for r in rows) == [(False, 0), (True, 1), (True, 1), (True, 4)]
    assert model.values[2] == 0 and all(r.whitened[2] == 0.0 for r in rows) and model.identity_error < 1e-9
    assert len({tuple(r.whitened) for r in rows if r.vec_id == 1}) == 1
    alone = whitening.fit(df.limit(0).union(spark.createDataFrame(good[:1], SCHEMA)))
    assert alone.n == 1 and alone.explained == [0.0] * 3 and alone.identity_error == 0.0
    none = whitening.fit(df.limit(0))
    assert none.n == 0 and none.transform(df.limit(0)).collect() == [] and none.explained == []
