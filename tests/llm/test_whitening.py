import numpy as np
import pytest

from barloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, `a.b` string, x string"


def by_hand(rows, k=4):
    """{vec_id: [(deviation, |whitened|) for each component]}, explained, from numpy's own eigenvectors."""
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = {i: [int(np.floor(c * 256)) for c in v] for i, v in good}
    fit = np.array(sorted({tuple(v) for v in x.values()}), float)
    n, sums = len(fit), [sum(int(c) for c in column) for column in fit.T]
    centred = fit - np.array(sums) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in x.items()}
    return n, deviation, {i: np.abs((np.array(v) - np.array(sums) / n) @ u / np.sqrt(e)) for i, v in x.items()}, e / np.trace(centred.T @ centred / n)


def check(rows, out, k=4):
    n, deviation, whitened, explained = by_hand(rows, k)
    got = {}
    for r in out:
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]]
        assert r["whitened"] is not None and abs(abs(r["whitened"]) - whitened[r["vec_id"]][r["component"] - 1]) < 1e-8 * max(1, abs(r["whitened"]))
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and 0 <= r["identity_error"] < 1e-9
    assert set(got) == {(i, c) for i in deviation for c in range(1, k + 1)}
    signs = {c: {np.sign(r["whitened"]) for (_, d), rs in got.items() for r in rs if d == c} for c in range(1, k + 1)}
    assert all(len(s) > 1 for s in signs.values())
    return got


@pytest.mark.parametrize("d", [1, 2, 3, 10, 64, 130])
def test_eigenpairs(d):
    draw = np.random.default_rng(d)
    for values in (draw.random(d), np.round(draw.random(d), 1), np.ones(d), np.concatenate(([5.0, 5.0 - 1e-12], np.zeros(d)))[:d], np.zeros(d), 10.0 ** -np.arange(d)):
        q, _ = np.linalg.qr(draw.standard_normal((d, d)))
        a = q @ np.diag(values) @ q.T
        a = (a + a.T) / 2
        e, u = whitening.leading_pairs(a, 4)
        k = min(4, d)
        size = max(np.abs(values).max(), 1e-300)
        assert np.allclose(e, np.sort(np.linalg.eigvalsh(a))[::-1][:k], atol=1e-13 * size * d, rtol=0)
        assert np.abs(u @ u.T - np.eye(k)).max() < 1e-11
        assert np.abs(a @ u.T - u.T * e).max() < 1e-13 * d * size + 1e-300
    assert np.allclose(whitening.leading_pairs(np.ones((2, 2)), 2)[0], [2, 0], atol=1e-15)
    diagonal, off = np.array([2.0, 2, 2, 2]), np.zeros(3)
    assert whitening.leading_values(diagonal, off, 2).tolist() == [2, 2]


def test_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    check(rows, whitening.whiten(table).collect())


def test_copies_nulls_and_other_columns(spark):
    draw = np.random.default_rng(3)
    rows = [(k, (draw.standard_normal(6) * [5, 4, 3, 2, 1, 0.5]).tolist()) for k in range(200)]
    rows += [(1000 + k, rows[0][1]) for k in range(300)] + [(None, None), (2001, None), (2002, []), (2003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2004, [float("nan")] * 6), (2005, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (2006, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "clash", "c", "c") for r in rows], SCHEMA)
    got = check(rows[:-1], whitening.whiten(df.repartition(5)).collect())
    assert all(len(v) == 1 for v in got.values())
    again = whitening.whiten(df.unionByName(df)).groupBy("vec_id", "component").count().collect()
    assert {r["count"] for r in again} == {2}


def test_few_dimensions_and_rows(spark):
    one = lambda *vs: whitening.whiten(spark.createDataFrame([(k, list(v), "", "", "") for k, v in enumerate(vs)], SCHEMA)).collect()
    assert one() == [] and one((1.0, 2.0)) == [] and one((1.0, 2.0), (1.0, 2.0)) == []
    rows = one((0.0, 0.0), (1.0, 1.0), (3.0, 3.0))  # one direction only
    assert len(rows) == 3 and {r["component"] for r in rows} == {1} and {round(r["explained"], 12) for r in rows} == {1.0}
    assert len(one((1.0,), (2.0,))) == 2
    mixed = one((1.0, 2.0, 0.0), (4.0,), (2.0, 5.0, 1.0), (7.0,))  # as many of either length: the shorter
    assert {r["vec_id"] for r in mixed} == {1, 3}


def test_large_numbers_stay_exact(spark):
    rows = [(1, [3e7, 1.0]), (2, [-3e7, 2.0]), (3, [1e6, 7.0]), (4, [1e30, 1.0])]
    out = whitening.whiten(spark.createDataFrame([(*r, "", "", "") for r in rows[:3]], SCHEMA), components=1).collect()
    _, deviation, _, _ = by_hand(rows[:3], 1)
    assert {r["vec_id"]: r["deviation"] for r in out} == {i: v if v < 1 << 63 else None for i, v in deviation.items()}
    assert {r["vec_id"] for r in whitening.whiten(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)).collect()} == {1, 2, 3, 4}
