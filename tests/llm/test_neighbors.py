import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from barloom.llm import neighbors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20, every=20):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for i, v in rows:
        if i % every == 0:
            scored = sorted(((-float(v @ w), j) for j, w in rows if j != i))[:k]
            out[i] = [(j, -s) for s, j in scored]
    return out


def collect(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def recall(got, want):
    return np.mean([len({j for j, _ in got.get(i, [])} & {j for j, _ in w}) / len(w) for i, w in want.items()])


def test_recall_and_scores_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got, want = collect(neighbors.nearest(df, F.col("vec_id") % 20 == 0)), brute(rows)
    assert recall(got, want) >= 0.9
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for i, found in got.items():
        assert all(abs(s - float(vectors[i] @ vectors[j])) < 1e-12 for j, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and i not in dict(found)


def test_recall_holds_for_many_vectors(spark, tmp_path):
    x = np.random.default_rng(7).normal(size=(100_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    table = pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 64).cast(pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "many.parquet", row_group_size=10_000)
    got = collect(neighbors.nearest(spark.read.parquet(str(tmp_path / "many.parquet")), F.col("vec_id") % 1000 == 0))
    x, want = x.astype(float), {}
    for i in range(0, len(x), 1000):
        score = x @ x[i]
        score[i] = -np.inf
        want[i] = [(j, score[j]) for j in np.argsort(-score)[:20]]
    assert set(got) == set(want) and recall(got, want) >= 0.9


def test_one_bucket_where_no_depth_is_enough(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "RECALL", 1.1)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(400)]
    got, want = collect(neighbors.nearest(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), F.col("vec_id") % 20 == 0)), brute(rows)
    assert recall(got, want) == 1.0


def test_lengths_that_differ(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=16) * rng.lognormal(0, 0.7)).tolist()) for i in range(1500)]
    got, want = collect(neighbors.nearest(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), F.col("vec_id") % 20 == 0)), brute(rows)
    assert recall(got, want) >= 0.9


def test_hot_vectors_are_split_not_dropped(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "SHARD", 32)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=12)
    rows = [(i, (centre + rng.normal(size=12) * (1e-3 if i % 3 else 1.0)).tolist()) for i in range(600)]
    for limit in (neighbors.BROADCAST_SHARDS, -1):
        monkeypatch.setattr(neighbors, "BROADCAST_SHARDS", limit)
        got, want = collect(neighbors.nearest(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), F.col("vec_id") % 20 == 0)), brute(rows)
        assert recall(got, want) >= 0.9


def test_edges(spark):
    same = [1.0, 2.0, 0.0]
    rows = [(i, same, 0) for i in range(60)] + [(100, [0.0, 0.0, 0.0], 0), (101, None, 0), (120, [1.0, None, 2.0], 0), (140, [float("nan"), 1.0, 1.0], 0), (160, [float("inf"), 1.0, 0.0], 0), (180, [1.0, 2.0], 0), (None, same, 0), (20, same, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("point", F.lit("clash")).withColumn("score", F.lit(1))
    got = collect(neighbors.nearest(df, F.col("vec_id") % 20 == 0))
    assert set(got) == {0, 20, 40}
    assert [j for j, _ in got[0]] == list(range(1, 21))
    assert [j for j, _ in got[20]] == [*range(20)]
    assert {s for _, s in got[0]} == {5.0}
    few = collect(neighbors.nearest(spark.createDataFrame([(0, [1.0, 0.0], 0), (7, [0.5, 0.5], 0)], SCHEMA), F.col("vec_id") % 20 == 0))
    assert few == {0: [(7, 0.5)]}
    assert neighbors.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []


def test_lengths_of_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8 if i % 3 else 5).tolist()) for i in range(200)]
    got = collect(neighbors.nearest(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), F.col("vec_id") % 20 == 0))
    for n in (5, 8):
        own = [(i, v) for i, v in rows if len(v) == n]
        assert recall({i: got[i] for i, v in own if i % 20 == 0}, brute(own)) >= 0.9


def test_any_number_of_lengths(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "TABLED_LENGTHS", 1)
    monkeypatch.setattr(neighbors, "SHARD", 16)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8 if i % 2 else 2 + i // 20 % 5).tolist()) for i in range(600)]
    got = collect(neighbors.nearest(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), F.col("vec_id") % 20 == 0))
    for n in range(2, 7):
        want = brute([(i, v) for i, v in rows if len(v) == n], k=20)
        assert want and all([j for j, _ in got[i]] == [j for j, _ in w] for i, w in want.items())


def test_probes_come_in_order_of_promise():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(5, 6))
    tables = neighbors.Tables(6, 3, 1.0, cosine=0.6)
    every = tables.of_queries(y, neighbors.CELLS**3)
    assert all(len(set(every[i, t])) == neighbors.CELLS**3 for i in range(5) for t in range(tables.tables))
    assert (tables.of_queries(y, 20) == every[:, :, :20]).all()
    # Vectors at that angle mostly lie in the first buckets.
    unit = y / np.linalg.norm(y, axis=1, keepdims=True)
    noise = rng.normal(size=(2000, 6))
    noise -= (noise @ unit[0])[:, None] * unit[0]
    near = 0.6 * unit[0] + 0.8 * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    held = tables.of_vectors(near)
    hits = [np.isin(held[:, t], every[0, t, : neighbors.CELLS**3 // 3]).mean() for t in range(tables.tables)]
    assert min(hits) > 0.6


def test_only_visited_buckets_are_scored():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 8))
    part = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(4001), pa.int32()), pa.array(np.arange(4000) % 50)), pa.array(np.arange(4000)), pa.ListArray.from_arrays(pa.array(np.arange(4001) * 8, pa.int32()), pa.array(x.reshape(-1)))], names=["buckets", "point", "vector"])
    y = rng.normal(size=(30, 8))
    ask = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(31) * 2, pa.int32()), pa.array(np.tile([3, 70], 30))), pa.array(np.arange(30)), pa.ListArray.from_arrays(pa.array(np.arange(31) * 8, pa.int32()), pa.array(y.reshape(-1)))], names=["buckets", "point", "vector"])
    index = neighbors.Bucketed([part])
    found = index.best([ask], 5).to_pydict()
    assert index.scored == 30 * 80
    for q in range(30):
        want = sorted(((x[3::50] @ y[q])), reverse=True)[:5]
        assert np.allclose(sorted((s for i, s in zip(found["query"], found["score"], strict=True) if i == q), reverse=True), want)
