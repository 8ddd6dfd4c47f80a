"""Vector searches against brute force."""

from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabular_audit.llm.cover_search import TOP_K_SQL, exact_top_k
from tabular_audit.llm.vantage_search import nearest_neighbours, search
from tabular_audit.llm.vector_blocks import neighbouring_blocks, plan_blocks

from .conftest import SF

def twentieth():
    return F.col("id") % 20 == 0


def brute(ids, vectors, k):
    out = {}
    for i in ids[ids % 20 == 0]:
        scores = vectors @ vectors[ids == i][0]
        keep = ids != i
        order = np.lexsort((ids[keep], -scores[keep]))[:k]
        out[int(i)] = list(zip(ids[keep][order].tolist(), scores[keep][order].tolist()))
    return out


def collected(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return dict(out)


def test_exact_top_k_equals_sql(spark):
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
        want = sorted(db.sql(TOP_K_SQL).fetchall())
    got = exact_top_k(spark.read.parquet(f"{SF}/embeddings.parquet"), twentieth())
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == want


def test_relax_of_one_is_exact():
    rng = np.random.default_rng(3)
    data = rng.normal(size=(3000, 6)) * rng.uniform(0.2, 2, (3000, 1))
    data[500:900] = data[500]
    ids = np.arange(3000)
    queries = data[::100]
    largest = float(np.sqrt((data ** 2).sum(axis=1).max()))
    number, vec, score = search(queries, ids[::100], np.full(30, -np.inf), data, ids, largest, 10, 1.0)
    for q in range(30):
        scores = (data * queries[q]).sum(axis=1)
        scores[q * 100] = -np.inf
        want = np.lexsort((ids, -scores))[:10]
        assert vec[number == q].tolist() == want.tolist()
        assert score[number == q] == pytest.approx(scores[want], abs=1e-12)


@pytest.fixture(scope="module")
def clustered(spark):
    """Clusters, ties, a vector that a third of the rows repeat, and several shards."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    data = centers[rng.integers(0, 12, 9000)] + rng.normal(size=(9000, 16)) * 0.3
    data[::3] = data[0]
    ids = rng.permutation(9000)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, data)]
    return ids, data, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)


def test_exact_top_k_over_several_shards(clustered):
    ids, data, frame = clustered
    want = brute(ids, np.floor(64 * data), 20)
    assert collected(exact_top_k(frame, twentieth())) == want


def test_recall_over_several_shards(clustered):
    ids, data, frame = clustered
    want, got = brute(ids, data, 20), collected(nearest_neighbours(frame, twentieth()))
    # Ties of the repeated vector make any of its rows as good: scores are compared.
    found = sum(min(len(got[q]), 20) and sum(a >= b - 1e-9 for (_, a), (_, b) in zip(got[q], want[q])) for q in want)
    assert found >= 0.95 * 20 * len(want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [1.0, 2.0, 3.0]), (20, [0.5, 0.5]), (21, [0.5, 0.5]), (21, [0.5, 0.5]), (None, [1.0, 1.0]), (40, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("id", F.lit(2))
    got = collected(nearest_neighbours(frame, twentieth()))
    assert got == {0: [(20, 0.75), (21, 0.75), (21, 0.75)], 20: [(0, 0.75), (21, 0.5), (21, 0.5)]}
    exact = collected(exact_top_k(frame, twentieth()))
    assert exact == {0: [(20, 3072), (21, 3072), (21, 3072), (3, 0)], 20: [(0, 3072), (21, 2048), (21, 2048), (3, 0)]}
    assert nearest_neighbours(frame.limit(0), twentieth()).count() == 0
    assert exact_top_k(frame.where("vec_id = 3"), twentieth()).count() == 0


def test_many_blocks_equal_brute_force(clustered):
    ids, data, frame = clustered
    sizes = dict(block_rows=64, slice_rows=256)
    assert collected(exact_top_k(frame, twentieth(), **sizes)) == brute(ids, np.floor(64 * data), 20)
    got, want = collected(nearest_neighbours(frame, twentieth(), relax=1.0, **sizes)), brute(ids, data, 20)
    assert all([s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-9) for q in want)


def test_slices_are_copied_only_where_asked(spark):
    """Clusters far apart: a block of queries visits few of the slices."""
    rng = np.random.default_rng(9)
    data = (rng.normal(size=(40, 8)) * 10)[np.arange(8000) % 40] + rng.normal(size=(8000, 8)) * 0.1
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, v array<double>")
    plan = plan_blocks(frame, twentieth(), 5, slice_rows=256, block_rows=32, sample_rows=2048)
    blocks = plan.asked.select("block").distinct().count()
    assert blocks >= 12
    copies = plan.slices.count()
    assert copies < 8000 * blocks / 3
    assert plan.slices.groupBy("shard", "part", "block").count().agg(F.max("count")).first()[0] <= 2 * 256
    per_block = plan.asked.select("block", "id").distinct().groupBy("block").count()
    assert per_block.agg(F.max("count")).first()[0] <= 40


def test_blocks_hold_neighbouring_centers():
    centers = np.array([[0.0], [10.0], [1.0], [11.0], [5.0]])
    first, count = neighbouring_blocks(centers, np.array([3, 4, 3, 4, 25]), 8)
    assert first[0] == first[2] != first[1] == first[3]
    assert count.tolist() == [1, 1, 1, 1, 4]
    taken = [set(range(f, f + c)) for f, c in zip(first, count)]
    assert not taken[4] & (taken[0] | taken[1])


def test_a_repeated_id_is_dealt_to_many_slices(spark):
    rng = np.random.default_rng(2)
    rows = [(20 if i % 3 else i, rng.normal(size=4).tolist()) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    plan = plan_blocks(frame, twentieth(), 5, slice_rows=128, block_rows=128, sample_rows=512)
    assert plan.slices.groupBy("shard", "part", "block").count().agg(F.max("count")).first()[0] <= 2 * 128


def test_products_beyond_double_precision_are_refused(spark):
    frame = spark.createDataFrame([(0, [3e6, 1.0]), (1, [1.0, 3e6])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="exact"):
        exact_top_k(frame, twentieth())
