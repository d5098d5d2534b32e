"""Lists of vectors against exact neighbours."""

import numpy as np
import pytest

from quillspark.operators import semantic, vector_index as vi


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(20, 16))
    rows = [(i, [float(x) for x in middle[i % 20] + 0.3 * rng.normal(size=16)]) for i in range(1200)]
    rows += [(2000 + i, rows[5][1]) for i in range(300)]  # one vector many times
    return spark.createDataFrame(rows + [(5000, None), (5001, [0.0] * 16)], "vec_id long, embedding array<float>")


def asked(vectors):
    return vectors.filter("vec_id % 50 = 0 AND vec_id < 2000").withColumnRenamed("vec_id", "query_id")


def test_all_lists_are_exact(vectors):
    centroids = vi.centroids_of(vectors, "vec_id", 16)
    index = vi.laid_out(vi.assigned(vectors, centroids, "vec_id"), "vec_id")
    assert index.count() == vectors.count() - 1 and len(centroids) == 16
    rows = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in df.collect())
    assert rows(vi.search(index, centroids, asked(vectors), "vec_id", "query_id", 10, 16)) == rows(semantic.knn_cosine(vectors, asked(vectors), "vec_id", "query_id", 10))


def test_recall_grows_with_probes(vectors, spark):
    centroids = vi.centroids_of(vectors, "vec_id", 16, sample=400)
    index = vi.assigned(vectors, centroids, "vec_id")
    exact = semantic.knn_cosine(vectors, asked(vectors), "vec_id", "query_id", 10)
    share = []
    for probes in (1, 4, 16):
        r = vi.recall(vi.search(index, centroids, asked(vectors), "vec_id", "query_id", 10, probes), exact, "query_id", "vec_id", 10).selectExpr("sum(hit)", "sum(wanted)").first()
        share.append(r[0] / r[1])
    assert share == sorted(share) and share[0] > 0.6 and share[1] > 0.9 and share[2] == 1


def test_fitting(spark):
    rows = vi.unit(np.array([[1, 0], [1, 0], [1, 0], [0, 1], [0, -1]], float))
    assert len(vi.fitted(rows, 10)) == 3 and len(vi.fitted(rows[:3], 4)) == 1 and vi.fitted(rows[:0], 4).shape == (0, 0)
    assert sorted(map(tuple, np.round(vi.fitted(rows, 3), 6).tolist())) == [(0.0, -1.0), (0.0, 1.0), (1.0, 0.0)]


def test_empty_tables(vectors, spark):
    none = vectors.limit(0)
    centroids = vi.centroids_of(none, "vec_id", 4)
    assert vi.search(vi.assigned(none, centroids, "vec_id"), centroids, asked(vectors), "vec_id", "query_id", 3, 2).count() == 0
    centroids = vi.centroids_of(vectors, "vec_id", 4)
    assert vi.search(vi.assigned(vectors, centroids, "vec_id"), centroids, none.withColumnRenamed("vec_id", "query_id"), "vec_id", "query_id", 3, 2).count() == 0


def test_rows_that_come_later(vectors, spark):
    centroids = vi.centroids_of(vectors, "vec_id", 8)
    one = vi.assigned(vectors.filter("vec_id < 600"), centroids, "vec_id").unionByName(vi.assigned(vectors.filter("vec_id >= 600"), centroids, "vec_id"))
    pairs = lambda df: sorted((r["vec_id"], r["list"]) for r in df.collect())
    assert pairs(one) == pairs(vi.assigned(vectors, centroids, "vec_id"))


def test_recall_of_the_query_on_a_table(spark, sf):
    from quillspark.plans import stored

    exact = semantic.knn_cosine(spark.read.parquet(f"{sf}/embeddings.parquet"), spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), "vec_id", "query_id", 10)
    r = vi.recall(stored.vector_hits(spark, sf, stored.PROBES), exact, "query_id", "vec_id", 10).selectExpr("sum(hit) / sum(wanted)").first()[0]
    assert r >= 0.9
