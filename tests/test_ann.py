"""The inverted-file index, against all pairs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import ann, linking, vectors


def near_truth(items, asked, k, least=-2.0):
    ids, x = np.array([i for i, _ in items]), np.array([v for _, v in items])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for i, v in asked:
        s = x @ (np.array(v) / np.linalg.norm(v))
        out[str(i)] = {str(ids[j]) for j in sorted(range(len(ids)), key=lambda j: (-round(s[j], 9), str(ids[j])))[:k] if s[j] >= least}
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, set()).add(r.item_id)
    return out


def frame(spark, rows, names="item_id long, vector array<double>"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], names)


def crowd(rng, n, dim, centres):
    middle = rng.normal(size=(centres, dim))
    return [(i, middle[rng.integers(centres)] + rng.normal(size=dim) * 0.4) for i in range(n)]


def test_indexed_neighbours_are_nine_of_ten(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = crowd(rng, 3000, 24, 60)
    index = ann.build_index(frame(spark, rows), f"file://{tmp_path}/i")
    assert 30 <= len(index.centroids) <= 60 and index.probes < len(index.centroids) / 2
    asked = rows[::50]
    truth = near_truth(rows, asked, 10)
    got = found(vectors.knn_join(frame(spark, asked, "query_id long, vector array<double>"), index, 10, -1.0))
    assert sum(len(got[q] & truth[q]) for q in truth) / sum(map(len, truth.values())) >= 0.9
    # with all cells the result is exact, and so are scores
    exact = vectors.knn_join(frame(spark, asked, "query_id long, vector array<double>"), frame(spark, rows), 10, -1.0)
    every = vectors.knn_join(frame(spark, asked, "query_id long, vector array<double>"), index, 10, -1.0, probes=len(index.centroids))
    assert {(r.query_id, r.item_id, round(r.score, 9)) for r in every.collect()} == {(r.query_id, r.item_id, round(r.score, 9)) for r in exact.collect()}


def test_index_of_the_given_vectors(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    items = e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = ann.build_index(items, f"file://{tmp_path}/i")
    truth, got = found(vectors.knn_join(asked, items)), found(vectors.knn_join(asked, index))
    recall = sum(len(got.get(q, set()) & truth[q]) for q in truth) / sum(map(len, truth.values()))
    print("recall", recall, "cells", len(index.centroids), "probes", index.probes)
    assert recall >= 0.9


def test_large_cells_are_compared_in_tiles(spark, tmp_path, monkeypatch):
    """A third of all vectors are alike: their cell is split, on both sides, and nothing of it is lost."""
    monkeypatch.setattr(ann, "CELL_ROWS", 40)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.0, 0.0, 0.0] + rng.normal(size=4) * 0.001) for i in range(200)] + [(1000 + i, rng.normal(size=4)) for i in range(400)]
    index = ann.build_index(frame(spark, rows).repartition(5), f"file://{tmp_path}/i", cells=8)
    asked = rows[:100] + rows[300:320]
    pairs = index.pairs(frame(spark, asked, "query_id long, vector array<double>"), probes=8)
    assert pairs.groupBy("cell", "p", "q").count().agg(F.max("count")).first()[0] < 200
    got = found(vectors.knn_join(frame(spark, asked, "query_id long, vector array<double>"), index, 7, -1.0, probes=8))
    assert got == near_truth(rows, asked, 7)


def test_index_is_kept_and_grows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = crowd(rng, 400, 8, 10)
    path = f"file://{tmp_path}/i"
    ann.build_index(frame(spark, rows[:300]), path)
    again = ann.open_index(spark, path)
    again.add(frame(spark, rows[300:]))
    asked = rows[::40]
    got = found(vectors.knn_join(frame(spark, asked, "query_id long, vector array<double>"), again, 5, -1.0, probes=len(again.centroids)))
    assert got == near_truth(rows, asked, 5)


def test_odd_vectors(spark, tmp_path):
    """Nulls, zeros, other lengths and numbers that are none match nothing; an index without vectors finds nothing."""
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, []), (9, [-1.0, 0.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "item_id long, vector array<double>")
    index = ann.build_index(df.withColumn("cellar", F.lit(1)), f"file://{tmp_path}/i", cells=2)
    asked = df.withColumnRenamed("item_id", "query_id")
    got = found(vectors.knn_join(asked, index, 5, 0.5, probes=2))
    assert got == {"1": {"1", "2"}, "2": {"1", "2"}, "9": {"9"}}
    none = ann.build_index(df.where("vector is null"), f"file://{tmp_path}/none")
    assert vectors.knn_join(asked, none).count() == 0
    assert vectors.knn_join(asked.where("false"), index).count() == 0


def test_plan_reads_cells_and_compares_no_blocks_of_all(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = crowd(rng, 500, 8, 10)
    index = ann.build_index(frame(spark, rows), f"file://{tmp_path}/i")
    asked = frame(spark, rows[:2], "query_id long, vector array<double>")
    df = vectors.knn_join(asked, index, probes=1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # of the table only files of the probed cells are read
    assert re.search(r"PartitionFilters: \[[^]]*cell#\d+ (IN \(|= |INSET)", plan) and 2 < len(index.centroids)


@pytest.mark.parametrize("how", ["text", "face"])
def test_links_by_index(spark, tmp_path, how):
    rng = np.random.default_rng(5)
    x = crowd(rng, 400, 12, 40)
    side = lambda i: "missing" if i % 2 else "found"
    schema = "id string, kind string, full_name string, source string, source_url string, photo_url string, text_embedding array<double>"
    r = spark.createDataFrame([(f"r{i}", side(i), f"Ana Pérez {i}", "s", None, None, [float(a) for a in v]) for i, v in x], schema)
    if how == "text":
        exact, indexed = (linking.link_by_text(r, 0.6, 0.7, index_folder=f) for f in (None, f"file://{tmp_path}/t"))
    else:
        p = spark.createDataFrame([(i, f"r{i}", [float(a) for a in v], True) for i, v in x], "id long, report_id string, face_embedding array<double>, quality_ok boolean")
        exact, indexed = (linking.link_by_face(r, p, 0.6, 0.7, index_folder=f) for f in (None, f"file://{tmp_path}/f"))
    want, got = ({(a.missing_id, a.found_id, round(a.combined_score, 9)) for a in df.collect()} for df in (exact, indexed))
    assert len(want) > 100 and len(got & want) >= 0.9 * len(want)
