"""Names, places and vectors for spark.sql: scalar functions, and nearest neighbours as a table-valued function (UD2)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import fuzzy


class Nearest:
    """nearest(TABLE(items) PARTITION BY (part), query => array, least => cosine, k => number): id and score of each
    partition's k nearest items, ties by id. items: id, vector and what it is partitioned by; ORDER BY and LIMIT over the
    result give the k nearest of all. Items come as Arrow batches and are weighed by one matrix product a batch; k items are
    held. Vectors that are null, zero, of another length or not of finite numbers match nothing."""

    def __init__(self):
        self.names, self.scores = np.empty(0, object), np.empty(0)

    def eval(self, items, query, least, k):
        if not len(query) or query[0].as_py() is None:
            return
        asked = np.asarray(query[0].values.to_numpy(zero_copy_only=False), np.float64)
        least, k = float(least[0].as_py()), int(k[0].as_py())
        lists, ids = (items.column(items.schema.get_field_index(c)) for c in ("vector", "id"))
        cut = lists.offsets.to_numpy()
        rows = np.flatnonzero((np.diff(cut) == len(asked)) & ~lists.is_null().to_numpy(zero_copy_only=False))
        flat = np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64)
        x = flat[cut[rows][:, None] + np.arange(len(asked))]
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.round(x @ asked / (np.linalg.norm(x, axis=1) * np.linalg.norm(asked)), 9)
        good = np.flatnonzero(score >= least)
        names = np.array(ids.take(pa.array(rows[good])).cast(pa.string()).to_pylist(), object)
        names, score = np.concatenate([self.names, names]), np.concatenate([self.scores, score[good]])
        best = sorted(range(len(names)), key=lambda i: (-score[i], names[i]))[:k] if len(names) <= 4 * k else self._edge(names, score, k)
        self.names, self.scores = names[best], score[best]
        return
        yield

    @staticmethod
    def _edge(names: np.ndarray, score: np.ndarray, k: int) -> list[int]:
        """The k best, after those that are surely worse are left out; ties at the edge stay in."""
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k]) if k else np.empty(0, np.int64)
        return sorted(some, key=lambda i: (-score[i], names[i]))[:k]

    def terminate(self):
        yield pa.table({"id": pa.array(self.names, pa.string()), "score": pa.array(self.scores, pa.float64())})


def _pairwise(f):
    @F.pandas_udf("double")
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return fuzzy.scored(f, a, b)

    return apply


#: SQL name -> function of two texts.
SCALARS = {
    "fuzzy_ratio": fuzzy.plain_ratio,
    "fuzzy_token_sort_ratio": fuzzy.sort_ratio,
    "fuzzy_partial_ratio": fuzzy.window_ratio,
    "fuzzy_weighted_ratio": fuzzy.weighted_ratio,
    "fuzzy_name_score": fuzzy.name_match,
}


def register(spark: SparkSession) -> None:
    """Makes SCALARS and nearest known to the session's SQL."""
    for name, f in SCALARS.items():
        spark.udf.register(name, _pairwise(f))
    spark.udtf.register("nearest", F.arrow_udtf(Nearest, returnType="id string, score double"))
