"""Toxicity by a convolutional text classifier on hashed word embeddings, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first bytes, so words not seen in training still
share what their beginnings tell. An embedding's first component is the log-odds of its row by label, shrunk towards none
(from half of the sample while the other half trains, so that training sees it as new texts will); the others are learnt
with the filters. Filters of several widths run over the whole text, each filter's largest response is
kept, and a logistic layer gives the score. Scores are calibrated (Platt) on labelled rows that the filters were not
trained on; thresholds are calibrated there for each language and decide rejection, while the score itself sees the text
only.

The model is fitted on the driver from a bounded sample of labelled rows (parameter sample) and has a fixed size of about
8 MB, which is what is broadcast. Calibration scores all held labelled rows in a Spark job and reads a histogram of them.
Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._graph import Scratch
from ._words import Words, short_batches, slices, words

DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Embedding rows for whole words and for their first 4 and 6 bytes.
ROWS = (1 << 16, 1 << 15, 1 << 15)
HEADS = (4, 6)
SLICE = 512 << 10
#: Cells of the calibration's histogram: bins a unit of the logit, and the logit beyond which rows share the last bin.
BINS = 256
REACH = 64.0


def _buckets(w: Words) -> np.ndarray:
    """Embedding rows of each word: one for the word, one for each beginning."""
    out, base = [], 0
    for rows, h in zip(ROWS, (w.hash, *(w.head(n) for n in HEADS)), strict=True):
        out.append((h >> np.uint64(20)).astype(np.int64) % rows + base)
        base += rows
    return np.stack(out, 1)


@dataclass
class Model:
    embed: np.ndarray
    filters: list[np.ndarray]  # of each width: (width, DIM, FILTERS)
    bias: np.ndarray
    head: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    default: float = 0.3

    def tables(self) -> np.ndarray:
        """What each embedding row adds to every (width, place) response: one gather a word replaces all products."""
        return np.concatenate([self.embed @ f[k] for f in self.filters for k in range(len(f))], 1).astype(np.float32)

    def logits(self, w: Words, tables: np.ndarray) -> np.ndarray:
        pooled = np.zeros((w.n_docs, FILTERS * len(WIDTHS)), np.float32)
        if len(w.hash):
            rows = _buckets(w)
            got = tables[rows[:, 0]]
            for j in range(1, rows.shape[1]):
                got += tables[rows[:, j]]
            held = np.flatnonzero(np.bincount(w.doc, minlength=w.n_docs))
            first = np.searchsorted(w.doc, held)
            col = 0
            for i, width in enumerate(WIDTHS):
                out = got[:, col : col + FILTERS].copy()
                for k in range(1, width):
                    same = w.doc[k:] == w.doc[:-k]
                    out[:-k][same] += got[k:, col + k * FILTERS : col + (k + 1) * FILTERS][same]
                col += width * FILTERS
                pooled[held, i * FILTERS : (i + 1) * FILTERS] = np.maximum.reduceat(out, first, axis=0)
        pooled = np.maximum(pooled + self.bias, 0)
        return pooled @ self.head + self.offset

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits.astype(np.float64) + self.shift, -40, 40)))


def _log_odds(rows: np.ndarray, cut: np.ndarray, docs: np.ndarray, y: np.ndarray, alpha: float = 2.0) -> np.ndarray:
    """Of each embedding row: log-odds of the label in documents that have it, with alpha pseudo-documents of the mean."""
    n = np.zeros((2, sum(ROWS)))
    for d in docs:
        n[int(y[d]), np.unique(rows[cut[d] : cut[d + 1]])] += 1
    share = np.clip(y[docs].mean() if len(docs) else 0.5, 0.02, 0.98)
    return np.log((n[1] + alpha * share) / (n[0] + alpha * (1 - share)) * ((1 - share) / share)).astype(np.float32)


def fit(rows: np.ndarray, cut: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.03, seed: int = 3) -> Model:
    """Adagrad on the log-loss; gradients flow through each filter's largest response only, so steps are sparse.

    rows: embedding rows of all words of all texts; cut: where each text begins, and the end; y: the texts' labels."""
    rng = np.random.default_rng(seed)
    width = FILTERS * len(WIDTHS)
    m = Model(rng.normal(0, 0.02, (sum(ROWS), DIM)).astype(np.float32), [rng.normal(0, 0.1, (n, DIM, FILTERS)) for n in WIDTHS], -rng.uniform(0.2, 2.0, width), rng.normal(0, 0.3, width), 0.0)
    for f in m.filters:
        f[:, 0] = rng.uniform(0.1, 0.6, f[:, 0].shape)
    if not 0 < y.sum() < len(y):
        m.head[:], m.offset = 0, 6.0 if len(y) and y.all() else -6.0
        m.embed[:], m.filters = 0, [f.astype(np.float32) for f in m.filters]
        return m
    seen = np.zeros(len(m.embed), bool)
    seen[rows] = True
    m.embed[~seen] = 0
    half = rng.permutation(len(y))
    m.embed[:, 0] = _log_odds(rows, cut, half[: len(half) // 2], y)
    trained = half[len(half) // 2 :]
    g2 = {"e": np.full(m.embed.shape, 1e-4, np.float32), "h": np.full(m.head.shape, 1e-2), "b": np.full(m.bias.shape, 1e-2), "o": 1e-2, **{i: np.full(f.shape, 1e-2) for i, f in enumerate(m.filters)}}
    for _ in range(epochs):
        order = rng.permutation(trained)
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            pooled, where = np.zeros((len(docs), len(m.bias))), np.full((len(docs), len(m.bias)), -1)
            for r, d in enumerate(docs):
                a, b = cut[d], cut[d + 1]
                if a == b:
                    continue
                e = m.embed[rows[a:b]].sum(1)
                for i, f in enumerate(m.filters):
                    out = e @ f[0]
                    for k in range(1, min(len(f), len(e))):
                        out[:-k] += e[k:] @ f[k]
                    top = out.argmax(0)
                    s = slice(i * FILTERS, (i + 1) * FILTERS)
                    pooled[r, s], where[r, s] = out[top, np.arange(FILTERS)], a + top
            active = np.maximum(pooled + m.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ m.head + m.offset, -40, 40)))
            err = (p - y[docs]) / len(docs)
            back = np.outer(err, m.head) * (pooled + m.bias > 0)
            steps = {"h": active.T @ err + 1e-4 * m.head, "b": back.sum(0), "o": err.sum()}
            at_rows, at_grads = [], []
            for i, f in enumerate(m.filters):
                grad = np.zeros_like(f)
                for c in range(FILTERS):
                    col = i * FILTERS + c
                    for r in np.flatnonzero((back[:, col] != 0) & (where[:, col] >= 0)):
                        for k in range(len(f)):
                            pos = where[r, col] + k
                            if pos < cut[docs[r] + 1]:
                                grad[k, :, c] += back[r, col] * m.embed[rows[pos]].sum(0)
                                at_rows.append(rows[pos])
                                at_grads.append(back[r, col] * f[k, :, c])
                steps[i] = grad
            for name, value in (("h", m.head), ("b", m.bias), *enumerate(m.filters)):
                g2[name] += steps[name] ** 2
                value -= rate * steps[name] / np.sqrt(g2[name])
            g2["o"] += steps["o"] ** 2
            m.offset -= rate * steps["o"] / np.sqrt(g2["o"])
            if at_rows:
                idx = np.concatenate(at_rows)
                uniq, inv = np.unique(idx, return_inverse=True)
                grad = np.zeros((len(uniq), DIM))
                np.add.at(grad, inv, np.repeat(np.array(at_grads), rows.shape[1], axis=0))
                grad[:, 0] = 0
                g2["e"][uniq] += grad**2
                m.embed[uniq] -= rate * grad / np.sqrt(g2["e"][uniq])
    m.embed[:, 0] = _log_odds(rows, cut, half, y)
    m.filters = [f.astype(np.float32) for f in m.filters]
    return m


def calibrate(m: Model, scored: DataFrame, at: float = 0.3, few: int = 20) -> None:
    """Fits the scores' scale and shift, then each language's threshold: the middle of the widest range of scores with the
    fewest errors. Languages with under few examples of either label use the threshold over all.

    scored: lang, toxic (0 or 1) and logit of any number of labelled rows. They are counted in Spark by language, bin of
    the logit and label; only cells of a histogram of fixed size reach the driver, for all rows and for each language with
    enough examples. The scale and shift take a bin's rows at its middle; thresholds know a bin's least and largest logit."""
    cell = F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.col("logit"))) * BINS).cast("int")
    cells = scored.groupBy("lang", cell.alias("bin"), "toxic").agg(F.count("*").alias("n"), F.min("logit").alias("lo"), F.max("logit").alias("hi"))
    cells = cells.persist()
    merged = (F.sum(F.col("n") * F.col("toxic")).alias("bad"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("good"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    total = cells.groupBy("bin").agg(*merged).orderBy("bin").toPandas()
    enough = cells.where("lang is not null").groupBy("lang").agg(*merged[:2]).where((F.col("bad") >= few) & (F.col("good") >= few)).select("lang")
    langs = cells.join(enough, "lang", "left_semi").groupBy("lang", "bin").agg(*merged).orderBy("lang", "bin").toPandas()
    cells.unpersist()
    if not len(total):
        return
    z = (total["bin"].to_numpy() + 0.5) / BINS
    bad, good = total["bad"].to_numpy(np.float64), total["good"].to_numpy(np.float64)
    pos, n = bad.sum(), bad + good
    wanted = bad * (pos + 1) / (pos + 2) + good / (good.sum() + 2)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        v, over = n * np.maximum(p * (1 - p), 1e-9), n * p - wanted
        g = np.array([(over * z).sum() + 1e-3 * (a - 1), over.sum()])
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1, 2 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    m.scale, m.shift = max(float(a), 1e-3), float(b)

    def best(rows):
        wrong = np.concatenate([[0], np.cumsum(rows["bad"])]) + np.concatenate([np.cumsum(rows["good"][::-1])[::-1], [0]])
        low = np.concatenate([[0.0], m.score(rows["hi"].to_numpy())])
        high = np.concatenate([m.score(rows["lo"].to_numpy()), [1.0]])
        ok = np.flatnonzero(wrong == wrong.min())
        i = ok[np.argmax((high - low)[ok])]
        return float((low[i] + high[i]) / 2)

    m.default = best(total) if 0 < pos < n.sum() else at
    m.thresholds = {lang: best(rows) for lang, rows in langs.groupby("lang")}


def fold() -> F.Column:
    """crc32 of the doc_id as text, modulo 4; labels of remainder 2 are held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, sample_bytes: int = 24 << 20, seed: int = 3) -> Model:
    """A model from at most sample labelled rows to train on (half of them toxic where there are as many) of at most
    sample_bytes of text together, in the order of a hash, calibrated on all labelled rows of another fifth.

    Only embedding rows of the sample's words reach the driver, no texts. Rows with null doc_id or label are left out; of
    labels, and of the sample's texts, that share a doc_id the largest counts. Without labels or with labels of one kind,
    scores are all alike: low, unless all labels are toxic."""
    turn = F.xxhash64("doc_id", F.lit(seed))
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(fold() != 2)
    known = known.withColumn("turn", turn).withColumn("held", F.pmod("turn", F.lit(5)) == 0)
    part = [known.where(f"not held and toxic = {k}").orderBy("turn", "doc_id").limit(sample // 2) for k in (1, 0)]
    known_docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    with Scratch(docs) as scratch:
        # at most sample ids: a fixed bound
        picked = known_docs.select("doc_id", "text").join(F.broadcast(part[0].unionByName(part[1])), "doc_id").groupBy("turn", "doc_id", "toxic").agg(F.max("text").alias("text"))
        picked = scratch.hold(picked)
        sizes = picked.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), "turn").orderBy("turn", "doc_id").toPandas()
        chosen, left = [], sample_bytes
        for i, n in zip(sizes["doc_id"], sizes["n"], strict=True):
            if n <= left:
                chosen.append((int(i),))
                left -= n
        chosen = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long"))

        def read(batches):
            for piece, data, off in slices(batches, limit=SLICE):
                w = words(data, off, lower=True, alnum=True)
                rows, cut = _buckets(w).astype(np.int32), w.bounds()
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], pa.array([rows[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["turn", "doc_id", "toxic", "rows"])

        got = short_batches(picked.join(chosen, "doc_id").select("turn", "doc_id", "toxic", "text")).mapInArrow(read, "turn long, doc_id long, toxic int, rows binary").orderBy("turn", "doc_id").toPandas()
    y = got["toxic"].to_numpy(np.float64)
    rows = np.frombuffer(b"".join(got["rows"]), np.int32).reshape(-1, len(ROWS))
    m = fit(rows, np.concatenate([[0], np.cumsum([len(r) // (4 * len(ROWS)) for r in got["rows"]])]).astype(np.int64), y, seed=seed)
    del got, rows
    if 0 < y.sum() < len(y):
        # scored before they meet their labels, so that no text is shuffled
        held = known_docs.where((fold() != 2) & (F.pmod(turn, F.lit(5)) == 0))
        scored = _logits(held, m, "logit").select("doc_id", "lang", "logit")
        calibrate(m, scored.join(known.where("held").select("doc_id", "toxic"), "doc_id"))
    return m


def _logits(docs: DataFrame, model: Model, name: str, score: bool = False) -> DataFrame:
    """docs with each text's logit, or calibrated score, as a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def apply(batches):
        m = shared.value
        tables = m.tables()
        for piece, data, off in slices(batches, limit=SLICE):
            z = m.logits(words(data, off, lower=True, alnum=True), tables)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(m.score(z) if score else z.astype(np.float64))], [*names, name])

    # texts with a third of all words in one row are one task's work, but one row's only
    return short_batches(docs).mapInArrow(apply, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, and toxicity_score (0 to 1), toxicity_threshold (of the row's lang) and toxic_rejected.

    The score depends on the whole text alone. Null and empty texts are scored as texts without words; a very long text is
    one piece of its task's work. Rows that share a doc_id are returned one by one. A docs table with columns of the new
    names is an error; an empty table gives an empty result.
    """
    clash = {"toxicity_score", "toxicity_threshold", "toxic_rejected"} & set(docs.columns)
    if clash:
        raise ValueError(f"docs has columns {sorted(clash)} already")
    scored = _logits(docs, model, "toxicity_score", score=True)
    limit = F.lit(float(model.default))
    for lang, t in sorted(model.thresholds.items()):
        limit = F.when(F.col("lang") == lang, F.lit(t)).otherwise(limit)
    return scored.withColumn("toxicity_threshold", limit).withColumn("toxic_rejected", F.col("toxicity_score") >= F.col("toxicity_threshold"))
