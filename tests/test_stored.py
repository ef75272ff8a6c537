"""Stored tables, kept cursors, observed runs and sketches, with runs that fail and are tried again."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import sessions, upsert
from kindred.operators.stored import Cursor, Files, StoredTable

ROW = "k string, part int, v string, t long"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def table(spark, folder, buckets=4):
    return StoredTable(spark, f"file://{folder}/t", frame(spark, []).schema, ("k", "part"), buckets)


def held(t):
    return {(r.k, r.part): (r.v, r.t) for r in t.read().collect()}


def test_batches_equal_a_dictionary_and_can_be_tried_again(spark, tmp_path):
    rng = random.Random(1)
    t, want = table(spark, tmp_path), {}
    for number in range(4):
        rows = [(f"k{rng.randrange(12)}", rng.randrange(2), f"v{number}-{i}", rng.randrange(30)) for i in range(15)] + [(None, 1, "x", 1), ("k1", None, "x", 1)]
        latest = {}
        for k, part, v, time in rows:
            if k is not None and part is not None and time >= latest.get((k, part), (None, -1))[1]:
                latest[k, part] = (v, time)
        # of rows of one time any counts: keep times apart
        times = [(r[0], r[1], r[3]) for r in rows]
        rows = [r for i, r in enumerate(rows) if times.index((r[0], r[1], r[3])) == i]
        latest = {}
        for k, part, v, time in rows:
            if k is not None and part is not None and time > latest.get((k, part), (None, -1))[1]:
                latest[k, part] = (v, time)
        before = dict(want)
        for key, (v, time) in latest.items():
            if key not in want or time >= want[key][1]:
                want[key] = (v, time)
        t.merge(frame(spark, rows), number, order=("t",))
        assert held(t) == want
        # the batch once more, and after a failure that left its files without a manifest
        t.merge(frame(spark, rows), number, order=("t",))
        assert held(t) == want
        Files(spark, f"{t.path}/manifests").delete(str(number))
        assert held(t) == before
        t.merge(frame(spark, rows), number, order=("t",))
        assert held(t) == want


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    t = table(spark, tmp_path, 8)
    t.merge(frame(spark, [(f"k{i}", 0, "a", 0) for i in range(40)]), 0)
    t.merge(frame(spark, [("k3", 0, "b", 0)]), 1)
    versions = json.loads(Files(spark, f"{t.path}/manifests").read("1"))
    assert sorted(versions.values()) == [0] * 7 + [1]
    assert held(t)["k3", 0] == ("b", 0) and len(held(t)) == 40


def test_other_modes_and_columns(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0
    t.merge(frame(spark, []), 0)
    t.merge(frame(spark, [("a", 0, "x", 1)]), 1)
    t.merge(frame(spark, [("a", 0, "y", 2), ("b", 0, "z", 2)]), 2, "ignore")
    assert held(t) == {("a", 0): ("x", 1), ("b", 0): ("z", 2)}
    # a batch without a column leaves it, columns that the table lacks are ignored
    t.merge(spark.createDataFrame([("a", 0, "n", 5), ("c", 0, "m", 5)], "k string, part int, v string, more int"), 3)
    assert held(t) == {("a", 0): ("n", 1), ("b", 0): ("z", 2), ("c", 0): ("m", None)}
    t.forget(keep=2)
    assert held(t) == {("a", 0): ("n", 1), ("b", 0): ("z", 2), ("c", 0): ("m", None)}
    t.merge(frame(spark, [("d", 0, "w", 1)]), 4)
    assert len(held(t)) == 4


def test_cursor_reads_each_row_once_though_runs_fail(spark, tmp_path):
    # rows of one time are cut apart by the limit, and rows without time or key are left out
    df = spark.createDataFrame([(f"r{i:02}", i // 5) for i in range(23)] + [("x", None), (None, 3)], "id string, created_at long")
    seen, calls = [], []

    def work(rows):
        calls.append(1)
        got = sorted(r.id for r in rows.collect())
        if len(calls) % 3 == 2:
            raise InterruptedError
        seen.extend(got)

    left = 30
    while left:
        try:
            if not Cursor(spark, f"file://{tmp_path}/c").run(df, work, limit=4):
                break
        except InterruptedError:
            pass
        left -= 1
    assert seen == [f"r{i:02}" for i in range(23)]
    # what comes later is after the cursor, and only that moves it
    more = df.unionByName(spark.createDataFrame([("z1", 9), ("z2", 9), ("z3", 10)], "id string, created_at long"))
    got = []
    assert Cursor(spark, f"file://{tmp_path}/c").run(more, lambda rows: got.extend(r.id for r in rows.collect()), limit=1, n_recent=2) == 1
    assert sorted(got) == ["z1", "z2", "z3"] and Cursor(spark, f"file://{tmp_path}/c").value() == {"ts": "9", "key": "z1"}


def test_observed_runs(spark, tmp_path):
    old = spark.createDataFrame([("s", "1", "Ana"), ("s", "2", "Eva")], "source string, source_url string, name string")
    new = spark.createDataFrame([("s", "1", "Bea"), ("s", "3", "Leo"), ("s", "3", "Lea"), ("s", None, "Nil"), ("s", "4", "???"), ("s", "5", None)], "source string, source_url string, name string")
    noise = F.col("name") == "???"
    row = upsert.observed_upsert(old, new, lambda df: df.write.parquet(f"file://{tmp_path}/a"), "s", "full", noise=noise)
    assert row == {"checked": 6, "noise": 1, "errors": 2, "inserted": 2, "updated": 1, "source": "s", "run_type": "full", "error": None}
    assert {r.source_url for r in spark.read.parquet(f"file://{tmp_path}/a").collect()} == {"1", "2", "3", "5"}

    def broken(df):
        raise ValueError("no\nspace")

    row = upsert.observed_upsert(old, new, broken, "s", "full")
    assert row["error"] == "ValueError: no" and row["checked"] is None


def test_payloads_of_all_forms_and_sketches_over_days(spark):
    rng = np.random.default_rng(2)
    rows = [("intent_detected", day, json.dumps({"intent": "a", "confidence": float(c), "node_key": "n", "latency_ms": int(1000 * c)})) for day, values in enumerate(rng.random((5, 400))) for c in values]
    rows += [("intent_detected", 0, json.dumps({"intent": "none", "confidence": 0.0, "node_key": None})), ("decision_made", 0, json.dumps({"current_node": "x", "target_node": "y", "metodo": "m", "intent_confidence": 0.5, "similarity_confidence": 0.25})), ("response_generated", 1, json.dumps({"node_key": "z", "metodo": "m", "response_length": 7})), ("response_generated", 1, "{broken"), ("response_generated", 1, None)]
    e = sessions.event_payloads(spark.createDataFrame(rows, "event_type string, d int, data string"))
    (d,) = e.where("event_type = 'decision_made'").select("node", "method", "confidence", "similarity").collect()
    assert tuple(d) == ("y", "m", 0.5, 0.25)
    got = {(r.event_type, r.node): r for r in sessions.merged_sketches(sessions.event_sketches(e, F.col("d"))).collect()}
    assert set(got) == {("intent_detected", "n"), ("intent_detected", None), ("decision_made", "y"), ("response_generated", "z"), ("response_generated", None)}
    a = got["intent_detected", "n"]
    values = np.sort([json.loads(r[2])["confidence"] for r in rows[:2000]])
    assert a.n == a.n_intents == 2000 and a.avg_confidence == pytest.approx(values.mean())
    for q, v in ((0.5, a.confidence_p50), (0.95, a.confidence_p95)):
        assert abs(np.searchsorted(values, v) / 2000 - q) < 0.02
    none = got["intent_detected", None]
    assert (none.n, none.n_intents, none.avg_confidence, none.confidence_p50) == (1, 0, None, None) and got["response_generated", None].n == 2
