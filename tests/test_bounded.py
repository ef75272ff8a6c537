"""Work that follows distinct rows and keys, against the pairs of rows that it stands for."""

import random
import re

import pytest

from kindred.functions import fuzzy
from kindred.operators import dedup, linking, search, vectors
from kindred.plans.fixtures import load
from kindred.plans.queries import QUERIES
from kindred.sources import ingest

REPORT = "id string, kind string, full_name string, age int, last_seen_location string, distinguishing_marks string, source string, created_at long"


@pytest.fixture(scope="module")
def reports(spark):
    names = ["Ana Paz", "Ana Pérez", "ANA Pérez", "Luis Gil", "Ana", None]
    rows = [(f"r{i}", "found" if i % 5 == 0 else "missing", names[i % 6], None if i % 7 == 0 else 20 + i % 3, ["Petare", None, "Catia"][i % 3], "x", "hospital_1" if i % 4 == 0 else "web", i % 11) for i in range(120)]
    return spark.createDataFrame(rows, REPORT)


def test_search_person_scores_what_is_alike_once(spark, reports, monkeypatch):
    q = spark.createDataFrame([(i, "Ana Paz" if i % 2 else "ana pérez", None if i % 3 == 0 else 22, "Petare" if i % 2 else None) for i in range(12)], "query_id long, name string, age int, location string")
    scored, collapse = [], search.collapse_results
    monkeypatch.setattr(search, "collapse_results", lambda df, *more: scored.append(df) or collapse(df, *more))
    got = sorted(map(tuple, search.search_person(q, reports).collect()))
    alone = sorted(tuple(x) for i in range(4) for x in search.search_person(q.where(f"query_id = {i}"), reports).collect())
    assert got and [x for x in got if x[0] < 4] == alone
    # queries of four kinds; reports of a name, age and place once
    assert scored[0].count() <= 4 * reports.select("full_name", "age", "last_seen_location").distinct().count() < 12 * reports.where("full_name like 'A%'").count()


def test_name_classes_and_pairs_are_all_block_pairs(reports):
    rep = {x.id: x.anchor for x in dedup.name_classes(reports).collect()}
    met = {(x.a, x.b) for x in dedup.name_pairs(reports).collect()}
    want = {(x.a, x.b) for x in dedup.block_pairs(reports).collect()}
    assert want == {(a, b) for a in rep for b in rep if a < b and (rep[a], rep[b]) in met}
    assert len(met) < len(want) / 4
    assert {(x.a_name, x.b_name) for x in dedup.block_pairs(reports).collect()} == {(x.a_name, x.b_name) for x in dedup.name_pairs(reports).collect()}


def test_bucket_caps_by_a_shared_key_are_each_querys(spark, reports):
    r = reports.selectExpr("*", "substring(id, 2, 1) lead", "if(kind = 'found', 0, 1) bucket")
    q = spark.createDataFrame([(i, str(i % 9 + 1)) for i in range(30)], "query_id long, lead string")
    order = r["created_at"].desc(), r["id"]
    want = search.bucket_caps(q.join(r, "lead"), (2, 3), *order).select("query_id", "id", "rank")
    best = search.bucket_caps(r, (2, 3), *order, by="lead")
    assert sorted(q.join(best, "lead").select("query_id", "id", "rank").collect()) == sorted(want.collect())
    # tasks keep a key's first rows before the shuffle
    assert best._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


def test_block_links_are_all_block_pairs(reports):
    rows = dedup.block_links(reports).collect()
    want = {(x.a, x.b) for x in dedup.block_pairs(reports).collect()}
    assert want == {(x.id, y.id) for x in rows for y in rows if x.block == y.block and x.id < y.id}
    assert sum(x.n_links for x in rows) == 2 * len(want)


@pytest.mark.parametrize("meet", [1, 7, 4096])
def test_block_pairs_are_all_pairs_in_tiles(spark, reports, monkeypatch, meet):
    monkeypatch.setattr(dedup, "MEET", meet)
    odd = [("r3", "missing", "Luis Otro", 1, "Petare", "x", "web", 1), (None, "missing", "Luis Gil", 1, "Petare", "x", "web", 1), ("z", None, "Luis Gil", 1, "Petare", "x", "web", 1)]
    r = reports.union(spark.createDataFrame(odd, REPORT))
    rows = [x for x in dedup.blocks(r).collect() if x.id and x.kind]
    key = lambda x: (x.kind, x._first, x._place)
    want = [(x.id, y.id, x.full_name, y.full_name) for x in rows for y in rows if key(x) == key(y) and x.id < y.id]
    pairs = dedup.block_pairs(r)
    assert sorted(map(tuple, pairs.collect())) == sorted(want) and len(want) > 400
    # a tile of a block meets one other in a group of the join, and no side is gathered
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert re.findall(r"(\w+Join) \[[^]]*\bp#[^]]*\bq#", plan) == ["SortMergeJoin"]


def test_block_pairs_query_returns_every_pair(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["jn10_block_pairs"](spark, sf).collect()
    links = dedup.block_links(load(spark, sf, "reports")).collect()
    assert {(x.a, x.b) for x in got} == {(x.id, y.id) for x in links for y in links if x.block == y.block and x.id < y.id}
    assert 2 * len(got) == sum(x.n_links for x in links)


def test_incremental_links_of_both_directions_are_one(spark, monkeypatch):
    # a matrix product and its transpose differ in last places
    scores = iter([0.9, 0.9000000000000001])
    near = lambda q, i, *more: spark.createDataFrame([("m1", "f1", next(scores))] if not more_seen.append(1) and len(more_seen) == 1 else [("f1", "m1", next(scores))], "query_id string, item_id string, score double")
    more_seen: list = []
    monkeypatch.setattr(linking, "knn_join", near)
    r = spark.createDataFrame([("m1", "missing", "Ana", 1, "x", [1.0]), ("f1", "found", "Ana", 1, "x", [1.0])], "id string, kind string, full_name string, age int, distinguishing_marks string, text_embedding array<double>")
    assert [(x.missing_id, x.found_id, x.text_score) for x in linking.incremental_link(r, r).collect()] == [("m1", "f1", 0.9000000000000001)]


def test_neighbours_equal_to_nine_places_go_by_id(spark):
    # from the last id on, each item is a little less alike than the next, by less than counts
    items = spark.createDataFrame([(f"i{99 - i}", [1.0, 1e-6 * i]) for i in range(30)], "item_id string, vector array<double>")
    got = vectors.knn_join(spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>"), items, 3)
    assert sorted(x.item_id for x in got.collect()) == ["i70", "i71", "i72"]


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    met, pairs = [], vectors._block_pairs
    monkeypatch.setattr(vectors, "_block_pairs", lambda *args: met.append(pairs(*args)) or met[-1])
    v = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0]]
    q = spark.createDataFrame([(f"q{i}", v[i % 3]) for i in range(30)], "query_id string, vector array<double>")
    items = spark.createDataFrame([(f"i{i:02}", v[i % 2]) for i in range(40)] + [("n", None)], "item_id string, vector array<double>")
    got = {}
    for x in vectors.knn_join(q, items, 25, 0.5).collect():
        got.setdefault(x.query_id, []).append(x.item_id)
    near, far = [f"i{i:02}" for i in range(0, 40, 2)], [f"i{i:02}" for i in range(1, 40, 2)]
    assert got == {f"q{i}": got[f"q{i}"] for i in range(30) if i % 3 < 2}
    assert all(sorted(ids) == sorted((near + far[:5]) if int(q[1:]) % 3 == 0 else (far + near[:5])) for q, ids in got.items())
    assert met[0].count() == 3 + 2


def test_large_sides_are_few_blocks(spark):
    df = spark.range(40_000).selectExpr("id query_id", "transform(sequence(1, 64), x -> cast(id % 7 + x as float)) vector")
    # each vector is sent to eight blocks, not to nineteen, as floats
    assert vectors._blocks(df) == 8
    sent = vectors._block_pairs(df, df.withColumnRenamed("query_id", "item_id"), None)
    assert sent.schema["vector"].dataType.simpleString() == "array<float>"


def test_deref_keeps_arrays_in_their_rows(spark):
    flat = '["a","b",{"_0":4,"_1":-1},{"_1":5,"_7":0,"_0":true},"x","y"]'
    got = ingest.deref_array(spark.createDataFrame([(1, flat), (2, None), (3, "[]"), (4, '["a",{"_5":0}]')], "doc long, flat string"), "doc", "flat", ("a", "b"))
    assert sorted(map(tuple, got.collect())) == [(1, 2, "x", None), (1, 3, "true", "y")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("most", [2, 5, 8, 12])
def test_hash_pairs_come_out_once_of_keys_that_few_share(spark, most):
    rng = random.Random(most)
    hashes = [rng.getrandbits(64) for _ in range(20)]
    hashes += [h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 13))) for h in hashes for _ in range(6)]
    got = vectors.phash_pairs(spark.createDataFrame([(i, f"{h:016x}") for i, h in enumerate(hashes)], "id long, phash string"), most)
    want = [(a, b, (hashes[a] ^ hashes[b]).bit_count()) for a in range(len(hashes)) for b in range(a + 1, len(hashes)) if (hashes[a] ^ hashes[b]).bit_count() <= most]
    assert sorted(map(tuple, got.collect())) == want
    # no table of pairs is made distinct
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") <= 2


def test_hash_keys_are_not_gathered_for_a_broadcast(spark, tmp_path):
    spark.range(3000).selectExpr("id", "substring(md5(cast(id div 3 as string)), 1, 15) || substring('0123456789abcdef', int(id % 16) + 1, 1) phash").write.parquet(f"{tmp_path}/photos")
    got = vectors.phash_pairs(spark.read.parquet(f"{tmp_path}/photos"))
    assert len(got.collect()) >= 3000
    # the hashes' size at run time would allow it
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert re.findall(r"(\w+Join) \[[^]]*\bkey#", plan) == ["SortMergeJoin"]


def test_gestalt_compares_in_full_only_what_can_win(monkeypatch):
    plain, full = fuzzy.difflib.SequenceMatcher, []
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcde ", k=rng.randint(0, 12))) for _ in range(80)]

    def all_compared(text, options, threshold):
        best, found = 0.0, None
        for o in options:
            if o and text:
                score = 1.0 if f" {o} " in f" {text} " else max(plain(None, text, o).ratio(), 0.8 if o in text else 0.0)
                if score > best:
                    best, found = score, o
        return found if best >= threshold else None

    class Counted(plain):
        def ratio(self):
            full.append(1)
            return super().ratio()

    monkeypatch.setattr(fuzzy.difflib, "SequenceMatcher", Counted)
    options = texts[:6]
    assert [fuzzy.closest(t, options, 0.6) for t in texts] == [all_compared(t, options, 0.6) for t in texts]
    assert len(full) < len(texts) * len(options) / 3


def test_greedy_collapse_reads_queries_one_after_the_other(spark):
    names = ["Ana Paz", "Ana Gil", "Luis Paz", "Eva Sol", None, ""]
    rows = [(q, f"r{i}", names[(q + i) % 6], ["A", None][i % 2], (i * 7 % 5) / 10) for q in range(40) for i in range(12)]
    ranked = spark.createDataFrame([*rows, (None, "r", "Ana Paz", "A", 0.5)], "query_id long, id string, full_name string, place string, score double")
    want = {(None, "r")}
    for q in range(40):
        seen, kept = set(), []
        for _, i, name, place, _ in sorted((x for x in rows if x[0] == q), key=lambda x: (-x[4], x[1])):
            words = (name or "").lower().split() or [""]
            keys = {(w, place or "") for w in (words[0], words[-1])}
            if not keys & seen and len(kept) < 3:
                seen |= keys
                kept.append((q, i))
        want |= set(kept)
    got = search.collapse_greedy(ranked)
    assert {(x.query_id, x.id) for x in got.collect()} == want
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
