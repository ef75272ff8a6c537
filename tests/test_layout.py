"""Stored layouts: the same rows, without an exchange of what is stored."""

import re

import pytest
from pyspark.sql import functions as F

from kindred.functions import text
from kindred.operators import dedup, linking, review, search
from kindred.operators.layout import NameIndex, ReportStore
from kindred.plans import fixtures

SF = "/root/testdata/sf0.001"


@pytest.fixture
def unsent(spark):
    """Without broadcasts of small tables, which would hide exchanges."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def shuffles(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)", df._jdf.queryExecution().executedPlan().toString())


def test_stored_reports_are_not_dealt_out(unsent, tmp_path):
    reports, matches, photos = (fixtures.load(unsent, SF, n) for n in ("reports", "matches", "photos"))
    store = ReportStore(unsent, f"file://{tmp_path}/s", 4)
    r, ids = store.write_reports(reports), store.write_identifiers(reports)
    m, p = store.write_matches(matches, "missing_id"), store.write_photos(photos)
    assert {(x.id, x.cedula, x.loc_canon) for x in r.collect()} == {tuple(x) for x in reports.select("id", text.extract_id(F.col("distinguishing_marks")), text.normalize_location(F.col("last_seen_location"))).collect()}

    got, want = review.enriched(m, r), review.enriched(matches, reports)
    assert sorted(map(str, got.select("id", "missing_full_name", "found_source").collect())) == sorted(map(str, want.select("id", "missing_full_name", "found_source").collect()))
    # matches go on to their other side, reports stay
    assert len(shuffles(got)) == 1 and len(shuffles(want)) == 4
    got, want = linking.good_photos(p, r), linking.good_photos(photos, reports)
    assert shuffles(got) == [] and got.count() == want.count() and len(shuffles(want)) == 2
    got, want = dedup.dedup_by_id(ids), dedup.dedup_by_id(reports)
    assert shuffles(got) == [] and set(map(tuple, got.collect())) == set(map(tuple, want.collect()))
    got, want = linking.link_by_id(ids), linking.link_by_id(reports)
    # the one exchange that is left is of the links
    (left,) = shuffles(got)
    assert "missing_id" in left and len(shuffles(want)) == 3
    assert set(map(str, got.collect())) == set(map(str, want.collect()))


def test_kept_index_of_names(unsent, tmp_path):
    reports = fixtures.load(unsent, SF, "reports")
    names = reports.select("id", text.deaccent(F.col("full_name")).alias("name"))
    index = NameIndex(unsent, f"file://{tmp_path}/n", 4)
    index.add(names.where("id like 'm%'").union(unsent.createDataFrame([("z", None), ("y", "o")], "id string, name string")))
    index.add(names)
    index.add(names)
    every = {r.name for r in names.collect()} | {"o"}
    assert {r.name for r in index.names().collect()} == every and index.names().count() == len(every)
    parts = ["a", "jo", "jose", "gonz", "e g", "zzz", "o", ""]
    df = index.containing(unsent.createDataFrame([(p,) for p in parts], "part string"))
    assert {tuple(r) for r in df.collect()} == {(p, n) for p in parts if p for n in every if p in n}
    q = unsent.createDataFrame([(1, "gonz"), (2, "lez jose"), (3, "a"), (4, "V-10000003")], "query_id long, q string")
    assert set(map(tuple, search.admin_search(reports, q, index=index).collect())) == set(map(tuple, search.admin_search(reports, q).collect()))
    # of the index itself nothing is dealt out: exchanges are of parts
    assert all(not re.search(r"gram#\d+, name", x) for x in shuffles(df))


def test_nearest_of_each_partition(spark):
    from kindred.functions import sql

    sql.register(spark)
    items = spark.createDataFrame([(i, i % 3, [1.0, i / 10]) for i in range(30)] + [(90, 0, None), (91, 0, [0.0, 0.0]), (92, 1, [1.0]), (93, 2, [float("nan"), 1.0]), (94, 2, [None, 1.0]), (95, 1, [1.0, 0.1])], "id long, part int, vector array<double>")
    got = spark.sql("SELECT id FROM nearest(TABLE(SELECT id, vector, part FROM {items}) PARTITION BY (part), array(1.0D, 0.0D), 0.5D, 2)", items=items).collect()
    assert sorted(r.id for r in got) == sorted(["0", "3", "1", "95", "2", "5"])
