"""Small hand-written tables for the rules that SQL over the driver's tables does not reach."""

import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import dedup, linking, notify, review, sessions, upsert, vectors

REPORT = "id string, kind string, full_name string, age int, last_seen_location string, distinguishing_marks string, source string, source_url string, photo_url string, created_at long"


def reports(spark, *rows):
    return spark.createDataFrame([(i, k, n, a, p, m, s, f"u:{i}", None, t) for i, k, n, a, p, m, s, t in rows], REPORT)


def test_one_canonical_and_two_pointers(spark):
    r = reports(spark, ("a", "missing", "Jose Perez", 30, "Ccs", "CI: 1234567", "x", 3), ("b", "missing", "José Peres", None, None, "CI: 1234567", "y", 1), ("c", "missing", "J Perez", 30, "Ccs", "ci 1234567", "z", 2), ("d", "found", "Jose Perez", 30, "Ccs", "CI: 1234567", "h", 1))
    assert {tuple(x) for x in dedup.dedup_by_id(r).collect()} == {("b", "a"), ("c", "a")}
    links = linking.link_by_id(r).collect()
    assert {(x.missing_id, x.found_id, x.status) for x in links} == {("a", "d", "pending"), ("b", "d", "pending"), ("c", "d", "pending")}


def test_name_pass_is_greedy_in_order_of_ids(spark):
    # a ~ b and b ~ c, but a and c differ
    names = {"a": "ana maria perez lopez", "b": "ana maria perez lopez garcia ruiz", "c": "ana garcia ruiz"}
    r = reports(spark, *((i, "missing", n, None, "Ccs", None, "x", 1) for i, n in names.items()))
    got = {tuple(x) for x in dedup.dedup_by_name(r, 85.0).collect()}
    assert got == {("b", "a")} or got == {("b", "a"), ("c", "a")}


def test_greedy_clusters_in_rounds_equal_the_loop(spark, monkeypatch):
    """Random graphs, and a chain on which each node has the next as its only neighbour."""
    rng = random.Random(8)
    graphs = [{(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a < b} for n, m in ((12, 30), (40, 60), (60, 500))] + [{(i, i + 1) for i in range(13)}]
    rows = [("missing", f"g{g}", "", f"{g}-{a:03}", f"{g}-{b:03}") for g, pairs in enumerate(graphs) for a, b in pairs]
    want = {}
    for g, pairs in enumerate(graphs):
        for a in range(60):
            name = f"{g}-{a:03}"
            if name not in want:
                for b in sorted(b for x, b in pairs if x == a):
                    want.setdefault(f"{g}-{b:03}", name)
    edges = spark.createDataFrame(rows, "kind string, _first string, _place string, anchor string, other string")
    for small in (0, 40, 1 << 20):
        monkeypatch.setattr(dedup, "SMALL", small)
        assert {(x.anchor, x.cluster) for x in dedup.greedy_clusters(edges).collect()} == set(want.items())


@pytest.mark.parametrize("tile", [3, 512])
def test_name_pass_equals_greedy_loop(spark, monkeypatch, tile):
    from kindred.functions import fuzzy

    monkeypatch.setattr(dedup, "TILE", tile)
    rng = random.Random(4)
    parts = ["maria", "mariana", "perez", "peres", "gomez", "gomes", "luisa", "luis", "diaz"]
    rows = [(f"r{i:03}", "missing", "ana " + " ".join(rng.choices(parts, k=rng.randint(1, 3))), None, "Ccs", None, "x", i) for i in range(60)]
    left, cluster = sorted((r[0], r[2]) for r in rows), {}
    while left:
        head, name = left[0]
        taken = [x for x in left if x[0] == head or fuzzy.weighted_ratio(name, x[1]) >= 85.0]
        cluster.update({i: head for i, _ in taken})
        left = [x for x in left if x not in taken]
    groups = {}
    for i, head in cluster.items():
        groups.setdefault(head, set()).add(i)
    got = {}
    for r in dedup.dedup_by_name(reports(spark, *rows), 85.0).collect():
        got.setdefault(r.canonical, {r.canonical}).add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_dedup_leaves_one_survivor_and_is_idempotent(spark):
    r = reports(spark, ("a", "missing", "Ana Paz", None, None, "CI: 1234567", "x", 1), ("b", "missing", "Ana Paz", 30, "Ccs", "CI: 1234567 y mas", "x", 2), ("c", "missing", "Ana Paz", None, "Ccs", None, "x", 3))
    once = dedup.dedup(r)
    first = {(x.id, x.dup_of) for x in once.collect()}
    assert sum(d is None for _, d in first) == 1
    assert {(x.id, x.dup_of) for x in dedup.dedup(once).collect()} == first
    assert upsert.bad_pointers(once).count() == 0


def test_upsert_overwrites_given_columns_only(spark):
    old = spark.createDataFrame([("s", "1", "Ana", 3), ("s", "2", "Eva", 4)], "source string, source_url string, name string, age int")
    new = spark.createDataFrame([("s", "1", None), ("s", "3", "Leo")], "source string, source_url string, name string")
    assert {tuple(r) for r in upsert.upsert(old, new).collect()} == {("s", "1", None, 3), ("s", "2", "Eva", 4), ("s", "3", "Leo", None)}
    assert {tuple(r) for r in upsert.upsert(old, new, mode="ignore").collect()} == {("s", "1", "Ana", 3), ("s", "2", "Eva", 4), ("s", "3", "Leo", None)}


def _matches(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, missing_id string, found_id string, combined_score double, face_score double, status string, same_photo_suspected boolean, notify_sent boolean, family_ack string")


def test_review_queue_rules(spark):
    r = reports(spark, ("m1", "missing", "A", 1, "x", None, "s", 1), ("m2", "missing", "B", 1, "x", None, "s", 1), ("f1", "found", "C", 1, "x", None, "hospital_1", 1), ("f2", "found", "D", 1, "x", None, "s", 1), ("f3", "found", "E", 1, "x", None, "hospital_2", 1)).withColumn("dup_of", F.when(F.col("id") == "f3", "f1"))
    m = _matches(
        spark, (1, "m1", "f1", 0.95, 0.0, "pending", False, False, None), (2, "m1", "f2", 0.99, 0.0, "pending", False, False, None), (3, "m2", "f1", 0.5, 0.2, "pending", False, False, "yes"), (4, "m2", "f3", 0.99, 0.0, "pending", False, False, None), (5, "m2", "f1", 0.99, 0.9, "pending", True, False, None), (6, "m1", "f1", 0.91, 0.0, "pending", None, False, None)
    )
    assert [x.id for x in review.review_queue(m, r).collect()] == [3, 1]


def test_deciding_found_dismisses_pending_siblings(spark):
    r = reports(spark, *((i, k, i, 1, "x", None, "s", 1) for i, k in (("m1", "missing"), ("m2", "missing"), ("f1", "found"), ("f2", "found"))))
    m = _matches(spark, (1, "m1", "f1", 1.0, 0.0, "pending", False, False, None), (2, "m1", "f2", 1.0, 0.0, "pending", False, False, None), (3, "m1", "f2", 1.0, 0.0, "confirmed", False, False, None), (4, "m2", "f1", 1.0, 0.0, "pending", False, False, None))
    d = spark.createDataFrame([(1, "rejected", 1), (1, "found", 2), (9, "found", 3), (4, "nonsense", 4)], "match_id long, decision string, decided_at long")
    after, log = review.apply_reviews(m, r, d)
    assert {(x.id, x.status) for x in after.collect()} == {(1, "found"), (2, "dismissed"), (3, "confirmed"), (4, "pending")}
    assert [x.match_id for x in log.collect()] == [1]


@pytest.mark.parametrize("legacy", [False, True])
def test_notifications(spark, legacy):
    r = reports(spark, ("m1", "missing", "A", 1, "x", None, "s", 1), ("m2", "missing", "B", 1, None, None, "s", 1), ("f1", "found", "", 1, "", None, "h", 1), ("f2", "found", "D", 1, "x", None, "h", 1))
    m = _matches(spark, (1, "m1", "f2", 0.9, 0.0, "confirmed", False, False, None), (2, "m1", "f2", 0.8, 0.0, "confirmed", False, False, None), (3, "m2", "f1", 0.7, 0.0, "confirmed", False, False, None), (4, "m2", "f2", 0.6, 0.0, "pending", False, False, None), (5, "m2", "f2", 0.5, 0.0, "confirmed", False, False, None))
    s = spark.createDataFrame([("m1", "1", None), ("m2", "2", 900_000)], "report_id string, phone string, last_notified_at long")
    outbox, after, subs = notify.notifications(m, s, r, 950_000, legacy_cooldown=legacy)
    assert [(x.match_id, x.report_id, x.text) for x in outbox.collect()] == [(1, "m1", "D — x")]
    # 1 is done; 2 waits for the next run, as its subscriber has been told of 1; the subscriber of 3 and 5 rests
    assert {x.id for x in after.where("notify_sent").collect()} == ({1, 2, 3, 5} if legacy else {1})
    assert {(x.report_id, x.last_notified_at) for x in subs.collect()} == {("m1", 950_000), ("m2", 900_000)}


@pytest.mark.parametrize("legacy", [False, True])
def test_families_that_could_not_be_told_stay_open(spark, legacy):
    r = reports(spark, ("m1", "missing", "A", 1, "x", None, "s", 1), ("m2", "missing", "B", 1, "x", None, "s", 1), ("m3", "missing", "C", 1, "x", None, "s", 1), ("f1", "found", "", 1, " " * 0, None, "h", 1), ("f2", "found", "D", 1, None, None, "h", 1))
    m = _matches(spark, (1, "m1", "f1", 0.9, 0.0, "confirmed", False, False, None), (2, "m2", "f2", 0.8, 0.0, "confirmed", False, None, None), (3, "m3", "f2", 0.7, 0.0, "confirmed", False, False, None), (4, "m3", "gone", 0.95, 0.0, "confirmed", False, False, None), (5, "m1", "f2", 0.5, 0.0, "confirmed", False, False, None))
    s = spark.createDataFrame([("m1", "1", None), ("m3", "31", None), ("m3", "30", 949_000), ("m3", "32", 1)], "report_id string, phone string, last_notified_at long")
    outbox, after, subs = notify.notifications(m, s, r, 950_000, legacy_cooldown=legacy)
    # 1's other side is blank and 4's is not there: nothing is sent of them, the next match is told instead
    assert {(x.match_id, x.phone, x.text) for x in outbox.collect()} == {(5, "1", "D"), (3, "31", "D"), (3, "32", "D")}
    # 1 and 4 stay open, 2 has no subscriber, and of 3 one phone rests
    assert {x.id for x in after.where("notify_sent").collect()} == ({3, 5} if legacy else {5})
    assert {(x.phone, x.last_notified_at) for x in subs.collect()} == {("1", 950_000), ("31", 950_000), ("30", 949_000), ("32", 950_000)}


def test_review_queue_in_every_mode_has_one_match_a_missing_report(spark):
    r = reports(spark, ("m1", "missing", "A", 1, "x", None, None, 1), ("m2", "missing", "B", 1, "x", None, "hospital_1", 1), ("f1", "found", "C", 1, "x", None, "hospital_1", 1), ("f2", "found", "D", 1, "x", None, "s", 1))
    m = _matches(spark, (1, "m1", "f1", 0.95, 0.0, "pending", False, False, None), (2, "m1", "f2", 0.99, 0.0, "pending", False, False, None), (3, "m2", "f1", 0.5, 0.2, "pending", False, False, "yes"), (4, "m2", "f2", 0.6, 0.0, "pending", False, False, "no"))
    queue = lambda **k: [x.id for x in review.review_queue(m, r, **k).collect()]
    # what the family has confirmed comes first, but the fetch goes by score alone
    assert queue(mode="all") == [3, 2]
    assert queue(mode="all", fetch_limit=2) == [2] and queue(mode="all", fetch_limit=3) == [2, 4]
    # a missing report without a source is no reason to drop a match; one of the same source is
    assert queue(mode="high") == [1]


def test_an_answer_uses_up_what_was_shown(spark):
    m = _matches(spark, *((i, "m1", "f1", 0.9, 0.0, "pending", False, False, None) for i in range(1, 7)))
    hour = 3600
    shown = [("p", 1, "m1", 0), ("q", 2, "m1", 0), ("r", 3, "f1", 0), ("r", 4, "f1", 50), ("s", 5, "x", 0), ("t", 6, "m1", 0)]
    acks = [("p", "yes", 10), ("p", "no", 20), ("q", "yes", 73 * hour), ("q", "yes", 73 * hour + 1), ("r", "yes", 10), ("r", "no", 60), ("s", "yes", 72 * hour), ("u", "yes", 5), ("t", "no", -5)]
    got = review.record_acks(m, spark.createDataFrame(shown, "phone string, match_id long, report_id string, ts long"), spark.createDataFrame(acks, "phone string, ack string, ts long"))
    assert {x.id: (x.family_ack, x.family_ack_side, x.family_ack_at) for x in got.collect()} == {1: ("yes", "missing", 10), 2: (None, None, None), 3: ("yes", "found", 10), 4: ("no", "found", 60), 5: ("yes", None, 72 * hour), 6: (None, None, None)}


FORM = "id long, phone string, ts long, kind string, name string, cedula string, age int, location string, description string, contact string, has_photo boolean, restart boolean, skipped array<string>"


def test_intake_form(spark):
    def asked(*messages, people=False):
        names = [x.split()[0] for x in FORM.split(", ")]
        rows = [tuple({"id": i, "phone": "p", "ts": i, "restart": False} .get(n, m.get(n)) if n not in m else m[n] for n in names) for i, m in enumerate(messages)]
        return [x.next_field for x in sessions.intake_state(spark.createDataFrame(rows, FORM), people=people).orderBy("id").collect()]

    # a photo stands for a found person's name and for any description, not for the age
    assert asked({"kind": "found", "has_photo": True}) == ["cedula"]
    assert asked({"kind": "missing", "has_photo": True}) == ["name"]
    assert asked({"kind": "missing", "name": "Ana", "location": "x", "has_photo": True}, {"cedula": "1"}, {"age": 3}, {"contact": "0412"}) == ["cedula", "age", "contact", None]
    # what is skipped stays skipped, blanks are no answer, a restart forgets both
    assert asked({"name": "Ana", "skipped": ["cedula"]}, {"age": 3}, {"location": " "}, {"restart": True, "cedula": "1"}) == ["age", "location", "location", "name"]
    # another person begins a form of their own
    assert asked({"name": "Ana Paz", "cedula": "1"}, {"name": "Ana Paz Gil", "age": 3}, {"name": "Luis Diaz", "age": 4}, people=True) == ["age", "location", "cedula"]


def test_decisions_with_and_without_a_node(spark):
    lit = lambda v, t="string": F.lit(v).cast(t)
    rule = lambda i, c, u, t, m, n: tuple(spark.range(1).select(review.decide(lit(i), lit(c, "double"), lit(u), lit(t, "boolean"), lit(m), lit(n)).alias("d")).first().d)
    assert rule("ask", 0.9, "high", False, "m", "n") == ("n", "high_confidence_urgent", "intent")
    assert rule("ask", 0.9, "high", True, "m", None) == ("m", "low_confidence_follow_flow", "similarity")
    assert rule("ask", 0.75, "low", True, "m", "n") == ("n", "topic_change", "intent")
    assert rule("ask", 0.5, "low", True, "m", None) == ("m", "following_flow", "similarity")
    assert rule("ask", 0.68, "low", False, None, "n") == ("n", "intent_detected", "intent")
    assert rule("ask", 0.68, "low", False, None, "") == ("fallback", "no_clear_intent", "fallback")
    assert rule(None, 0.9, "high", True, "", "n") == ("fallback", "no_clear_intent", "fallback")


def test_rate_limit_counts_accepted_events(spark):
    e = spark.createDataFrame([(i, "p", float(t)) for i, t in enumerate([*range(25), 60, 60.001])], "id long, phone string, ts double")
    got = {r.id: r.accepted for r in sessions.rate_limit(e).collect()}
    assert [got[i] for i in range(27)] == [True] * 20 + [False] * 5 + [False, True]


def test_leads_are_validated(spark):
    raw = spark.createDataFrame([(" Ana ", "0.9", "x", "c" * 300), ("", "0.9", "3", ""), ("Eva", "bad", "3", ""), (None, "1", "3", "")], "full_name string, confidence string, age string, context string")
    (r,) = review.valid_leads(raw).collect()
    assert (r.full_name, r.age, len(r.context)) == ("Ana", None, 200)


def test_private_reports_are_never_shown(spark):
    from kindred.operators import search

    r = reports(spark, ("f1", "found", "Jose Gonzalez", 30, "Ccs", "CI: 1234567", "private_chat", 1), ("f2", "found", "Jose Gonzalez", 30, "Ccs", "CI: 1234567", "hospital_1", 1))
    q = spark.createDataFrame([(1, "Jose Gonzalez", 30, "Ccs", "1234567")], "query_id long, name string, age int, location string, cedula string")
    assert {x.id for x in search.search_and_answer(q, r).collect()} == {"f2"}
    assert {x.id for x in search.recall_by_tokens(q, r).collect()} == {"f2"}


def test_registry_hits_that_need_review_yield_nothing(spark):
    hits = spark.createDataFrame([("m1", "9", "P", 0.9, True, True), ("m1", "8", "Q", 0.9, False, True), ("m1", "7", "R", 0.9, False, False)], "report_id string, person_id string, name string, score double, needs_review boolean, strong_match boolean")
    r = reports(spark, ("m1", "missing", "A", 1, "x", None, "s", 1))
    none = spark.createDataFrame([], "missing_id string, found_id string, combined_score double, status string")
    _, m = linking.cross_registry(hits, r, none)
    assert [(x.found_id, x.status) for x in m.collect()] == [("x:8", "pending")]


def test_knn_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, 8)), rng.normal(size=(200, 8))
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(x)] + [("zero", [0.0] * 8), ("none", None)], "query_id string, vector array<double>")
    i = spark.createDataFrame([(f"i{j}", v.tolist()) for j, v in enumerate(y)], "item_id string, vector array<double>")
    got = vectors.knn_join(q, i, 5, 0.1, blocks=3).toPandas()
    s = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
    want = {(f"q{a}", f"i{b}") for a in range(30) for b in np.argsort(-s[a])[:5] if s[a, b] >= 0.1}
    assert set(zip(got.query_id, got.item_id, strict=True)) == want


def test_admin_search_finds_parts_of_words_and_numbers(spark):
    from kindred.operators import search

    r = reports(spark, ("a", "found", "Karina González", 30, "Ccs", "exp 99123456700", "hospital_1", 1), ("b", "missing", "José Gonzalo Li", 30, "Ccs", None, "x", 2), ("c", "missing", None, 1, None, "12345 6700", "x", 3))
    q = spark.createDataFrame([(1, "gonz"), (2, "karin"), (3, "V-123.456"), (4, "li"), (5, "gonz karin"), (6, " "), (7, "zz"), (8, "GONZ"), (9, "e"), (10, None)], "query_id long, q string")
    assert {(x.query_id, x.id, x.rank) for x in search.admin_search(r, q).collect()} == {(1, "a", 1), (1, "b", 2), (2, "a", 1), (3, "a", 1), (4, "b", 1), (5, "a", 1), (8, "a", 1), (8, "b", 2), (9, "a", 1), (9, "b", 2)}


def test_search_person_finds_variants_that_end_inside_a_word(spark):
    from kindred.operators import search

    r = reports(spark, ("a", "found", "Karina González", 30, "Ccs", None, "hospital_1", 1), ("b", "found", "Otra Persona", 30, "Ccs", None, "hospital_1", 1))
    q = spark.createDataFrame([(1, "Gonz", 30, "Ccs"), (2, "nadie mas", 30, "Ccs")], "query_id long, name string, age int, location string")
    assert [(x.query_id, x.id) for x in search.search_person(q, r).collect()] == [(1, "a")]


def test_best_faq_compares_all_questions(spark):
    from difflib import SequenceMatcher

    said = [("m1", "q es eso"), ("m2", "dnde stoi"), ("m3", "donde estoy"), ("m4", "zzzz"), ("m5", None), ("m6", "q es eso")]
    asked = [(i, t) for i, t in enumerate(["que es", "donde esta", "donde dormir hoy con frio", None, "que es"])]
    got = review.best_faq(spark.createDataFrame(said, "message_id string, text string"), spark.createDataFrame(asked, "faq_id long, question string"), 0.5)
    want = {}
    for m, t in said:
        met = [(-round(SequenceMatcher(None, t, a).ratio(), 6), i) for i, a in asked if t and a]
        if met and -min(met)[0] >= 0.5:
            want[m] = (min(met)[1], -min(met)[0])
    assert {x.message_id: (x.faq_id, x.ratio) for x in got.collect()} == want and "m1" in want and "m2" in want


@pytest.mark.parametrize("cutoff", [0.05, 0.3, 0.65, 0.9, 1.0])
def test_best_faq_sent_and_joined_equals_all_pairs(spark, cutoff):
    from difflib import SequenceMatcher

    from kindred.functions import fuzzy

    rng = random.Random(3)
    words = "donde esta mi familia como registro una persona refugio hospital aaaa zz que es esto".split()
    text = lambda: " ".join(rng.choices(words, k=rng.randint(1, 7)))
    asked = [(i, text()) for i in range(25)] + [(90, None), (None, "x"), (91, "¿Dónde ESTÁ?"), (92, "!!!"), (93, "aaaaaaaa")]
    said = [(f"m{i}", text()) for i in range(40)] + [("n", None), ("e", "¡!"), ("d", "donde esta"), ("d2", "donde esta"), ("a", "aaaa aaaa")]
    want = {}
    for m, t in said:
        if t is not None:
            met = [(-round(SequenceMatcher(None, fuzzy._fold(t), fuzzy._fold(a)).ratio(), 6), i) for i, a in asked if i is not None and a is not None]
            if -min(met)[0] >= cutoff:
                want[m] = (min(met)[1], -min(met)[0])
    messages, faqs = spark.createDataFrame(said, "message_id string, text string"), spark.createDataFrame(asked, "faq_id long, question string")
    for most_sent in (1 << 20, 0):
        got = review.best_faq(messages, faqs, cutoff, most_sent)
        assert {x.message_id: (x.faq_id, x.ratio) for x in got.collect()} == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_gestalt_ratios_of_many_pairs_are_those_of_the_matcher():
    from difflib import SequenceMatcher

    import numpy as np

    from kindred.functions import gestalt

    rng = random.Random(9)
    text = lambda letters, least, most: "".join(rng.choices(letters, k=rng.randint(least, most)))
    # from 200 letters on the matcher leaves out popular ones
    sizes = [(0, 4), (5, 40), (150, 199), (200, 420)]
    a, b = ([text(letters, *s) for letters in ("a", "ab", "abcdefgh é", "abcdefghijklmnopqrstuvwxyz") for s in sizes for _ in range(2)] for _ in "ab")
    x, y = np.divmod(np.arange(len(a) * len(b)), len(b))
    left, right = gestalt.Texts(a), gestalt.Texts(b)
    want = np.array([SequenceMatcher(None, a[i], b[j]).ratio() for i, j in zip(x, y, strict=True)])
    assert (gestalt.ratios(left, right, x, y, np.arange(len(x)), np.zeros(len(x))) == want).all()
    assert (gestalt.bounds(left, right, x, y) >= want).all()
    # of a group the best stay
    best = gestalt.ratios(left, right, x, y, x, np.zeros(len(a))).reshape(len(a), -1).max(1)
    assert (best == want.reshape(len(a), -1).max(1)).all()


def test_best_faq_deals_short_messages_to_many_tasks(spark):
    from pyspark.sql import functions as F

    said = spark.range(400).select(F.col("id").cast("string").alias("message_id"), F.concat(F.lit("donde esta "), "id").alias("text"))
    asked = spark.createDataFrame([(1, "donde esta")], "faq_id long, question string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    got = review.best_faq(said, asked, 0.2)
    assert got.count() == 400
    assert adaptive == "true" and "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_link_by_part_cuts_each_distinct_number_once(spark):
    rows = [(f"m{i}", "missing", "CI: 10000007 tel 99912345678901234") for i in range(50)]
    rows += [("m90", "missing", "ref 1000000710000007, 10000007"), ("m91", "missing", "1234"), ("m92", "missing", None)]
    rows += [("f1", "found", "ci 10000007"), ("f2", "found", "ci 10000007"), ("f3", "found", "ci 7654321"), ("f4", "found", "ci 12345678")]
    r = spark.createDataFrame(rows, "id string, kind string, distinguishing_marks string")
    got = linking.link_by_id(r, "substring")
    pairs = [(x.missing_id, x.found_id) for x in got.collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(f"m{i}", f) for i in (*range(50), 90) for f in ("f1", "f2")} | {(f"m{i}", "f4") for i in range(50)}
    # the stretches are made of distinct numbers, not of each report's
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("transform(sequence(1") :]
    assert "Aggregate [run" in below[: below.index("regexp_extract_all")]
