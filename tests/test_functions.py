from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kindred.functions import fuzzy, scores, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def L(x):
    return F.lit(x).cast("string") if x is None or isinstance(x, str) else F.lit(x)


@pytest.mark.parametrize("raw, want", [("García", "garcia"), (None, ""), ("ÑANDÚ", "nandu")])
def test_deaccent(spark, raw, want):
    assert value(spark, text.deaccent(L(raw))) == want


@pytest.mark.parametrize("raw, want", [("Maiquetía, Vargas", "la guaira"), ("Ciudad Bolívar", "bolivar"), (None, None), ("  ", None), ("Otro  Sitio!", "otro sitio")])
def test_location(spark, raw, want):
    assert value(spark, text.normalize_location(L(raw))) == want


@pytest.mark.parametrize("a, b, same", [("gonzalez", "gonsales", True), ("beltran", "veltran", True), ("yajaira", "llajaira", True), ("jose", "hose", False)])
def test_phonetic(spark, a, b, same):
    assert (value(spark, text.phonetic_token(L(a))) == value(spark, text.phonetic_token(L(b)))) is same
    assert (fuzzy._sound(a) == fuzzy._sound(b)) is same


@pytest.mark.parametrize("kind, marks, want", [("found", None, 4), ("missing", None, 2), ("missing", "herida", 3), ("missing", "a salvo, herida", 3), ("found", "herida", 4), ("missing", "occiso", 5), (None, None, 1)])
def test_status_rank(spark, kind, marks, want):
    assert value(spark, text.status_rank(L(kind), L(marks))) == want


@pytest.mark.parametrize("raw, want", [("CI: 12345678 | x", "12345678"), ("ci 1234", None), ("CI: V-12345678", None), (None, None)])
def test_extract_id(spark, raw, want):
    assert value(spark, text.extract_id(L(raw))) == want


def test_bounded_number(spark):
    assert value(spark, text.has_number(L("04123456"), L("123456"))) is False
    assert value(spark, text.has_number(L("CI: 123456"), L("123456"))) is True


@pytest.mark.parametrize("raw, want", [("25 años", 25), ("~40", 40), ("30-35", 30), ("0", None), ("130", None), (None, None)])
def test_age(spark, raw, want):
    assert value(spark, text.parse_age(L(raw))) == want


def test_name_variants(spark):
    assert value(spark, text.name_variants(L("Ana Díaz"))) == ["Ana Díaz", "Díaz Ana", "Díaz", "Ana"]
    assert value(spark, text.name_variants(L("Al"))) == []


@pytest.mark.parametrize("name, want", [("EVENTO: x", True), ("Menor reportado - Edif. A", True), ("NN", True), ("Ana", False), (None, False)])
def test_noise(spark, name, want):
    assert value(spark, text.is_noise(L(name))) is want


@pytest.mark.parametrize("reply, want", [("lamento decir que falleció", "hedge"), ("Fue encontrado ayer", "hedge"), ("encontramos una posible coincidencia", "keep"), ("¿Cuál es su edad?", "keep"), ("una posible coincidencia: es tu hijo", "hedge")])
def test_reply_guard(spark, reply, want):
    assert value(spark, text.classify_reply(L(reply))) == want


def test_mask_pii(spark):
    got = value(spark, text.mask_pii(L("CI V-12.345.678, tel 0412-555-1234, otro 0414 555 4321")))
    assert got.masked == "CI [CEDULA], tel [TELEFONO], otro [TELEFONO]"
    assert (got.cedula, got.contact) == ("12345678", "04145554321")


@pytest.mark.parametrize("a, b, want", [("ff00ff00ff00ff00", "ff00ff00ff00ff00", 0), ("0000000000000001", "0000000000000000", 1), ("8000000000000000", "0000000000000001", 2), (None, "00", 999), ("zz", "00", 999)])
def test_hamming(spark, a, b, want):
    assert value(spark, text.hamming_hex(L(a), L(b))) == want


def test_ages(spark):
    for d, want in ((5, 1.0), (15, 0.6), (16, 0.0)):
        assert value(spark, scores.age_score(L(20), L(20 + d))) == want
    assert value(spark, scores.age_score(L(20), F.lit(None).cast("int"))) == 0.5
    for a, b, want in ((10, 16, True), (10, 17, False), (20, 35, True), (20, 36, False)):
        assert value(spark, scores.age_gate(L(a), L(b))) is want
    assert value(spark, F.round(scores.composite(L(1.0), L(0.5), L(0.5)), 9)) == 0.85


def test_hours_and_cooldown(spark):
    day = F.array().cast("array<string>")
    for h, want in ((23, True), (12, False)):
        assert value(spark, scores.within_hours(L("22:00"), L("06:00"), day, F.lit(datetime(2024, 1, 1, h)))) is want
    assert value(spark, scores.within_cooldown(L("nonsense"), F.lit(datetime(2024, 1, 1)))) is False


def test_template_values_are_literal(spark):
    assert value(spark, text.render(L("{a|x} {b|y} {c|z}"), {"a": L("1$2\\"), "b": L("")})) == "1$2\\ y z"


def test_ratios():
    assert fuzzy.plain_ratio("abc", "abc") == 100.0
    assert fuzzy.plain_ratio("lewenstein", "levenshtein") == pytest.approx(85.714, abs=1e-3)
    assert fuzzy.sort_ratio("perez jose", "jose perez") == 100.0
    assert fuzzy.weighted_ratio("jose perez", "perez jose") == pytest.approx(95.0)
    assert fuzzy.window_ratio("guaira", "maiquetia la guaira") == 100.0
    assert fuzzy.lcs("", "x") == 0


def test_same_person():
    assert not fuzzy.one_person("Maria Perez", "Carlos Perez")
    assert not fuzzy.one_person("Maria Perez", "Maria Gomez")
    assert fuzzy.one_person("Maria Perez", "Maria Perez Gomez")
    assert fuzzy.one_person("", "Ana")


def test_gestalt():
    assert fuzzy.closest("quiero ver mi reporte", ["reporte", "ayuda"], 0.6) == "reporte"
    assert fuzzy.closest("xyz", ["reporte"], 0.6) is None


def test_ratios_of_many_pairs_equal_those_of_one():
    import random

    from kindred.functions import fuzzy

    rng = random.Random(5)
    words = ["ana", "maria", "pérez", "perez", "gonzález", "de", "la", "li", "o", "xiomara", "\U00010400b", "a" * 70]
    texts = ["", " ", "a", "ab" * 150, "x" * 600] + [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(150)] + ["".join(rng.choices("abc ", k=rng.randint(1, 200))) for _ in range(60)]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(1500)] + [(a, a) for a in texts]
    a, b = map(list, zip(*pairs, strict=True))
    assert fuzzy.lcs_many(a, b).tolist() == [fuzzy.lcs(x, y) for x, y in pairs]
    for one, many in ((fuzzy.plain_ratio, fuzzy.ratios), (fuzzy.sort_ratio, fuzzy.sort_ratios), (fuzzy.set_ratio, fuzzy.set_ratios), (fuzzy.window_ratio, fuzzy.window_ratios), (fuzzy.weighted_ratio, fuzzy.weighted_ratios)):
        assert many(a, b).tolist() == [one(x, y) for x, y in pairs]
        assert many([], []).tolist() == []
    for least in (50.0, 85.0, 92.0, 97.0):
        got = fuzzy.weighted_ratios(a, b, least)
        assert [(g >= least, g if g >= least else None) for g in got] == [(w >= least, w if w >= least else None) for w in (fuzzy.weighted_ratio(x, y) for x, y in pairs)]


def test_scores_of_repeated_and_null_pairs():
    import pandas as pd

    from kindred.functions import fuzzy

    a, b = pd.Series(["ana", None, "ana", "x", None]), pd.Series(["ama", "x", "ama", None, None])
    got = fuzzy.scored(fuzzy.plain_ratio, a, b)
    assert got[0] == got[2] == fuzzy.plain_ratio("ana", "ama") and got[[1, 3, 4]].isna().all()
    assert fuzzy.scored(fuzzy.name_match, a, b)[0] == fuzzy.name_match("ana", "ama")
    assert len(fuzzy.scored(fuzzy.plain_ratio, a[:0], b[:0])) == 0
