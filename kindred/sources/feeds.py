"""Feeds of person records to one report schema: each normaliser is one projection and one filter.

A raw feed is a DataFrame whose columns are the feed's fields; a field that it lacks is null. All give the columns of
REPORT. Sources are named by parameters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import any_of, blank_to_null, deaccent, first_of

REPORT = ("kind", "full_name", "age", "last_seen_location", "distinguishing_marks", "person_state", "source", "source_url")
_DEAD = ("fallec", "muert", "occiso", "difunt")
_HURT = ("herid", "lesion", "grave", "critic", "uci", "intervenido")


def field(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _fields(df: DataFrame):
    return lambda *names: first_of(*(field(df, n) for n in names))


def age_of(c: Column, most: int = 119) -> Column:
    n = c.try_cast("int")
    return F.when(n.between(1, most), n)


def joined_marks(*parts: Column, most: int = 500) -> Column:
    """The parts that are not blank, joined by ' | ' and cut to a length that ends in dots."""
    t = F.nullif(F.concat_ws(" | ", *(blank_to_null(p) for p in parts)), F.lit(""))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def labelled(label: str, c: Column) -> Column:
    return F.when(blank_to_null(c).isNotNull(), F.concat(F.lit(label), F.trim(c)))


def id_mark(c: Column) -> Column:
    return labelled("CI: ", text.id_digits(c))


def _state(c: Column, hurt=_HURT) -> Column:
    d = deaccent(c)
    return F.when(any_of(d, _DEAD), "deceased").when(any_of(d, hurt), "injured").otherwise("alive")


def _report(df: DataFrame, where: Column | None = None, **cols) -> DataFrame:
    full = {c: cols.get(c, F.lit(None)) for c in REPORT}
    out = df.where(where) if where is not None else df
    typed = {"age": "int"}
    return out.select(*((v if isinstance(v, Column) else F.lit(v)).cast(typed.get(c, "string")).alias(c) for c, v in full.items()))


def _named(name: Column, key: Column | None = None, least: int = 3) -> Column:
    ok = F.length(F.coalesce(name, F.lit(""))) >= least
    return ok & blank_to_null(key).isNotNull() if key is not None else ok


def sheet(df: DataFrame, source: str = "hospital_sheet") -> DataFrame:
    """NM1, of rows as SC6 gives them: tab, title, name, age, id, phone, addr, obs. The place is the title, else the tab."""
    v = _fields(df)
    name = v("name")
    digits = text.id_digits(v("id"))
    key = F.concat(F.substring(deaccent(v("tab")), 1, 24), F.lit(":"), F.coalesce(F.nullif(F.regexp_replace(F.coalesce(v("id"), F.lit("")), "\\D", ""), F.lit("")), F.substring(deaccent(name), 1, 28)))
    ok = _named(name) & ~deaccent(name).isin("n", "nombre", "total")
    return _report(df, ok, kind="found", full_name=name, age=text.parse_age(v("age")), last_seen_location=F.coalesce(v("title"), v("tab")), distinguishing_marks=joined_marks(labelled("CI: ", digits), v("obs"), labelled("Dir: ", v("addr")), most=480), person_state=_state(v("obs")), source=source, source_url=F.concat(F.lit(f"{source}:"), key))


def hospital_api(df: DataFrame, source: str = "hospital_api") -> DataFrame:
    """NM2."""
    v = _fields(df)
    name, health = v("nombre_completo"), v("estado_salud")
    place = F.nullif(F.concat_ws(", ", v("ubicacion_actual"), v("municipio"), v("estado")), F.lit(""))
    marks = joined_marks(id_mark(v("cedula")), F.when(F.lower(health) != "desconocido", labelled("Estado: ", health)))
    return _report(df, _named(name, v("id")), kind="found", full_name=name, age=age_of(v("edad")), last_seen_location=place, distinguishing_marks=marks, person_state=_state(health, ("herid", "grave", "critic")), source=source, source_url=F.concat(F.lit(f"{source}:"), v("id")))


def join_hospital(people: DataFrame, hospitals: DataFrame) -> DataFrame:
    """SC15: people with their hospital's name, city and state as hospital_place."""
    h = hospitals.select(F.col("id").alias("hospital_id"), F.nullif(F.concat_ws(", ", *(blank_to_null(F.col(c)) for c in ("name", "city", "state"))), F.lit("")).alias("hospital_place"))
    return people.join(h, "hospital_id", "left")


def patients(df: DataFrame, source: str = "patients") -> DataFrame:
    """NM3, after SC15."""
    v = _fields(df)
    marks = joined_marks(labelled("Estado: ", v("status")), F.when(field(df, "is_safe") == "true", "Confirmado en buen estado"), v("notes"))
    return _report(df, _named(v("full_name"), least=1), kind="found", full_name=v("full_name"), age=age_of(v("age")), last_seen_location=v("hospital_place"), distinguishing_marks=marks, source=source, source_url=F.concat(F.lit(f"{source}:"), F.coalesce(v("id"), F.lit(""))))


def document_table(df: DataFrame, source: str = "doc_table") -> DataFrame:
    """NM4, after SC7 or SC8: doc, name, age, hospital; rows without an age drop out."""
    v = _fields(df)
    age = text.parse_age(v("age"), 120)
    key = F.concat(F.lit("doc:"), v("doc"), F.lit(":"), F.substring(v("name"), 1, 40))
    return _report(df, _named(v("name")) & age.isNotNull(), kind="found", full_name=v("name"), age=age, last_seen_location=v("hospital"), source=source, source_url=key)


def hospital_db(df: DataFrame, source: str = "hospital_db") -> DataFrame:
    """NM5."""
    v = _fields(df)
    raw = [F.coalesce(v(*n), F.lit("")) for n in (("nombre", "name"), ("hospital",), ("ciudad",))]
    key = F.coalesce(v("id"), F.concat(F.lit("hash:"), F.substring(F.sha2(F.concat_ws("|", *raw), 256), 1, 16)))
    dead = F.lower(v("estado")).isin("fallecido", "muerto", "deceased")
    return _report(df, None, kind="found", full_name=F.coalesce(v("nombre", "name"), F.lit("Desconocido")), age=v("edad", "age").try_cast("int"), last_seen_location=v("hospital", "ubicacion", "ciudad"), distinguishing_marks=F.when(dead, "Fallecido"), source=source, source_url=F.concat(F.lit(f"{source}:"), key))


def located_list(df: DataFrame, source: str = "located_list") -> DataFrame:
    """NM6."""
    v = _fields(df)
    place, area = v("lugarNombre"), v("direccion")
    inside = F.coalesce(F.lower(place).contains(F.lower(area)), F.lit(False))
    where = F.when(place.isNotNull() & area.isNotNull() & ~inside, F.concat(place, F.lit(" ("), area, F.lit(")"))).otherwise(F.coalesce(place, area))
    marks = joined_marks(v("observaciones"), F.when(F.lower(v("condicion")) != "desconocido", labelled("Condicion: ", v("condicion"))))
    return _report(df, _named(v("nombreCompleto"), v("slug"), 1), kind="found", full_name=v("nombreCompleto"), last_seen_location=where, distinguishing_marks=marks, source=source, source_url=F.concat(F.lit(f"{source}:"), v("slug")))


#: States of the status feed that count as found or as missing whatever the type, and the labels of states (fixed values).
STATUS_FOUND = ("a_salvo", "evacuado_ok", "rescatado", "visto_con_vida", "herido", "fallecido")
STATUS_MISSING = ("desaparecido",)
STATUS_LABELS = {
    "a_salvo": "A salvo",
    "atrapado": "Atrapado",
    "atrapados": "Atrapados",
    "colapsado": "Edificio colapsado",
    "dano_grave": "Dano grave",
    "desaparecido": "Desaparecido",
    "en_rescate": "En rescate",
    "evacuado_ok": "Evacuado, a salvo",
    "fallecido": "Fallecido",
    "herido": "Herido",
    "rescatado": "Rescatado",
    "visto_con_vida": "Visto con vida",
}


def status_enum(df: DataFrame, source: str = "status_feed", region: str = "La Guaira") -> DataFrame:
    """NM7: the kind by state, where the state tells it, else by type; the place from building, floor and address within
    the region, else its coordinates; the state's label is put before marks that don't hold it, so that it survives
    cutting."""
    v = _fields(df)
    state, told = F.lower(v("estado")), F.coalesce(field(df, "descripcion"), F.lit(""))
    kind = F.when(state.isin(*STATUS_FOUND), "found").when(state.isin(*STATUS_MISSING) | (F.lower(v("tipo")) == "busco"), "missing").otherwise("found")
    floor = F.when(~v("piso").isin("None", "null", "0"), v("piso"))
    building = F.concat(v("edificio"), F.coalesce(F.concat(F.lit(", Piso "), floor), F.lit("")))
    written = F.nullif(F.concat_ws(", ", building, v("direccion")), F.lit(""))
    lat, lng = v("lat").try_cast("double"), v("lng").try_cast("double")
    at = F.when(lat.isNotNull() & lng.isNotNull(), F.format_string(f"{region.replace('%', '%%')} (%.5f, %.5f)", lat, lng))
    place = F.coalesce(F.concat(written, F.lit(f", {region}")), at, F.lit(region))
    said = F.create_map(*(F.lit(x) for pair in STATUS_LABELS.items() for x in pair))[state]
    label = F.when(~F.lower(told).contains(F.lower(said)), said)
    return _report(df, _named(v("nombre"), v("id"), 1), kind=kind, full_name=v("nombre"), age=age_of(v("edad"), 129), last_seen_location=place, distinguishing_marks=joined_marks(labelled("Estado: ", label), told), source=source, source_url=F.concat(F.lit(f"{source}:"), v("id")))


def status_list(df: DataFrame, source: str = "status_list") -> DataFrame:
    """NM8."""
    v = _fields(df)
    key = F.coalesce(F.concat(F.lit(f"{source}:"), v("id")), F.concat(F.lit(f"{source}::"), v("display_name")))
    kind = F.when(F.lower(v("status")).isin("encontrado", "found"), "found").otherwise("missing")
    return _report(df, _named(v("display_name"), least=1), kind=kind, full_name=v("display_name"), last_seen_location=F.nullif(F.concat_ws(", ", v("municipio"), v("parroquia")), F.lit("")), source=source, source_url=key)


def alias_feed(df: DataFrame, source: str = "alias_feed") -> DataFrame:
    """NM9."""
    v = _fields(df)
    name, state = v("name", "nombre", "full_name"), F.coalesce(F.lower(v("status", "estado")), F.lit(""))
    key = F.coalesce(v("id", "_id"), F.substring(F.md5(F.lower(name)), 1, 12))
    return _report(df, _named(name), kind=F.when(state.contains("encontrado") | (state == "found"), "found").otherwise("missing"), full_name=name, age=v("age", "edad").try_cast("int"), last_seen_location=v("ciudad", "location", "ultima_ubicacion"), source=source, source_url=F.concat(F.lit(f"{source}:"), key))


def community(df: DataFrame, source: str = "community") -> DataFrame:
    """NM10: hidden rows drop out; the latest of the community's updates (array of messages) is added."""
    v = _fields(df)
    last = F.try_element_at(F.col("actualizaciones"), F.lit(-1)) if "actualizaciones" in df.columns else F.lit(None).cast("string")
    marks = F.nullif(F.substring(F.concat_ws(" | ", v("descripcion"), labelled("Actualización: ", last)), 1, 480), F.lit(""))
    kind = F.when(F.upper(v("estado")).isin("SANO_SALVO", "INFO_RECIBIDA"), "found").otherwise("missing")
    shown = ~F.coalesce(field(df, "oculto") == "true", F.lit(False))
    return _report(df, shown & _named(v("nombre"), v("id")), kind=kind, full_name=v("nombre"), age=age_of(v("edad")), last_seen_location=v("zona"), distinguishing_marks=marks, source=source, source_url=F.concat(F.lit(f"{source}:"), v("id")))


def decoded_people(df: DataFrame, source: str = "decoded_people") -> DataFrame:
    """NM11, after SC11."""
    v = _fields(df)
    name = F.nullif(F.concat_ws(" ", v("firstName"), v("lastName")), F.lit(""))
    marks = joined_marks(labelled("CI: ", v("idNumber")), v("description"), labelled("Hospital: ", v("hospitalName")), labelled("Estado hospital: ", v("hospitalStatus")), labelled("Nota: ", v("foundNote")))
    kind = F.when(F.lower(v("status")).isin("found", "already_found"), "found").otherwise("missing")
    return _report(df, _named(name, v("id"), 1), kind=kind, full_name=name, age=age_of(v("age")), last_seen_location=v("lastSeen"), distinguishing_marks=marks, source=source, source_url=F.concat(F.lit(f"{source}:"), v("id")))


def tagged_tables(df: DataFrame, source: str = "tables") -> DataFrame:
    """NM12, after SC14 with _table missing, found or hospital."""
    v = _fields(df)
    tag = F.coalesce(F.col("_table"), F.lit("missing"))
    tag = F.when(tag.isin("missing", "found"), tag).otherwise("hospital")
    return _report(df, None, kind=F.when(tag == "missing", "missing").otherwise("found"), full_name=F.coalesce(v("nombre"), F.lit("Desconocido")), age=v("edad").try_cast("int"), last_seen_location=v("ubicacion", "estado", "ciudad"), distinguishing_marks=v("descripcion"), source=source, source_url=F.concat(F.lit(f"{source}_"), tag, F.lit(":"), F.coalesce(v("id"), F.lit(""))))


def _slug(c: Column) -> Column:
    plain = F.regexp_replace(deaccent(c), "[^\\x00-\\x7F]", "")
    return F.regexp_replace(F.substring(F.regexp_replace(plain, "[^a-z0-9]", "_"), 1, 40), "^_+|_+$", "")


def csv_people(df: DataFrame, source: str = "csv_people") -> DataFrame:
    """NM13, after SC5: keyed by identifier, else by name, hospital and age. Home addresses are left out."""
    v = _fields(df)
    name, known, age = v("nombre"), v("cedula"), v("edad")
    by_name = F.concat(_slug(name), F.lit("_"), _slug(v("hospital")), F.when(age.isNotNull(), F.concat(F.lit("_"), _slug(age))).otherwise(""))
    key = F.coalesce(F.concat(F.lit("ci_"), F.regexp_replace(known, "[^A-Za-z0-9]", "")), by_name)
    marks = joined_marks(labelled("CI: ", known), labelled("Estatus: ", v("estatus")), most=1 << 30)
    real = _named(name, least=1) & ~F.lower(name).isin("nombre", "name", "paciente", "n/a", "-")
    return _report(df, real, kind="found", full_name=name, age=age_of(F.regexp_extract(age, "\\b(\\d{1,3})\\b", 1)), last_seen_location=v("hospital"), distinguishing_marks=marks, source=source, source_url=F.concat(F.lit(f"{source}:"), key))


def cards(df: DataFrame, source: str = "cards") -> DataFrame:
    """NM14, after SC9: name and a map fields of folded labels to values. The place is the last of those whose label begins
    like one."""
    f = F.col("fields")
    name = blank_to_null(F.col("name"))
    age = F.regexp_extract(F.try_element_at(f, F.lit("edad")), "\\d{1,3}", 0).try_cast("int")
    places = F.filter(F.map_entries(f), lambda e: e["key"].startswith("ubicacion") | e["key"].startswith("lugar") | e["key"].startswith("centro"))
    place = blank_to_null(F.try_element_at(places, F.lit(-1))["value"])
    key = F.substring(F.md5(F.concat(F.lower(name), F.lit("|"), F.lower(F.coalesce(place, F.lit(""))))), 1, 16)
    return _report(df, _named(name), kind="found", full_name=name, age=F.when(age.between(1, 129), age), last_seen_location=place, distinguishing_marks=labelled("Sexo: ", F.try_element_at(f, F.lit("sexo"))), source=source, source_url=F.concat(F.lit(f"{source}:"), key))


def registry_people(df: DataFrame, source: str = "registry") -> DataFrame:
    """NM15: centro_nombre and ubicacion_texto are the nested fields' values."""
    v = _fields(df)
    age = F.try_element_at(F.split(v("edad"), "\\s+"), F.lit(1)).try_cast("int")
    marks = F.nullif(F.concat_ws(" | ", id_mark(v("cedula")), v("descripcion"), labelled("Centro: ", v("centro_nombre"))), F.lit(""))
    kind = F.when(F.lower(v("estado")).contains("localizado"), "found").otherwise("missing")
    return _report(df, _named(v("nombre"), v("id")), kind=kind, full_name=v("nombre"), age=F.when(age.between(1, 119), age), last_seen_location=v("ubicacion_texto"), distinguishing_marks=marks, person_state="unknown", source=source, source_url=F.concat(F.lit(f"{source}:"), v("id")))


def explode_entries(lists: DataFrame, entries: str = "entradas") -> DataFrame:
    """SC16: one row for each entry of a list, with the list's own columns beside the entry's."""
    keep = [c for c in lists.columns if c != entries]
    return lists.select(*keep, F.explode(entries).alias("_e")).select(*keep, "_e.*")


def registry_entries(df: DataFrame, source: str = "registry_lists") -> DataFrame:
    """NM16, after SC16."""
    v = _fields(df)
    return _report(df, _named(v("nombre"), v("id")), kind="found", full_name=v("nombre"), age=age_of(v("edad")), last_seen_location=v("centro_nombre"), distinguishing_marks=labelled("Centro: ", v("centro_nombre")), person_state="unknown", source=source, source_url=F.concat(F.lit("registry_list:"), v("id")))


def event_feed(df: DataFrame, source: str = "event_feed") -> DataFrame:
    """NM17: noise by design; _geolocation is an array of two numbers."""
    v = _fields(df)
    at = [F.get(F.col("_geolocation").cast("array<string>"), i) for i in (0, 1)] if "_geolocation" in df.columns else [F.lit(None).cast("string")]
    geo = F.when(at[0].isNotNull() & at[-1].isNotNull(), F.concat_ws(",", *at))
    return _report(df, None, kind="found", full_name=F.concat(F.lit("EVENTO: "), F.coalesce(v("Evento"), F.lit("Sin tipo"))), last_seen_location=F.coalesce(v("Ubicacion"), geo), distinguishing_marks=F.coalesce(field(df, "Descripcion_del_evento"), F.lit("")), source=source, source_url=F.concat(F.lit(f"{source}:"), F.coalesce(v("_id"), F.lit(""))))


def legacy_people(df: DataFrame, source: str = "legacy") -> DataFrame:
    """NM18."""
    v = _fields(df)
    state = F.coalesce(F.lower(v("status")), F.lit(""))
    return _report(df, None, kind=F.when(state.contains("encontrado") | (state == "found"), "found").otherwise("missing"), full_name=F.coalesce(v("display_name"), F.lit("Desconocido")), last_seen_location=F.nullif(F.concat_ws(", ", v("municipio"), v("parroquia")), F.lit("")), source=source, source_url=F.concat(F.lit(f"{source}:"), v("id")))


def posts(df: DataFrame, source: str = "posts") -> DataFrame:
    """NM19: posts of ten letters or more; the kind by words of their type."""
    v = _fields(df)
    kind_ = F.coalesce(F.lower(v("tipo")), F.lit(""))
    kind = F.when(any_of(kind_, ("busco", "missing", "desaparecido")), "missing").when(any_of(kind_, ("encontr", "found", "hospital")), "found").otherwise("missing")
    raw = F.coalesce(field(df, "texto"), F.lit(""))
    return _report(df, F.length(F.trim(raw)) >= 10, kind=kind, full_name=F.concat(F.lit("Post: "), F.substring(F.coalesce(v("autor_nombre"), F.lit("Desconocido")), 1, 100)), last_seen_location=v("ubicacion"), distinguishing_marks=F.substring(raw, 1, 500), source=source, source_url=F.concat(F.lit("post:"), v("post_id")))


def chat_reports(df: DataFrame, source: str = "private_chat") -> DataFrame:
    """NM20: what a conversation has collected, under its key: missing unless it says otherwise, the marks whole."""
    v = _fields(df)
    marks = joined_marks(id_mark(v("cedula")), v("description"), most=1 << 30)
    return _report(df, None, kind=F.coalesce(v("kind"), F.lit("missing")), full_name=F.coalesce(v("name"), F.lit("")), age=v("age").try_cast("int"), last_seen_location=v("location"), distinguishing_marks=marks, source=source, source_url=v("report_key"))


def free_text(df: DataFrame, column: str = "body") -> DataFrame:
    """NM21: df with name, gender, age and location from "name, gender, age, location, ..."."""
    parts = F.transform(F.split(F.col(column), ","), lambda x: F.trim(x))

    def at(i):
        return F.nullif(F.try_element_at(parts, F.lit(i)), F.lit(""))

    rest = F.nullif(F.array_join(F.when(F.size(parts) > 3, F.slice(parts, 4, 1000)), ", "), F.lit(""))
    return df.withColumns({"name": at(1), "gender": at(2), "age": at(3), "location": rest})


def intake_rows(df: DataFrame) -> DataFrame:
    """NM23: the second intake table: marks for missing people, found_state for found ones, ages as text."""
    v = _fields(df)
    return df.select(v("kind").alias("kind"), v("name").alias("full_name"), v("age").alias("age"), v("location").alias("location"), F.when(v("kind") == "missing", v("description")).alias("marks"), F.when(v("kind") == "found", v("description")).alias("found_state"), F.coalesce(v("photos").try_cast("int"), F.lit(0)).alias("photo_count"))


#: UD1: the registry of normalisers.
FEEDS = {
    "sheet": sheet, "hospital_api": hospital_api, "patients": patients, "document_table": document_table, "hospital_db": hospital_db, "located_list": located_list, "status_enum": status_enum,
    "status_list": status_list, "alias_feed": alias_feed, "community": community, "decoded_people": decoded_people, "tagged_tables": tagged_tables, "csv_people": csv_people, "cards": cards,
    "registry_people": registry_people, "registry_entries": registry_entries, "event_feed": event_feed, "legacy_people": legacy_people, "posts": posts, "chat_reports": chat_reports,
}


def normalize_all(raw: dict[str, DataFrame]) -> DataFrame:
    """The reports of several feeds, by the registry's names."""
    return reduce(lambda a, b: a.unionByName(b), (FEEDS[name](df) for name, df in raw.items()))
