"""Spanish-language names, places, identifiers and free text as Column expressions: no Python runs on the executors."""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def unaccented(c: str) -> str:
    """A text without its letters' marks."""
    return "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")


#: Lower-case letters of all scripts with marks, and what they are without: one letter each. Marks that stand by themselves
#: are removed; Hangul syllables, which have no marks, stay whole.
ACCENTED = "".join(c for c in map(chr, range(0xC0, sys.maxunicode + 1)) if unicodedata.decomposition(c) and c == c.lower() and unaccented(c) != c and len(unaccented(c)) == 1)
PLAIN = "".join(map(unaccented, ACCENTED))

#: Place synonyms by canonical place (fixed values).
PLACES = {
    "la guaira": ("la guaira", "vargas", "edo vargas", "estado vargas", "litoral central", "litoral", "maiquetia", "catia la mar", "macuto", "caraballeda", "naiguata", "carayaca", "tanaguarena", "los corales"),
    "caracas": ("caracas", "ccs", "distrito capital", "dtto capital", "dc", "libertador", "petare", "catia", "el valle", "antimano"),
    "miranda": ("miranda", "edo miranda", "los teques", "guarenas", "guatire", "charallave", "santa teresa", "higuerote"),
    "amazonas": ("amazonas",),
    "anzoategui": ("anzoategui", "puerto la cruz", "barcelona"),
    "apure": ("apure", "san fernando de apure"),
    "aragua": ("aragua", "maracay", "la victoria"),
    "barinas": ("barinas",),
    "bolivar": ("bolivar", "ciudad guayana", "ciudad bolivar", "puerto ordaz"),
    "carabobo": ("carabobo", "valencia", "puerto cabello"),
    "cojedes": ("cojedes", "san carlos"),
    "delta amacuro": ("delta amacuro", "tucupita"),
    "falcon": ("falcon", "coro", "punto fijo"),
    "guarico": ("guarico", "san juan de los morros", "calabozo"),
    "lara": ("lara", "barquisimeto", "carora"),
    "merida": ("merida", "el vigia"),
    "monagas": ("monagas", "maturin"),
    "nueva esparta": ("nueva esparta", "margarita", "porlamar"),
    "portuguesa": ("portuguesa", "guanare", "acarigua"),
    "sucre": ("sucre", "cumana", "carupano"),
    "tachira": ("tachira", "san cristobal"),
    "trujillo": ("trujillo", "valera"),
    "yaracuy": ("yaracuy", "san felipe"),
    "zulia": ("zulia", "maracaibo", "cabimas"),
}

#: Stems that tell a person's state (fixed values).
DECEASED = ("fallecid", "muert", "deceased", "occiso")
INJURED = ("herid", "lesionad", "hospital", "injured", "rescatad", "atrapad")
SAFE = ("a salvo", "encontrad", "localizad", "found", "safe", "vivo", "con vida")

#: Names that stand for no one in particular, also as beginnings (fixed values).
GENERIC_NAMES = (
    "menor reportado", "femenino sin identificar", "masculino sin identificar", "menor sin identificar", "sin identificar", "desconocido", "desconocida",
    "persona sin identificar", "nn", "n.n.", "n/n", "menor", "paciente sin identificar", "paciente desconocido", "femenino", "masculino",
)

#: What a reply must not say (fixed values).
REPLY_DEATH = (
    "fallec", "muert", "occiso", "difunt", "deceased", "deces", "sin vida", "no sobrevivi", "no logro sobrevivi", "perdio la vida", "perdieron la vida",
    "su perdida", "en paz descanse", "qepd", "q.e.p.d", "no esta con nosotros",
)
REPLY_CERTAIN = (
    "a salvo", "sano y salvo", "con vida", "esta vivo", "esta viva", "dado de baja", "dada de baja", "es el mismo", "es la misma", "es tu familiar", "es tu hijo",
    "es tu hija", "es seguro", "con certeza", "te aseguro", "garantiz", "100% seguro",
)
REPLY_FOUND = ("encontram", "localizam", "lo encontr", "la encontr", "encontrad", "localizad", "hallad", "hallaron", "aparecio")
REPLY_HEDGE = "posible coincidencia"

#: Keys of a raw record that hold personal data (fixed values).
PII_KEYS = ("cedula", "cedula_masked", "contacto", "telefono", "phone", "email", "direccion", "direccion_exacta", "numero_contacto")
PHOTO_KEYS = ("foto_url", "photoUrl", "photo_url", "foto", "image_url", "imageUrl")

#: Phone numbers and identifiers in free text, and clauses that only say where someone is (fixed values).
PHONE_PATTERN = r"(?:\+?58[-\s]?)?0?4\d{2}[-\s]?\d{3}[-\s]?\d{4}"
ID_PATTERN = r"(?<!\d)(?:[VvEeJjGg][-.\s]?)?\d{1,2}[.\s]?\d{3}[.\s]?\d{3}(?!\d)|(?<!\d)\d{6,9}(?!\d)"
PLACE_CLAUSE = r"(?iu)(?:Refugio[^;–]*|Damnificados[^;–]*|Campo\s+de\s+Golf\b[^;–]*|Centro\s+de\s+Acopio\b[^;–]*|Piso\s+\S+.*?Cama\s*#?\d+[^;–]*|[–\-]\s*(?:La\s+Guaira|Vargas|Carab[a-záéíóú]{2,}|Catia|Playa\s+Grande|Tanaguarena)[^;]*)"

def any_of(c: Column, stems: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, (c.contains(s) for s in stems))


def let(c: Column, fn) -> Column:
    """fn of a value that is worked out once, however often fn uses it."""
    return F.element_at(F.transform(F.array(c), lambda v: fn(v)), 1)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_of(*cols: Column) -> Column:
    """FN41: the first value that is not blank, trimmed."""
    return F.coalesce(*(blank_to_null(c.cast("string")) for c in cols))


def deaccent(c: Column) -> Column:
    """FN1: lower case without accents or other marks. Null becomes the empty text."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED, PLAIN), "\\p{Mn}+", "")


def place_rules() -> list[tuple[str, str]]:
    """(synonym, place), longest synonym first, then in the order of PLACES."""
    pairs = [(s, place) for place, names in PLACES.items() for s in names]
    return sorted(pairs, key=lambda p: -len(p[0]))


def clean_place(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(deaccent(c), "[^a-z0-9 ]+", " "), "\\s+", " ")), F.lit(""))


def normalize_location(c: Column) -> Column:
    """FN2: canonical place of the longest synonym contained, else the cleaned text; null where blank."""

    def place(d):
        out = F.when(d.isNull(), F.lit(None).cast("string"))
        for synonym, name in place_rules():
            out = out.when(d.contains(synonym), name)
        return out.otherwise(d)

    return let(clean_place(c), place)


def location_score(a: Column, b: Column) -> Column:
    """FN3, of canonical places: 0.5 if either is unknown, 1 if equal, 0.7 if they share a word, else 0."""
    a, b = F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))
    shared = F.arrays_overlap(F.split(a, " "), F.split(b, " "))
    return F.when(a.isNull() | b.isNull(), 0.5).when(a == b, 1.0).when(shared, 0.7).otherwise(0.0)


def phonetic_token(c: Column) -> Column:
    """FN4: the sound of a word; spellings that sound alike in Spanish become equal."""
    t = F.regexp_replace(deaccent(c), "[^a-z]", "")
    for old, new in (("ch", "x"), ("qu", "k"), ("gue", "ge"), ("gui", "gi"), ("ll", "y"), ("h", ""), ("v", "b")):
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.regexp_replace(t, "z|c(?=[ei])", "s")
    t = F.replace(t, F.lit("c"), F.lit("k"))
    t = F.regexp_replace(t, "g(?=[ei])", "j")
    t = F.translate(t, "wy", "bi")
    return F.regexp_replace(t, "(.)\\1+", "$1")


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), "\\s+"), lambda t: t != "")


def _sounds(c: Column) -> Column:
    return F.filter(F.transform(tokens(c), phonetic_token), lambda t: F.length(t) >= 2)


def phonetic_key(c: Column) -> Column:
    """FN5: sounds of a name's words in alphabetical order."""
    return F.array_join(F.array_sort(_sounds(c)), " ")


def phonetic_tokens(c: Column) -> Column:
    """FN6: the distinct sounds of a name's words, sorted."""
    return F.array_sort(F.array_distinct(_sounds(c)))


def status_rank(kind: Column, marks: Column) -> Column:
    """FN7: deceased 5, found 4, injured 3, missing 2, unknown 1."""
    found = kind.eqNullSafe("found")
    return let(
        deaccent(marks),
        lambda m: F.when(any_of(m, DECEASED), 5)
        .when(any_of(m, SAFE) | found, F.when(any_of(m, INJURED) & ~found, 3).otherwise(4))
        .when(any_of(m, INJURED), 3)
        .when(kind == "missing", 2)
        .otherwise(1),
    )


def completeness(age: Column, location: Column, marks: Column) -> Column:
    """FN8: 10 for an age, 5 for a place, and the length of the marks up to 200."""
    return F.when(age.isNotNull(), 10).otherwise(0) + F.when(F.coalesce(location, F.lit("")) != "", 5).otherwise(0) + F.least(F.length(F.coalesce(marks, F.lit(""))), F.lit(200))


def extract_id(c: Column) -> Column:
    """FN9: digits of the first "CI: 12345678"."""
    return F.nullif(F.regexp_extract(c, "(?i)CI[:\\s]+(\\d{5,10})", 1), F.lit(""))


def id_digits(c: Column) -> Column:
    """FN10: all digits, if there are 5 to 10."""
    d = F.regexp_replace(c, "\\D", "")
    return F.when(F.length(d).between(5, 10), d)


def has_number(text: Column, digits: Column) -> Column:
    """FN11: whether the digits stand in the text as a whole number."""
    return F.coalesce(F.array_contains(F.regexp_extract_all(text, F.lit("(\\d+)")), digits), F.lit(False))


def clean_marks(c: Column) -> Column:
    """FN12: marks without clauses that only say where someone is."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), PLACE_CLAUSE, ""), ";\\s*;", ";")
    return F.trim(F.regexp_replace(t, "^[;\\s]+|[;\\s]+$", ""))


def text_for_embedding(name: Column, age: Column, marks: Column) -> Column:
    """FN13: name, age and cleaned marks, entities resolved and white space collapsed; the place is left out."""
    t = F.concat_ws(" ", F.nullif(name, F.lit("")), F.concat(age.cast("string"), F.lit(" años")), F.nullif(clean_marks(marks), F.lit("")))
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(t, "\\s+", " "))


def strip_pii(m: Column) -> Column:
    """FN14: a map without the keys that hold personal data, in any case."""
    return F.map_filter(m, lambda k, v: ~F.lower(k).isin(*PII_KEYS))


def mask_pii(c: Column) -> Column:
    """FN15: struct of masked text, and the digits of the last ID and the last phone number in it."""
    text = F.coalesce(c, F.lit(""))
    once = F.regexp_replace(text, PHONE_PATTERN, "[TELEFONO]")
    contact = F.try_element_at(F.regexp_extract_all(text, F.lit(f"({PHONE_PATTERN})")), F.lit(-1))
    cedula = F.try_element_at(F.regexp_extract_all(once, F.lit(f"({ID_PATTERN})")), F.lit(-1))
    return F.struct(F.regexp_replace(once, ID_PATTERN, "[CEDULA]").alias("masked"), F.regexp_replace(cedula, "\\D", "").alias("cedula"), F.regexp_replace(contact, "\\D", "").alias("contact"))


def parse_age(c: Column, most: int = 119) -> Column:
    """FN16: the first number of up to three digits, if it is an age."""
    n = F.regexp_extract(c, "\\b(\\d{1,3})\\b", 1).try_cast("int")
    return F.when(n.between(1, most), n)


def parse_neighborhood(c: Column) -> Column:
    """FN17: what follows the first - or |."""
    return blank_to_null(F.regexp_extract(c, "[-|]\\s*(.+)$", 1))


def parse_gps(c: Column) -> Column:
    """FN18: struct of lat and lng from "... GPS: 10.5, -66.9"."""
    p = "GPS:\\s*(-?\\d+(?:\\.\\d+)?)\\s*,\\s*(-?\\d+(?:\\.\\d+)?)"
    return F.struct(*(F.regexp_extract(c, p, i).try_cast("double").alias(n) for i, n in ((1, "lat"), (2, "lng"))))


def name_variants(c: Column) -> Column:
    """FN19: ways to search a name: as it is, reversed, last word, first word; of 3 letters or more, each once."""
    clean = F.trim(c)
    parts = tokens(clean)
    several = F.when(F.size(parts) >= 2, F.array(F.array_join(F.reverse(parts), " "), F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(F.array(clean), several), lambda v: F.length(v) >= 3))


def resolve_url(source: Column, source_url: Column, roots: dict[str, str], pages: dict[str, str] | None = None) -> Column:
    """FN20: an openable address. Web addresses stand, unless their source has a root in roots; a key "scheme:id" becomes
    its source's page in pages with {id} filled in, or its source's root; else null."""
    ident = F.when(source_url.contains(":"), F.regexp_extract(source_url, "^[^:]*:(.*)$", 1)).otherwise(source_url)
    out = F.when(source_url.startswith("http"), source_url)
    for name, page in (pages or {}).items():
        out = F.when((source == name) & ~source_url.startswith("http"), F.replace(F.lit(page), F.lit("{id}"), ident)).otherwise(out)
    for name, root in roots.items():
        out = F.when(source == name, root).otherwise(out)
    return F.when(F.coalesce(source_url, F.lit("")) != "", out)


def source_label(source: Column, labels: dict[str, str], unknown: str = "fuente externa") -> Column:
    """FN21: a source's label, else the source itself."""
    known = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)) if labels else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(known, source), F.nullif(source, F.lit("")), F.lit(unknown))


def photo_url(raw: Column, source: Column, bases: dict[str, str] | None = None) -> Column:
    """FN22, raw being a map: the first usable photo address; a path needs its source's base."""
    base = source_label(source, bases or {}, "")
    at = [F.trim(F.try_element_at(raw, F.lit(k))) for k in PHOTO_KEYS]
    known = source.isin(*(bases or {"": ""}))
    return F.coalesce(*(F.when(v.startswith("http"), v).when(v.startswith("/") & known, F.concat(base, v)) for v in at))


def has_photo(raw: Column) -> Column:
    """FN23: whether a raw map has any photo key with a value."""
    return reduce(lambda x, y: x | y, (F.try_element_at(raw, F.lit(k)).isNotNull() for k in ("foto_url", "photoUrl", "photo_url", "imageUrl")))


def pseudonym(c: Column, n: int = 10, prefix: str = "ph_") -> Column:
    """FN24: the first hexadecimal digits of a SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, n))


def is_noise(name: Column) -> Column:
    """FN25: an event, or a name that begins like those of no one in particular."""
    return let(F.trim(F.lower(F.coalesce(name, F.lit("")))), lambda n: reduce(lambda x, y: x | y, (n.startswith(p) for p in ("evento:", *GENERIC_NAMES))))


def classify_reply(c: Column) -> Column:
    """FN26: 'hedge' for a reply that speaks of death, is certain, or says found without the hedging phrase."""
    bad = let(deaccent(c), lambda d: any_of(d, REPLY_DEATH) | any_of(d, REPLY_CERTAIN) | (~d.contains(REPLY_HEDGE) & any_of(d, REPLY_FOUND)))
    return F.when(bad, "hedge").otherwise("keep")


def format_line(name: Column, age: Column, location: Column, label: Column, url: Column) -> Column:
    """FN27: a candidate in one line, with its address below if there is one."""
    head = F.concat(F.lit("• "), F.coalesce(F.nullif(name, F.lit("")), F.lit("Desconocido")), F.when(age > 0, F.concat(F.lit(", "), age.cast("string"), F.lit(" años"))).otherwise(""))
    line = F.concat(head, F.lit(" — "), F.coalesce(F.nullif(location, F.lit("")), F.lit("ubicación por confirmar")), F.lit(" ["), label, F.lit("]"))
    return F.concat(line, F.coalesce(F.concat(F.lit("\n  "), url), F.lit("")))


def render(template: Column, values: dict[str, Column]) -> Column:
    """FN27: a template's {name|default} and {name} filled in; an unknown name takes its default or nothing."""
    out = template
    for name, v in values.items():
        filled = F.nullif(v.cast("string"), F.lit(""))
        default = F.regexp_extract(template, "\\{" + name + "\\|([^}]*)\\}", 1)
        # a replacement's \ and $ are literal
        quoted = F.regexp_replace(F.coalesce(filled, default), "([\\\\$])", "\\\\$1")
        out = F.regexp_replace(out, F.lit("\\{" + name + "(\\|[^}]*)?\\}"), quoted)
    return F.regexp_replace(out, "\\{[A-Za-z_]+\\|?([^}]*)\\}", "$1")


def same_photo(a_url: Column, a_photo: Column, a_source: Column, b_url: Column, b_photo: Column, b_source: Column, aliases: dict[str, tuple[str, ...]] | None = None) -> Column:
    """FN28: whether two photos look like one re-hosted: one's record id (8 characters or more, no /) or source folder
    is part of the other's path."""

    def ident(url, photo):
        token = F.try_element_at(F.split(F.coalesce(url, F.lit("")), ":"), F.lit(-1))
        return (F.length(token) >= 8) & ~token.contains("/") & photo.contains(token)

    def folder(source, photo):
        named = photo.contains(F.concat(F.lit("/"), source, F.lit("/")))
        for name, others in (aliases or {}).items():
            hit = reduce(lambda x, y: x | y, (photo.contains(f"/{o}/") for o in others))
            named = F.when(source == name, hit).otherwise(named)
        return F.coalesce((source != "") & named, F.lit(False))

    hit = ident(a_url, b_photo) | ident(b_url, a_photo) | folder(a_source, b_photo) | folder(b_source, a_photo)
    return F.coalesce((a_photo != "") & (b_photo != "") & hit, F.lit(False))


def hamming_hex(a: Column, b: Column) -> Column:
    """FN29: differing bits of two 16-digit hashes; 999 where either is missing or malformed."""
    good = a.rlike("^[0-9a-fA-F]{1,16}$") & b.rlike("^[0-9a-fA-F]{1,16}$")
    a, b = F.lpad(a, 16, "0"), F.lpad(b, 16, "0")

    def half(i):
        x, y = (F.conv(F.substring(c, i, 8), 16, 10).cast("long") for c in (a, b))
        return F.bit_count(x.bitwiseXOR(y))

    return F.when(good, half(1) + half(9)).otherwise(999)


def normalize_message(c: Column) -> Column:
    """FN38: a message's letters, digits and white space, in lower case without accents."""
    return F.trim(F.regexp_replace(deaccent(c), "[^a-z0-9\\s]", ""))


def safe_url(c: Column) -> Column:
    """FN37: https, and no loopback or private address as host."""
    host = F.lower(F.coalesce(F.try_parse_url(c, F.lit("HOST")), F.lit("")))
    private = host.rlike(r"^(localhost|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|0\..*|\[?::1\]?)$")
    return F.coalesce(c.startswith("https://") & (host != "") & ~private, F.lit(False))
