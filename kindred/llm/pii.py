"""Personal data: base patterns, and further spans proposed by wide generators and chosen by boosted trees.

Base spans follow fixed patterns and checks and always stand. Besides, generators propose whatever looks like an e-mail
address, IP address, card or phone number in other spellings ("(at)", spaces, dots or dashes for separators, no plus
sign); proposals overlap freely. Boosted trees judge each by its format and its surroundings, and a threshold for each
kind, calibrated for precision on held-out candidates, selects.

The trees learn without labels by hand: base spans respelt in their own contexts are positive; proposals that fail a
kind's check, base spans with broken digits, other numbers, and prose such as "met at noon.Then" are negative. They are
fitted on the driver from bounded samples (parameter sample) of documents that can hold a candidate and, for each kind, of
documents that hold a base span of it, and have a fixed size. Thresholds come from the examples of all other documents, in
a Spark job that hands on a histogram.
"""

from __future__ import annotations

import bisect
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, boost
from ._words import short_batches, slices, text_buffer

#: No proposal under this probability is taken.
LEAST = 0.9
#: Cells of the calibration's histogram: bins a unit of the logit, and the logit beyond which examples share the last bin.
BINS = 128
#: Examples to fit on for each text of the sample.
EXAMPLES = 40
REACH = 32.0
KINDS = ("email", "ip", "card", "phone")
#: The base patterns, in forms that read a long run once: possessive where nothing that follows could take a character
#: back, and from the first digit of a run. E-mail addresses are found from their @ (see emails).
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AT, _DOT = r"(?:\s?[\(\[{]\s?at\s?[\)\]}]\s?|\sat\s|\s?@\s?)", r"(?:\s?[\(\[{]\s?dot\s?[\)\]}]\s?|\sdot\s|\.)"
WIDE = {
    "email": re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\))\s?[0-9]{1,3}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\s./_-]{0,2}[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9][\s().0-9/-]{6,22}[0-9](?![0-9A-Za-z])"),
}
_DIGITS = re.compile("[0-9]+")
_SIGN = re.compile(r"[\(\[{]\s?at\s?[\)\]}]|\sat\s|@")
#: A plain word, "at" and a name with plain dots: prose rather than an address.
_PROSE = re.compile(r"[A-Za-z]+\sat\s[A-Za-z0-9.-]+")
_SPELT = re.compile(r"[\(\[{]\s?(?:at|dot)\s?[\)\]}]|\sdot\s")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def holds(kind: str, found: str) -> bool:
    """Whether a match of a kind's base pattern is kept, but for e-mail addresses, which all are."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    digits = "".join(_DIGITS.findall(found))
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def emails(text: str):
    """(start, end) of the leftmost matches of a run of _LOCAL characters, @, and a host of two parts or more: a host is
    met first, then the run before it is walked back, at most to the match before."""
    last = 0
    for m in _HOST.finditer(text):
        a = m.start()
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            yield a, m.end()
            last = m.end()


class Cover:
    """Stretches of a text, merged where they overlap; finds by bisection whether one meets another."""

    def __init__(self, spans=()):
        self.start, self.end = [], []
        for a, b in sorted(spans):
            if self.end and a < self.end[-1]:
                self.end[-1] = max(self.end[-1], b)
            else:
                self.start.append(a)
                self.end.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect.bisect_right(self.end, a)
        return i < len(self.end) and self.start[i] < b

    def add(self, a: int, b: int) -> None:
        """Adds a stretch that meets none."""
        i = bisect.bisect_right(self.end, a)
        self.start.insert(i, a)
        self.end.insert(i, b)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the fixed patterns, in the order of kinds and then of starts; code points, end exclusive."""
    out = []
    for kind in KINDS:
        if kind == "email":
            out += [(kind, a, b) for a, b in emails(text)]
        elif kind != "phone" or "+" in text:
            out += [(kind, m.start(), m.end()) for m in BASE[kind].finditer(text) if holds(kind, m.group())]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the wide generators propose; spans of different kinds may overlap."""
    out = []
    for kind in KINDS:
        if kind == "email" and not _SIGN.search(text):
            continue
        out += [(kind, m.start(), m.end()) for m in WIDE[kind].finditer(text)]
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and what surrounds it."""
    span, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 24]
    groups = _DIGITS.findall(span)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    last = before[-1:] or " "
    next_ = after[:1] or " "
    tail = re.split(r"[.\s]", span)[-1]
    spelt = _SPELT.findall(span)
    return [
        *(float(kind == k) for k in KINDS),
        float(len(span)),
        float(len(digits)),
        float(len(groups)),
        float(sizes[0]),
        float(sizes[-1]),
        float(max(sizes)),
        float(min(sizes)),
        float(span.startswith("+")),
        float("(" in span),
        float(span.count("-")),
        float(span.count(".")),
        float(sum(c.isspace() for c in span)),
        float(kind == "card" and luhn(digits or "1")),
        float(kind == "ip" and len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float("@" in span),
        float(len(spelt)),
        float(kind == "email" and 2 <= len(tail) <= 6 and tail.isalpha()),
        float(last.isspace()),
        float(last in "=\"':(/"),
        float(last.isalnum()),
        float(next_.isalnum()),
        float(sum(c.isdigit() for c in before)),
        float(sum(c.isdigit() for c in after)),
        float(not before.strip()),
        float(bool(re.search(r"(?i)(tel|phone|call|mail|card|ip|contact)\W*$", before))),
    ]


def _respelt(kind: str, span: str, rng: np.random.Generator) -> tuple[str, bool]:
    """A base span in another spelling (true) or broken (false)."""
    digits = "".join(_DIGITS.findall(span))
    if kind == "email":
        name, _, host = span.partition("@")
        at, dot = [(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), (" at ", ".")][rng.integers(5)]
        return name + at + host.replace(".", dot), True
    if kind == "ip":
        parts = span.split(".")
        if rng.random() < 0.5:
            return ["[.]", " . "][rng.integers(2)].join(parts), True
        parts[rng.integers(4)] = str(rng.integers(256, 1000))
        return ".".join(parts), False
    if kind == "card":
        if rng.random() < 0.5:
            digits = digits[:-1] + str((int(digits[-1]) + rng.integers(1, 10)) % 10)
            return digits, False
        return [".", " - ", "/", "  "][rng.integers(4)].join(digits[i : i + 4] for i in range(0, len(digits), 4)), True
    if rng.random() < 0.5:
        d, m, y, h = rng.integers(1, 29), rng.integers(1, 13), rng.integers(1950, 2050), rng.integers(0, 24)
        tens = " ".join(str(10 * int(i)) for i in range(1, rng.integers(5, 9)))
        book = f"978-{digits[-9:-8]}-{digits[-8:-6]}-{digits[-6:]}-{digits[:1]}"
        wrong = (digits[-10:][: rng.integers(5, 11)], f"{d:02}/{m:02}/{y} {h:02}:{d:02}", f"{y}-{m:02}-{d:02} {h:02}:{d:02}", f"{y}-{y + 1} ({d})", tens, book)
        return wrong[rng.integers(len(wrong))], False
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits[:-10]} {a} {b} {c}"][rng.integers(4)], True


def _plausible(kind: str, span: str) -> bool:
    """Whether a proposal that no base span confirms could be right: such ones are no examples of either label."""
    groups = _DIGITS.findall(span)
    n = sum(map(len, groups))
    if kind == "ip":
        return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    if kind == "card":
        return luhn("".join(groups))
    if kind == "email":
        return not _PROSE.fullmatch(span)
    return 8 <= n <= 15 and len(groups) > 1


@dataclass
class Detector:
    trees: Trees
    thresholds: dict[str, float]

    def find(self, texts: list[str]) -> list[list[tuple[str, int, int, float, bool]]]:
        """(kind, start, end, probability, base) of every text; proposals that touch a base span or a likelier one go."""
        out, taken, rows, of = [], [], [], []
        for i, t in enumerate(texts):
            base = base_spans(t)
            out.append([(k, a, b, 1.0, True) for k, a, b in base])
            taken.append(Cover((a, b) for _, a, b in base))
            for k, a, b in candidates(t):
                if not taken[i].meets(a, b):
                    rows.append(features(t, k, a, b))
                    of.append((i, k, a, b))
        if rows:
            p = self.trees.probability(np.array(rows))
            for j in np.lexsort(([o[2] for o in of], -p)):
                i, k, a, b = of[j]
                if p[j] >= self.thresholds[k] and not taken[i].meets(a, b):
                    taken[i].add(a, b)
                    out[i].append((k, a, b, float(p[j]), False))
        order = {k: n for n, k in enumerate(KINDS)}
        return [sorted(x, key=lambda s: (order[s[0]], s[1])) for x in out]


def examples(text: str, seed: int) -> list[tuple[str, float, list[float]]]:
    """(kind, label, features): each base span gives respelt and broken examples in its context, other proposals negative
    ones. Depends on text and seed alone."""
    rng = np.random.default_rng([seed, zlib.crc32(text.encode())])
    out = []
    base = base_spans(text)
    for k, a, b in base:
        for _ in range(2):
            new, good = _respelt(k, text[a:b], rng)
            context = text[max(0, a - 40) : a] + new + text[b : b + 40]
            at = min(a, 40)
            for kind, s, e in candidates(context):
                if s < at + len(new) and at < e:
                    out.append((kind, float(good and kind == k and abs(s - at) <= 1 and abs(e - at - len(new)) <= 1), features(context, kind, s, e)))
    cover = Cover((a, b) for _, a, b in base)
    for k, a, b in candidates(text):
        if not cover.meets(a, b) and not _plausible(k, text[a:b]):
            out.append((k, 0.0, features(text, k, a, b)))
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Detector:
    """Trees from examples' features and labels; no kind adds spans before calibrate."""
    if not 0 < y.sum() < len(y):
        return Detector(Trees(np.zeros((1, 1), int), np.full((1, 1), np.inf), np.zeros((1, 2)), -9.0), dict.fromkeys(KINDS, 2.0))
    return Detector(boost(x, y), dict.fromkeys(KINDS, 2.0))


def calibrate(detector: Detector, texts: DataFrame, precision: float = 0.99, seed: int = 5) -> None:
    """Thresholds of kinds by the examples of all texts (a column text): the lowest at which what is taken reaches the
    precision. A kind that doesn't reach it, or has no examples, adds no spans. Spark hands on a histogram of fixed size."""
    shared = texts.sparkSession.sparkContext.broadcast(detector.trees)

    def count(batches):
        for piece, _, _ in slices(batches):
            some = piece.column(0).take(pa.array(np.flatnonzero(_likely(piece.column(0))))).to_pylist()
            found = [e for t in some for e in examples(t, seed)]
            if found:
                z = shared.value.logit(np.array([f for *_, f in found]))
                bins = np.floor(np.clip(z, -REACH, REACH) * BINS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, *_ in found]), pa.array(bins), pa.array([int(y) for _, y, _ in found]), pa.array(1 / (1 + np.exp(-z)))], ["kind", "bin", "good", "p"])

    cells = short_batches(texts.select("text")).mapInArrow(count, "kind string, bin long, good long, p double")
    got = cells.groupBy("kind", "bin").agg(F.sum("good").alias("good"), F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")).orderBy("kind", F.desc("bin")).toPandas()
    for k, rows in got.groupby("kind"):
        ok = np.flatnonzero((rows["good"].cumsum() / rows["n"].cumsum()).to_numpy() >= precision)
        if len(ok):
            # the middle between the last candidate taken and the next, but never less than LEAST
            below = rows["hi"].to_numpy()[ok[-1] + 1 : ok[-1] + 2].sum()
            detector.thresholds[k] = max(LEAST, float(rows["lo"].to_numpy()[ok[-1]] + below) / 2)


def train(docs: DataFrame, sample: int = 1500, seed: int = 5) -> Detector:
    """A detector fitted on at most sample texts that can hold a candidate and, for each kind, at most a quarter as many
    that hold a base span of it, those first by a hash of the text, and of these on at most EXAMPLES times sample examples.
    Tasks make the examples; texts don't reach the driver. Three tenths of all texts are never fitted on; thresholds come
    from them and whatever else was not."""
    texts = docs.where("text is not null").select(F.xxhash64("text", F.lit(seed)).alias("turn"), "text")

    def kinds(batches):
        for batch, _, _ in slices(batches):
            some = np.flatnonzero(_likely(batch.column(1)))
            turns, rows = batch.column(0).take(pa.array(some)).to_pylist(), batch.column(1).take(pa.array(some)).to_pylist()
            out = [(turn, kind) for turn, t in zip(turns, rows, strict=True) for kind in {"any", *(k for k, *_ in base_spans(t))}]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([k for _, k in out], pa.string())], ["turn", "kind"])

    held = F.pmod("turn", F.lit(10)) < 3
    held_by = short_batches(texts.where(~held)).mapInArrow(kinds, "turn long, kind string").distinct().persist()
    turns = {r.turn for kind in ("any", *KINDS) for r in held_by.where(F.col("kind") == kind).select("turn").orderBy("turn").limit(sample if kind == "any" else sample // 4).collect()}
    held_by.unpersist()
    # at most twice sample: a fixed bound
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in sorted(turns)], "turn long"))

    def show(batches):
        for piece, _, _ in slices(batches):
            out = [(turn, i, label, f) for turn, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True) for i, (_, label, f) in enumerate(examples(t, seed))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["turn", "i", "label", "features"])

    shown = texts.join(chosen, "turn").dropDuplicates(["turn"]).mapInArrow(show, "turn long, i long, label double, features array<double>")
    rows = shown.orderBy(F.xxhash64("turn", "i"), "turn", "i").limit(EXAMPLES * sample).toPandas()
    detector = fit(np.stack(rows["features"]) if len(rows) else np.zeros((0, 1)), rows["label"].to_numpy(np.float64))
    calibrate(detector, texts.join(chosen, "turn", "left_anti"), seed=seed)
    return detector


def _likely(column: pa.Array) -> np.ndarray:
    """Texts that can hold any candidate: those with a digit or @, and those the wide pattern of addresses matches."""
    data, off = text_buffer(column)
    mark = np.zeros(256, bool)
    mark[48:58] = mark[64] = True
    n = np.concatenate([[0], np.cumsum(mark[data], dtype=np.int64)])
    out = n[off[1:]] > n[off[:-1]]
    raw = data.tobytes()
    for i in np.flatnonzero(~out):
        t = raw[off[i] : off[i + 1]]
        if b"at" in t:
            t = t.decode()
            out[i] = bool(_SIGN.search(t) and WIDE["email"].search(t))
    return out


def pii_spans(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id and spans (array of kind, start, end, probability, base) of every row, in code points, end exclusive.

    Spans are ordered by kind (email, ip, card, phone), then start. Null and empty texts have none. Texts are read whole, a
    few megabytes or one text at a time, in time that follows their length. Rows that share a doc_id are returned one by
    one. Other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(detector)
    schema = "doc_id long, spans array<struct<kind:string,start:int,end:int,probability:double,base:boolean>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64()), ("base", pa.bool_())]))

    def find(batches):
        for batch, _, _ in slices(batches):
            some = np.flatnonzero(_likely(batch.column(1)))
            out: list = [[] for _ in range(batch.num_rows)]
            for i, found in zip(some, shared.value.find(batch.column(1).take(pa.array(some)).to_pylist()), strict=True):
                out[i] = [dict(zip(("kind", "start", "end", "probability", "base"), s, strict=True)) for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return short_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(find, schema)


def redact(docs: DataFrame, detector: Detector) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, such as [EMAIL]; n_chars follows if there is one.

    Spans that overlap are merged and take the first one's kind. Texts without spans, nulls and all other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(detector)
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def replace(batches):
        for batch, _, _ in slices(batches):
            column = batch.column(at)
            some = np.flatnonzero(_likely(column))
            texts = column.take(pa.array(some)).to_pylist()
            new = {}
            for i, t, found in zip(some, texts, shared.value.find(texts), strict=True):
                if found:
                    parts, done = [], 0
                    for k, a, b, *_ in sorted(found, key=lambda s: (s[1], -s[2])):
                        if a >= done:
                            parts += [t[done:a], f"[{k.upper()}]"]
                        done = max(done, b)
                    new[int(i)] = "".join([*parts, t[done:]])
            columns = list(batch.columns)
            if new:
                rows = column.to_pylist()
                for i, t in new.items():
                    rows[i] = t
                columns[at] = pa.array(rows, column.type)
                if size is not None:
                    n = columns[size].to_pylist()
                    for i, t in new.items():
                        n[i] = len(t)
                    columns[size] = pa.array(n, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return short_batches(docs).mapInArrow(replace, docs.schema)
