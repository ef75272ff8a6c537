"""Links between missing and found reports: by identifier, text and face. Links are pending until people decide."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text
from .ann import CellIndex, build_index
from .upsert import checkpointed
from .vectors import knn_groups, knn_join


def _oriented(kind: Column, a: Column, b: Column) -> list[Column]:
    return [F.when(kind == "missing", a).otherwise(b).alias("missing_id"), F.when(kind == "missing", b).otherwise(a).alias("found_id")]


def _pending(df: DataFrame, phase: str) -> DataFrame:
    zero = F.lit(0.0)
    return df.select(
        "missing_id", "found_id", (F.col("score") if phase != "face" else zero).alias("text_score"), (F.col("score") if phase == "face" else zero).alias("face_score"), F.col("score").alias("combined_score"), F.lit("pending").alias("status"), F.lit(phase).alias("phase")
    )


def link_by_id(reports: DataFrame, mode: str = "equal") -> DataFrame:
    """JN1: pairs of a missing and a found report with one identifier, score 1.

    equal joins the identifiers that both state; token finds the found report's identifier as a whole number anywhere in
    the missing one's marks; substring finds it inside longer numbers as well. All are equi-joins: an identifier has 5 to 10
    digits, so it equals one of the stretches of these lengths in the numbers of the marks. Each distinct number is cut once,
    and only stretches that are identifiers go back to the reports. A column cedula, where there is one, is taken for the
    identifier."""
    identifier = F.col("cedula") if "cedula" in reports.columns else text.extract_id(F.col("distinguishing_marks"))
    found = reports.where("kind = 'found'").select(F.col("id").alias("found_id"), identifier.alias("n")).where("n is not null")
    m = reports.where("kind = 'missing'").select(F.col("id").alias("missing_id"), "distinguishing_marks")
    if mode == "equal":
        m = reports.where("kind = 'missing'").select(F.col("id").alias("missing_id"), identifier.alias("n")).where("n is not null")
    elif mode == "token":
        m = m.select("missing_id", F.explode(F.array_distinct(F.regexp_extract_all("distinguishing_marks", F.lit("(\\d+)")))).alias("n")).where("length(n) >= 5")
    elif mode == "substring":
        runs = m.select("missing_id", F.explode(F.array_distinct(F.regexp_extract_all("distinguishing_marks", F.lit("(\\d{5,})")))).alias("run"))
        sized = runs.select("run").distinct().withColumn("size", F.explode(F.sequence(F.lit(5), F.lit(10)))).where("size <= length(run)")
        parts = sized.select("run", F.explode(F.expr("array_distinct(transform(sequence(1, length(run) - size + 1), i -> substring(run, i, size)))")).alias("n"))
        m = runs.join(parts.join(found.select("n").distinct(), "n"), "run").select("missing_id", "n")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return _pending(m.join(found, "n").select("missing_id", "found_id", F.lit(1.0).alias("score")).distinct(), "id")


def _indexed(items: DataFrame, index_folder: str | None, name: str) -> DataFrame | CellIndex:
    """items themselves, or an index of them below the folder."""
    return items if index_folder is None else build_index(items, f"{index_folder}/{name}")


def link_by_text(reports: DataFrame, recall: float = 0.75, accept: float = 0.82, k: int = 10, index_folder: str | None = None) -> DataFrame:
    """JN2: each report's k nearest of the other kind by text vector, in both directions, from the accepted score on. With a
    new folder that driver and executors share, vectors are indexed there and only near cells are compared."""
    usable = reports.where("text_embedding is not null").where(~text.is_noise(F.col("full_name")))
    out = []
    for kind, other in (("missing", "found"), ("found", "missing")):
        q = usable.where(F.col("kind") == kind).select(F.col("id").alias("query_id"), F.col("text_embedding").alias("vector"))
        i = usable.where(F.col("kind") == other).select(F.col("id").alias("item_id"), F.col("text_embedding").alias("vector"))
        near = knn_join(q, _indexed(i, index_folder, f"text-{other}"), k, recall).where(F.col("score") >= accept)
        out.append(near.select(*_oriented(F.lit(kind), F.col("query_id"), F.col("item_id")), "score"))
    return _pending(out[0].unionByName(out[1]).groupBy("missing_id", "found_id").agg(F.max("score").alias("score")), "text")


def good_photos(photos: DataFrame, reports: DataFrame, kind: str | None = None) -> DataFrame:
    """JN5, PF7: photos of usable quality that have a vector, with their report's kind and source."""
    r = reports.select(F.col("id").alias("report_id"), "kind", "source", "source_url", "photo_url")
    out = photos.where("quality_ok and face_embedding is not null").join(r, "report_id")
    return out.where(F.col("kind") == kind) if kind else out


def unprocessed_photos(photos: DataFrame, prefix: str) -> DataFrame:
    """PF11: photos not known to be usable, below a path; an unknown quality counts as unprocessed."""
    return photos.where(~F.coalesce("quality_ok", F.lit(False)) & F.col("storage_path").startswith(prefix))


def face_neighbours(query_photos: DataFrame, item_photos: DataFrame, k: int = 10, recall: float = 0.5, per: str = "report", index_folder: str | None = None) -> DataFrame:
    """WN1: (query_report, item_report, query_photo, item_photo, score). With per='report' a report counts once among the
    k, by its best photo; with 'photo' the k are photos. With a new folder the items are indexed there."""
    q = query_photos.select(F.col("id").alias("query_id"), F.col("face_embedding").alias("vector"), F.col("report_id").alias("query_group"))
    i = item_photos.select(F.col("id").alias("item_id"), F.col("face_embedding").alias("vector"), F.col("report_id").alias("item_group"))
    i = _indexed(i, index_folder, "faces")
    if per == "report":
        near = knn_groups(q, i, k, recall)
        return near.select(F.col("query_group").alias("query_report"), F.col("item_group").alias("item_report"), F.col("query_id").alias("query_photo"), F.col("item_id").alias("item_photo"), "score")
    wide = knn_join(q, i, k, recall)
    named = wide.join(query_photos.select(F.col("id").cast("string").alias("query_id"), F.col("report_id").alias("query_report")), "query_id")
    named = named.join(item_photos.select(F.col("id").cast("string").alias("item_id"), F.col("report_id").alias("item_report")), "item_id").where("query_report <> item_report")
    best = F.struct(F.round("score", 9).alias("s"), F.col("query_id"), F.col("item_id"), F.col("score"))
    pairs = named.groupBy("query_report", "item_report").agg(F.max(best).alias("b"))
    return pairs.select("query_report", "item_report", F.col("b.query_id").alias("query_photo"), F.col("b.item_id").alias("item_photo"), F.col("b.score").alias("score"))


def link_by_face(reports: DataFrame, photos: DataFrame, recall: float = 0.5, accept: float = 0.65, k: int = 10, index_folder: str | None = None) -> DataFrame:
    """JN3: each missing report's k nearest found ones by face, from the accepted score on; index_folder as in JN2."""
    near = face_neighbours(good_photos(photos, reports, "missing"), good_photos(photos, reports, "found"), k, recall, index_folder=index_folder)
    return _pending(near.where(F.col("score") >= accept).select(F.col("query_report").alias("missing_id"), F.col("item_report").alias("found_id"), "score"), "face")


def link_new_photos(new: DataFrame, photos: DataFrame, reports: DataFrame, recall: float = 0.5, k: int = 10, near_hash: int = 8, index_folder: str | None = None) -> DataFrame:
    """JN4: links of new photos with reports of the other kind, flagged where the photos look like one re-hosted. The hash
    compared is the matched photo's; index_folder as in JN2."""
    out = []
    mine, theirs = good_photos(new, reports), good_photos(photos, reports)
    for kind, other in (("missing", "found"), ("found", "missing")):
        near = face_neighbours(mine.where(F.col("kind") == kind), theirs.where(F.col("kind") == other), k, recall, index_folder=index_folder and f"{index_folder}/{other}")
        out.append(near.withColumn("kind", F.lit(kind)))
    near = out[0].unionByName(out[1])
    side = [F.col(c) for c in ("phash", "source_url", "photo_url", "source")]
    a = mine.select(F.col("id").cast("string").alias("query_photo"), *(c.alias(f"a{i}") for i, c in enumerate(side)))
    b = theirs.select(F.col("id").cast("string").alias("item_photo"), *(c.alias(f"b{i}") for i, c in enumerate(side)))
    both = near.join(a, "query_photo").join(b, "item_photo")
    c = {f"{s}{i}": F.col(f"{s}{i}") for s in "ab" for i in range(4)}
    flag = text.same_photo(c["a1"], c["a2"], c["a3"], c["b1"], c["b2"], c["b3"]) | (text.hamming_hex(c["a0"], c["b0"]) <= near_hash)
    oriented = both.select(*_oriented(F.col("kind"), F.col("query_report"), F.col("item_report")), "score", F.coalesce(flag, F.lit(False)).alias("same_photo_suspected"))
    return oriented.groupBy("missing_id", "found_id").agg(F.max("score").alias("face_score"), F.max("same_photo_suspected").alias("same_photo_suspected"))


def hashing_featurizer(dim: int = 64):
    """PL5: a featurizer without a model: hashed words of a text, counted into dim components of unit length."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    count, norm = HashingTF(numFeatures=dim, inputCol="_words", outputCol="_counts"), Normalizer(inputCol="_counts", outputCol="_unit")

    def featurize(df: DataFrame) -> DataFrame:
        words = F.filter(F.split(text.deaccent(F.col("text")), "[^a-z0-9]+"), lambda w: w != "")
        out = norm.transform(count.transform(df.withColumn("_words", words)))
        return out.withColumn("vector", F.when(F.size("_words") > 0, vector_to_array("_unit"))).drop("_words", "_counts", "_unit")

    return featurize


def embed_reports(reports: DataFrame, featurizer=None) -> DataFrame:
    """PL5: reports with text_embedding filled where it is null and the name is of someone. featurizer adds a column vector
    to a DataFrame (id, text)."""
    if "text_embedding" not in reports.columns:
        reports = reports.withColumn("text_embedding", F.lit(None).cast("array<double>"))
    open_ = reports.where(F.col("text_embedding").isNull() & ~text.is_noise(F.col("full_name")))
    new = (featurizer or hashing_featurizer())(open_.select("id", text.text_for_embedding(F.col("full_name"), F.col("age"), F.col("distinguishing_marks")).alias("text")))
    out = reports.join(new.select("id", F.col("vector").alias("_v")), "id", "left")
    return out.withColumn("text_embedding", F.coalesce(F.col("text_embedding").cast("array<double>"), F.col("_v").cast("array<double>"))).drop("_v")


def first_phase(links: DataFrame, *phases: str) -> DataFrame:
    """PL6: one link for each pair: that of the earliest phase."""
    turn = reduce(lambda o, p: F.when(F.col("phase") == p[1], p[0]).otherwise(o), enumerate(phases), F.lit(len(phases)))
    return links.withColumn("_n", F.row_number().over(W.partitionBy("missing_id", "found_id").orderBy(turn, F.col("combined_score").desc()))).where("_n = 1").drop("_n")


def consolidate(reports: DataFrame, photos: DataFrame, existing: DataFrame | None = None, featurizer=None, text_accept: float = 0.82, face_accept: float = 0.65, index_folder: str | None = None) -> DataFrame:
    """PL6: links by identifier, then text, then face; a pair keeps its first, and pairs in existing stay out. index_folder
    as in JN2. Vectors are made once and held in the checkpoint folder."""
    ready = checkpointed(embed_reports(reports, featurizer).select("id", "kind", "full_name", "text_embedding"))
    by_text = link_by_text(ready, min(0.75, text_accept), text_accept, index_folder=index_folder)
    links = link_by_id(reports).unionByName(by_text).unionByName(link_by_face(reports, photos, min(0.5, face_accept), face_accept, index_folder=index_folder))
    links = first_phase(links, "id", "text", "face")
    return links if existing is None else links.join(existing.select("missing_id", "found_id"), ["missing_id", "found_id"], "left_anti")


def incremental_link(new: DataFrame, corpus: DataFrame, featurizer=None, recall: float = 0.75, accept: float = 0.82, k: int = 10, index_folder: str | None = None) -> DataFrame:
    """PL19: text links of new reports with those of the other kind in corpus; index_folder as in JN2."""
    fresh, old = embed_reports(new, featurizer), embed_reports(corpus, featurizer)
    out = []
    for kind, other in (("missing", "found"), ("found", "missing")):
        q = fresh.where((F.col("kind") == kind) & F.col("text_embedding").isNotNull()).select(F.col("id").alias("query_id"), F.col("text_embedding").alias("vector"))
        i = old.where((F.col("kind") == other) & F.col("text_embedding").isNotNull()).select(F.col("id").alias("item_id"), F.col("text_embedding").alias("vector"))
        out.append(knn_join(q, _indexed(i, index_folder, f"text-{other}"), k, recall).where(F.col("score") >= accept).select(*_oriented(F.lit(kind), F.col("query_id"), F.col("item_id")), "score"))
    # both directions may find a pair, with scores that differ in their last places
    return _pending(out[0].unionByName(out[1]).groupBy("missing_id", "found_id").agg(F.max("score").alias("score")), "text")


def cross_registry(results: DataFrame, reports: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PL20, PF9, JN17: (reports, matches) with strong external hits added. results: report_id, person_id, name, score,
    needs_review, strong_match. A hit that needs review yields nothing."""
    strong = results.where("not needs_review and strong_match")
    people = strong.select(F.concat(F.lit("x:"), "person_id").alias("id"), F.lit("found").alias("kind"), F.col("name").alias("full_name"), F.lit("registry").alias("source"), F.concat(F.lit("registry:"), "person_id").alias("source_url")).dropDuplicates(["id"])
    grown = reports.unionByName(people.join(reports.select("id"), "id", "left_anti"), allowMissingColumns=True)
    new = strong.select(F.col("report_id").alias("missing_id"), F.concat(F.lit("x:"), "person_id").alias("found_id"), F.col("score").alias("combined_score"), F.lit("pending").alias("status"))
    from .upsert import insert_matches

    return grown, insert_matches(matches, new.groupBy("missing_id", "found_id").agg(F.max("combined_score").alias("combined_score"), F.first("status").alias("status")))


def work_batch(df: DataFrame, cursor, ts: str = "created_at", key: str = "id", n_recent: int = 25, n_backlog: int = 60) -> DataFrame:
    """SC4: the newest rows and the oldest after the cursor, each once. The limits are the operator's purpose."""
    recent = df.orderBy(F.col(ts).desc(), key).limit(n_recent)
    backlog = df.where(F.col(ts) > F.lit(cursor)).orderBy(ts, key).limit(n_backlog)
    return recent.unionByName(backlog).dropDuplicates([key])


def incremental_batch(df: DataFrame, cursor, ts: str = "created_at", key: str = "id", limit: int = 1000) -> DataFrame:
    """SC3: the next rows after the cursor, in order."""
    return df.where(F.col(ts) > F.lit(cursor)).orderBy(ts, key).limit(limit)


def photo_backfill_worklist(reports: DataFrame, photos: DataFrame, cursor, n_recent: int = 25, n_backlog: int = 60) -> DataFrame:
    """PL21, JN8: recent and backlogged reports that have a photo address and no photo yet."""
    open_ = reports.where("photo_url is not null").join(photos.select(F.col("report_id").alias("id")).distinct(), "id", "left_anti")
    return work_batch(open_, cursor, n_recent=n_recent, n_backlog=n_backlog).select("id", "photo_url", "created_at")
