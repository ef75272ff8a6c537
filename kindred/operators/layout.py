"""Tables laid out for the joins and look-ups that recur: reports in buckets of their id, identifiers in buckets of the number,
and a kept index of names by their grams."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .dedup import blocks
from .upsert import checkpointed

#: Grams of names that are kept: those of these many letters.
SIZES = (1, 2, 3)


def _grams(c: Column, n: int) -> Column:
    """Parts of n letters; none of shorter texts."""
    at = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(c, i, n))


def _bucketed(df: DataFrame, folder: str, name: str, key: str, buckets: int, mode: str = "overwrite") -> DataFrame:
    """df as a table below folder in that many buckets of the key, each sorted by it. Rows are dealt out by the key before they
    are written, so a bucket is a file or, where one key has many rows, is written in one task after a sort that can spill."""
    table = f"{name}_{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}"
    df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/{name}").saveAsTable(table)
    return df.sparkSession.table(table)


@dataclass(frozen=True)
class ReportStore:
    """Reports, their matches and photos, written once for joins without an exchange of the reports: JN5, JN6 and JN7 meet
    reports by id, JN1 and PL1 meet them by identifier. Columns that joins are by are promoted: cedula, loc_canon and the
    block's first word.

    folder is shared by driver and executors and holds nothing else; buckets fit the reports' size, about 100 MB each."""

    spark: SparkSession
    folder: str
    buckets: int = 64

    def write_reports(self, reports: DataFrame) -> DataFrame:
        """All reports in buckets of their id, with cedula, loc_canon, first_word."""
        wide = reports.withColumns({"cedula": text.extract_id(F.col("distinguishing_marks")), "loc_canon": text.normalize_location(F.col("last_seen_location"))})
        first = blocks(reports).select("id", F.col("_first").alias("first_word"))
        return _bucketed(wide.join(first, "id", "left"), self.folder, "reports", "id", self.buckets)

    def write_identifiers(self, reports: DataFrame) -> DataFrame:
        """The reports that state an identifier, in buckets of it, with what PL1 ranks by."""
        known = reports.withColumn("cedula", text.extract_id(F.col("distinguishing_marks"))).where("cedula is not null")
        return _bucketed(known.select("id", "kind", "cedula", "age", "last_seen_location", "distinguishing_marks", "created_at"), self.folder, "identifiers", "cedula", self.buckets)

    def write_matches(self, matches: DataFrame, side: str) -> DataFrame:
        """Matches in buckets of one side's id (missing_id or found_id), of the same number as the reports'."""
        return _bucketed(matches, self.folder, f"matches_{side}", side, self.buckets)

    def write_photos(self, photos: DataFrame) -> DataFrame:
        """Photos in buckets of their report's id, of the same number as the reports'."""
        return _bucketed(photos, self.folder, "photos", "report_id", self.buckets)


@dataclass(frozen=True)
class NameIndex:
    """JN11, PL9, PL14: names by their grams, kept in buckets of the gram and added to. A gram's number of names is a count
    within its bucket, so neither it nor a look-up deals the index out anew."""

    spark: SparkSession
    folder: str
    buckets: int = 64

    def add(self, names: DataFrame) -> None:
        """Names (column name, as they will be looked for) that the index does not have yet."""
        new = names.select("name").where("name is not null").distinct()
        first = not self._there()
        if not first:
            # which are new is settled before anything is written
            new = checkpointed(new.join(self.names(), "name", "left_anti"))
        grams = F.array_distinct(F.flatten(F.array(*(_grams(F.col("name"), n) for n in SIZES))))
        mode = "overwrite" if first else "append"
        _bucketed(new.select(F.explode(grams).alias("gram"), "name"), self.folder, "grams", "gram", self.buckets, mode)
        # a run that failed here adds the same grams again: they are read as a set
        _bucketed(new, self.folder, "names", "name", self.buckets, mode)

    def _there(self) -> bool:
        return self.spark.catalog.tableExists(self._table("names"))

    def _table(self, name: str) -> str:
        return f"{name}_{uuid.uuid5(uuid.NAMESPACE_URL, self.folder).hex}"

    def names(self) -> DataFrame:
        return self.spark.table(self._table("names"))

    def grams(self) -> DataFrame:
        """(gram, name), each once."""
        return self.spark.table(self._table("grams")).groupBy("gram", "name").agg(F.lit(1).alias("one")).select("gram", "name")

    def containing(self, parts: DataFrame) -> DataFrame:
        """(part, name) wherever a name has a part (column part, of one letter or more) in it: by the part's rarest gram of
        the largest size that it has, then compared. Only the parts are dealt out."""
        index = self.grams()
        rarity = index.groupBy("gram").agg(F.count("*").alias("held"))
        size = F.least(F.length("part"), F.lit(max(SIZES)))
        own = F.transform(F.sequence(F.lit(1), F.length("part") - size + 1), lambda i: F.substring(F.col("part"), i, size))
        asked = parts.select("part").where("part <> ''").distinct().select("part", F.explode(F.array_distinct(own)).alias("gram"))
        rarest = asked.join(rarity, "gram").groupBy("part").agg(F.min(F.struct("held", "gram"))["gram"].alias("gram"))
        return rarest.join(index, "gram").where(F.col("name").contains(F.col("part"))).select("part", "name")
