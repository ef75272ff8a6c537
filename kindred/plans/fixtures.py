"""Entities derived from the driver's tables, as SQL that Spark and DuckDB both read: {name} is a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_GIVEN = "José,María,Yajaira,Llajaira,Beltrán,Karina,Vanesa,Vannessa,Luis,Hugo,Menor,Ana"
_FAMILY = "González,Gonsales,Pérez,Rodríguez,Quintero,Chávez,Muñoz"
_PLACE = "Maiquetía, Vargas|Ciudad Bolívar|Petare Caracas|Los Teques|Valencia Edo. Carabobo|Otro Sitio|"
_MARKS = "herida leve|a salvo, herido|cicatriz en la mano|Refugio Norte; camisa azul|localizado con vida|"


def _name(k: str) -> str:
    return f"concat(split_part('{_GIVEN}', ',', CAST(1 + ({k}) % 12 AS INT)), ' ', split_part('{_FAMILY}', ',', CAST(1 + FLOOR(({k}) / 12) % 7 AS INT)))"


def _report(k: str, kind: str, pre: str, nat: str, source: str, ident: str) -> str:
    return f"""SELECT concat('{pre}', CAST({k} AS STRING)) AS id, '{kind}' AS kind, {_name(k)} AS full_name,
CAST(CASE WHEN {k} % 17 = 0 THEN NULL ELSE {k} % 90 + 1 END AS INT) AS age,
NULLIF(split_part('{_PLACE}', '|', CAST(1 + ({k} + {nat}) % 7 AS INT)), '') AS last_seen_location,
concat({ident}, CASE WHEN split_part('{_MARKS}', '|', CAST(1 + {k} % 6 AS INT)) = '' THEN '' ELSE concat(' | ', split_part('{_MARKS}', '|', CAST(1 + {k} % 6 AS INT))) END) AS distinguishing_marks,
{source} AS source, concat('src:', CAST({k} AS STRING), 'x000000') AS source_url,
CASE WHEN {k} % 4 = 0 THEN NULL ELSE concat('https://img.example.org/', {source}, '/', CAST({k} AS STRING), 'x000000.jpg') END AS photo_url,
CAST(1700000000 + ({k} * 7919) % 500000 AS BIGINT) AS created_at"""


REPORTS = (
    _report("c_custkey", "missing", "m", "c_nationkey", "CASE WHEN c_custkey % 50 = 7 THEN 'private_chat' ELSE lower(c_mktsegment) END", "concat('CI: ', CAST(10000000 + c_custkey % 1200 AS STRING))")
    + " FROM {customer} UNION ALL "
    + _report("s_suppkey", "found", "f", "s_nationkey", "concat('hospital_', CAST(s_nationkey % 5 AS STRING))", "concat('ci ', CAST(10000000 + s_suppkey * 3 AS STRING), ' tel 0412-555-', CAST(1000 + s_suppkey % 9000 AS STRING))")
    + " FROM {supplier}"
)

PHOTOS = """SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 2 = 0 THEN concat('m', CAST(FLOOR(vec_id / 4) AS BIGINT)) ELSE concat('f', CAST(FLOOR(vec_id / 8) AS BIGINT)) END AS report_id,
concat('scraped/', CAST(vec_id AS STRING), '.jpg') AS storage_path, embedding AS face_embedding, CASE WHEN vec_id % 13 = 0 THEN NULL ELSE vec_id % 11 <> 0 END AS quality_ok,
concat(substr(md5(CAST(CAST(FLOOR(vec_id / 10) AS BIGINT) AS STRING)), 1, 15), substr('0123456789abcdef', CAST(1 + vec_id % 16 AS INT), 1)) AS phash FROM {embeddings}"""

#: Candidate links: orders stand for scored pairs.
MATCHES = """SELECT o_orderkey AS id, concat('m', CAST(o_custkey AS STRING)) AS missing_id, concat('f', CAST(o_orderkey % (SELECT count(*) FROM {supplier}) AS STRING)) AS found_id,
CAST(FLOOR(o_totalprice) % 1000 AS DOUBLE) / 1000 AS combined_score, CASE WHEN o_orderkey % 3 = 0 THEN CAST(FLOOR(o_totalprice) % 100 AS DOUBLE) / 100 ELSE 0.0 END AS face_score,
CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'confirmed' ELSE 'dismissed' END AS status, o_orderkey % 29 = 0 AS same_photo_suspected, o_orderkey % 5 = 0 AS notify_sent,
CASE o_orderkey % 37 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS family_ack, CAST(1700000000 + o_orderkey % 400000 AS BIGINT) AS created_at FROM {orders}"""

DECISIONS = """SELECT CAST(doc_id AS BIGINT) AS match_id, CASE WHEN toxic = 1 THEN 'found' WHEN quality = 1 THEN 'confirmed' ELSE 'rejected' END AS decision, CAST(1700500000 + doc_id AS BIGINT) AS decided_at FROM {labels}"""

SUBSCRIBERS = """SELECT concat('m', CAST(c_custkey AS STRING)) AS report_id, concat('04125550', CAST(c_custkey AS STRING)) AS phone, CASE WHEN c_custkey % 4 = 0 THEN CAST(1700490000 + c_custkey AS BIGINT) WHEN c_custkey % 4 = 1 THEN 1700000000 END AS last_notified_at
FROM {customer} WHERE c_custkey % 5 < 3 UNION ALL SELECT concat('f', CAST(s_suppkey AS STRING)), concat('04145550', CAST(s_suppkey AS STRING)), NULL FROM {supplier} WHERE s_suppkey % 5 = 0"""


ENTITIES = {"reports": REPORTS, "photos": PHOTOS, "matches": MATCHES, "decisions": DECISIONS, "subscribers": SUBSCRIBERS}


def duck(name: str) -> str:
    """The entity's SQL for DuckDB."""
    return ENTITIES[name].format(**{t: t for t in TABLES})


def duck_with(*names: str) -> str:
    """A WITH clause that defines the entities for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({duck(n)})" for n in names)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables or of the entities derived from them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = ENTITIES[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one where that is unset in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    return f"{base or tempfile.mkdtemp(prefix='spark-stream-')}/{uuid.uuid4().hex}"
