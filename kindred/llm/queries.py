"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    """Registers a query under its function's name."""
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_ngram_jaccard_join(spark, sf_dir):
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


@query
def op6_substring_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    from .substring_dedup import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op1_pii_boosting(spark, sf_dir):
    from pyspark.sql import functions as F

    from .pii import KINDS, pii_spans, train

    docs = table(spark, sf_dir, "documents")
    found = pii_spans(docs, train(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


#: (verdict, host, path): the longest that fits decides.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@query
def op2_url_language_models(spark, sf_dir):
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op3_embedding_near_dedup(spark, sf_dir):
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


@query
def op5_toxicity_cnn(spark, sf_dir):
    from pyspark.sql import functions as F

    from .toxicity import fold, toxicity, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.3).cast("int").alias("predicted"), F.col("toxicity_threshold").alias("lang_threshold"), "toxic_rejected"
    )


@query
def op7_benchmark_decontamination(spark, sf_dir):
    from pyspark.sql import functions as F

    from .decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op8_source_mixing(spark, sf_dir):
    from pyspark.sql import functions as F

    from .mixing import mix

    out = mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken", F.coalesce("first_slot", F.lit(-1).cast("long")).alias("first_slot"), "n_stretches")


def crawl_records(pages):
    """pages as WARC records: two responses to one revisit, with times, validators and headers that follow from page_id."""
    from pyspark.sql import functions as F

    revisit = F.col("page_id") % 3 == 0
    ts = F.lit(1_700_000_000) + (F.col("page_id") * 7919) % 1_000_003
    tag = F.concat(F.when(F.col("page_id") % 2 == 0, "W/").otherwise(""), F.lit('"v'), F.floor(ts / 200_000).cast("string"), F.lit('"'))
    headers = F.map_from_arrays(
        F.array(*(F.lit(x) for x in ("ETag", "Last-Modified", "Date", "Content-Type", "Cache-Control"))),
        F.array(
            F.when(F.col("page_id") % 5 != 0, tag),
            F.when(F.col("page_id") % 7 != 0, F.concat(F.lit("m"), F.floor(ts / 400_000).cast("string"))),
            F.concat(F.lit("d"), ts.cast("string")),
            F.when(revisit, "text/plain").otherwise("text/html"),
            F.when(revisit, F.concat(F.lit("max-age="), (F.col("page_id") % 60).cast("string"))),
        ),
    )
    return pages.select(F.col("page_id").alias("record_id"), "url", ts.alias("ts"), F.when(revisit, "revisit").otherwise("response").alias("kind"), F.map_filter(headers, lambda k, v: v.isNotNull()).alias("headers"), "html")


@query
def op9_warc_revisits(spark, sf_dir):
    from pyspark.sql import functions as F

    from .warc import resolve_revisits

    out = resolve_revisits(crawl_records(table(spark, sf_dir, "pages")), body="html")
    merged = F.array_join(F.transform(F.array_sort(F.map_entries("merged")), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    return out.select("record_id", "canonical_url", "ts", "kind", "outcome", "resolved_id", merged.alias("merged"), F.md5("html").alias("body_md5"))


@query
def op10_token_lengths(spark, sf_dir):
    from .token_lengths import encoded_lengths, length_report

    return length_report(encoded_lengths(table(spark, sf_dir, "documents")))


@query
def op11_token_files(spark, sf_dir):
    from pyspark.sql import functions as F

    from .token_files import decode, new_folder, write_tokens

    docs = table(spark, sf_dir, "documents")
    folder = new_folder(docs)
    write_tokens(docs, folder)
    return decode(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op12_source_divergence(spark, sf_dir):
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"), least_docs=3, ranks=200)


@query
def op13_tokenizer_alignment(spark, sf_dir):
    from .alignment import alignment_report

    return alignment_report(table(spark, sf_dir, "documents"))


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_REACH = """
reach(u, v) AS (SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u),
"""

ORACLE_SQL["op3_embedding_near_dedup"] = f"""
WITH RECURSIVE x AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
edges AS (SELECT a.vec_id AS u, b.vec_id AS v FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
{_REACH}
c AS (SELECT u, min(v) AS low FROM reach GROUP BY u), n AS (SELECT u, count(*) AS n FROM edges GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id
"""

ORACLE_SQL["op4_ngram_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
edges AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
{_REACH}
c AS (SELECT u, min(v) AS low FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.u = d.doc_id
"""

ORACLE_SQL["op6_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
y AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i + 12], ' ')) AS low FROM x),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM y WHERE low < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

_ALNUM = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

ORACLE_SQL["op7_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(10, len(w)) + 2)]) AS g FROM b WHERE len(w) > 0),
pos AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, win.n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM pos) p JOIN win ON win.g = p.g AND win.n = p.n),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLE_SQL["op8_source_mixing"] = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
w AS (SELECT *, (CASE (place - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight, 2.0::DOUBLE * ss AS cap FROM p),
o AS (SELECT *, row_number() OVER q AS turn, (1.5::DOUBLE * sum(ss) OVER () - coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w WINDOW q AS (ORDER BY cap / weight, place)),
f AS (SELECT arg_min(level, turn) AS level, min(turn) AS turn FROM o WHERE level * weight <= cap),
t AS (SELECT o.source, o.place, ss, CASE WHEN o.turn < f.turn THEN cap ELSE f.level * weight END AS target FROM o, f),
r AS (SELECT d.*, place, ss, target, floor(target + 0.5)::BIGINT AS quota, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY substr(h, 1, 3), h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY place), 0.0) AS lo FROM (SELECT place, quota, (quota + 511) // 512 AS need, sum(quota) OVER (ORDER BY place)::DOUBLE / sum(quota) OVER ()::DOUBLE AS hi, (sum(quota) OVER () + 511)::BIGINT // 512 AS n
  FROM (SELECT place, floor(target + 0.5)::BIGINT AS quota FROM t) WHERE quota > 0)),
pts AS (SELECT i AS slot, ((i + 1) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS x FROM (SELECT unnest(range(0, (SELECT max(n) FROM g))) AS i)),
dealt AS (SELECT slot, place, need, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS rank FROM pts JOIN g ON lo <= x AND x < hi),
had AS (SELECT g.place, g.need, g.n, count(dealt.slot) AS n_dealt FROM g LEFT JOIN dealt USING (place) GROUP BY ALL),
slots AS (SELECT slot, place, rank FROM dealt WHERE rank < need UNION ALL SELECT n + rank, place, rank FROM (SELECT n, place, unnest(range(n_dealt, need)) AS rank FROM had)),
st AS (SELECT place, lo AS start, unnest(range(a // 512, (b - 1) // 512 + 1)) AS rank FROM (SELECT place, lo, turn * ss + lo AS a, least(turn * ss + lo + size, quota) AS b FROM r, (SELECT unnest([0, 1]) AS turn) WHERE size > 0) WHERE a < b),
used AS (SELECT place, start, min(slot)::BIGINT AS first_slot, count(*) AS n FROM st JOIN slots USING (place, rank) GROUP BY ALL)
SELECT doc_id, size, ss AS source_size, target, (greatest(0, least(lo + size, quota) - lo) + greatest(0, least(ss + lo + size, quota) - ss - lo))::BIGINT AS taken,
  CASE WHEN size > 0 THEN coalesce(first_slot, -1) ELSE -1 END AS first_slot, CASE WHEN size > 0 THEN coalesce(n, 0) ELSE 0 END::BIGINT AS n_stretches FROM r LEFT JOIN used ON used.place = r.place AND used.start = r.lo
"""

_CANON = """regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '')"""

ORACLE_SQL["op9_warc_revisits"] = f"""
WITH a AS (SELECT page_id, html, 1700000000 + (page_id * 7919) % 1000003 AS ts, {_CANON} AS rest FROM pages),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]?\\.', '') AS host,
  regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/(index\\.(html?|php))?/*$', '') AS path,
  regexp_replace(regexp_replace(regexp_replace('&' || regexp_extract(rest, '\\?(.*)$', 1), '&(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', ''), '&+$', '') AS q FROM a),
r AS (SELECT page_id, md5(html) AS body, ts, host || path || CASE WHEN q = '' THEN '' ELSE '?' || q END AS cu, CASE WHEN page_id % 3 = 0 THEN 'revisit' ELSE 'response' END AS kind,
  CASE WHEN page_id % 5 <> 0 THEN CASE WHEN page_id % 2 = 0 THEN 'W/' ELSE '' END || '"v' || (ts // 200000)::VARCHAR || '"' END AS tag,
  CASE WHEN page_id % 7 <> 0 THEN 'm' || (ts // 400000)::VARCHAR END AS lm, 'd' || ts::VARCHAR AS dt,
  CASE WHEN page_id % 3 = 0 THEN 'text/plain' ELSE 'text/html' END AS ct, CASE WHEN page_id % 3 = 0 THEN 'max-age=' || (page_id % 60)::VARCHAR END AS cc FROM b),
s AS (SELECT *, last_value(CASE WHEN kind = 'response' THEN page_id END IGNORE NULLS) OVER (PARTITION BY cu ORDER BY ts, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM r),
m AS (SELECT s.*, e.body AS e_body, e.tag AS e_tag, e.lm AS e_lm, e.ct AS e_ct, CASE WHEN s.kind = 'response' THEN 'response' WHEN base IS NULL THEN 'orphan'
  WHEN coalesce(regexp_replace(s.tag, '^W/', '') = regexp_replace(e.tag, '^W/', ''), s.lm = e.lm, true) THEN 'resolved' ELSE 'mismatch' END AS outcome FROM s LEFT JOIN r e ON e.page_id = s.base)
SELECT page_id AS record_id, cu AS canonical_url, ts, kind, outcome, CASE outcome WHEN 'response' THEN page_id WHEN 'resolved' THEN base END AS resolved_id,
  CASE WHEN outcome = 'resolved' THEN concat_ws('|', 'cache-control=' || cc, 'content-type=' || e_ct, 'date=' || dt, 'etag=' || coalesce(tag, e_tag), 'last-modified=' || coalesce(lm, e_lm))
    ELSE concat_ws('|', 'cache-control=' || cc, 'content-type=' || ct, 'date=' || dt, 'etag=' || tag, 'last-modified=' || lm) END AS merged,
  CASE outcome WHEN 'response' THEN body WHEN 'resolved' THEN e_body END AS body_md5 FROM m
"""

_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL["op12_source_divergence"] = f"""
WITH x AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
d AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOW}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM x),
kept AS (SELECT lang, t, count(*)::HUGEINT AS n FROM d GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT x.lang, source, coalesce(v, 0) AS v FROM x LEFT JOIN v USING (lang)),
own AS (SELECT lang, source, t, count(*)::HUGEINT AS n FROM d GROUP BY ALL),
c AS (SELECT g.lang, g.source, v, k.t, coalesce(o.n, 0) AS n, k.n AS total FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.t = k.t),
p AS (SELECT *, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM c),
pairs AS (SELECT a.lang, a.source, a.v, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
far AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
term AS (SELECT p.lang, p.source, p.v, t AS item, p, 1 + (1000000000 * (total + 1)) // (v.n + v.v) AS q FROM p JOIN v ON v.lang = p.lang WHERE p.n > 0),
u AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value, v FROM pairs LEFT JOIN far USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', item, ((p - q) * (p - q)) // q, v FROM term WHERE p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank, v::BIGINT AS n_terms
FROM u QUALIFY part = 'pair' OR rank <= 200
"""
