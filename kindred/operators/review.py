"""The human side: review queue, decisions and their log, acknowledgements, leads."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import gestalt
from ..functions.gestalt import Texts
from ..functions.scores import INTENT_HIGH, INTENT_LOW, INTENT_MIDDLE
from .upsert import collapse_batch, insert_new

#: Bytes of questions that are sent to every task.
FAQ_BYTES = 4 << 20
#: A text's pairs that are compared before its others, and pairs that are bounded at once.
FAQ_FIRST, FAQ_PAIRS = 12, 1 << 17
#: How many matches a queue looks at, by mode (fixed values).
FETCH_LIMITS = {"high": 1000, "hospital": 1000, "all": 400}
#: What a review decision makes of a match (fixed values).
DECISIONS = {"confirmed": "confirmed", "rejected": "dismissed", "found": "found"}


def enriched(matches: DataFrame, reports: DataFrame) -> DataFrame:
    """JN6: matches with both sides' name, source and place; those without both sides drop out."""
    cols = ("full_name", "source", "last_seen_location", "dup_of") if "dup_of" in reports.columns else ("full_name", "source", "last_seen_location")
    out = matches
    for side in ("missing", "found"):
        out = out.join(reports.select(F.col("id").alias(f"{side}_id"), *(F.col(c).alias(f"{side}_{c}") for c in cols)), f"{side}_id")
    return out


def review_queue(matches: DataFrame, reports: DataFrame, mode: str = "high", status: str = "pending", min_score: float = 0.0, limit: int | None = 50, fetch_limit: int | None = None) -> DataFrame:
    """PL10, PF2, WN2, ST_SORT1, LM2: matches to review: acknowledged by the family first, then by score.

    mode high takes face matches and scores from 0.9 on, hospital and all take scores from min_score on. fetch_limit takes
    only so many of these, by score alone, before anything else (FETCH_LIMITS has the usual ones). Sides that are
    duplicates drop out; high and hospital also want a hospital on the found side, no two sides of one known source and no
    re-hosted photo. Of each missing report's matches that are left the first is kept."""
    m = matches.where(F.col("status") == status)
    m = m.where((F.col("face_score") > 0) | (F.col("combined_score") >= 0.9)) if mode == "high" else m.where(F.col("combined_score") >= min_score)
    if fetch_limit:
        m = m.orderBy(F.col("combined_score").desc(), "id").limit(fetch_limit)
    order = [F.when(F.col("family_ack") == "yes", 0).otherwise(1), F.col("combined_score").desc(), F.col("id")]
    out = enriched(m, reports)
    if "missing_dup_of" in out.columns:
        out = out.where("missing_dup_of is null and found_dup_of is null")
    out = out.withColumn("is_hospital", F.coalesce(F.col("found_source").startswith("hospital_"), F.lit(False)))
    if mode in ("high", "hospital"):
        out = out.where("is_hospital and not coalesce(missing_source = found_source, false) and not coalesce(same_photo_suspected, false)")
    out = collapse_batch(out, ["missing_id"], *order)
    out = out.select("id", "missing_id", "found_id", "missing_full_name", "found_full_name", "found_source", "combined_score", "face_score", "family_ack", "is_hospital")
    return out.orderBy(*order).limit(limit) if limit else out


def apply_reviews(matches: DataFrame, reports: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PL11, JN16: (matches, log rows). decisions: match_id, decision, decided_at; a match's latest counts. Deciding
    'found' dismisses the other pending matches of the same missing report. Only matches that exist are touched."""
    last = collapse_batch(decisions.where(F.col("decision").isin(*DECISIONS)), ["match_id"], F.col("decided_at").desc(), F.col("decision"))
    new = F.create_map(*(F.lit(x) for kv in DECISIONS.items() for x in kv))[F.col("decision")]
    d = last.select(F.col("match_id").alias("id"), "decision", "decided_at", new.alias("_new"))
    out = matches.join(d, "id", "left")
    settled = out.where("decision = 'found'").groupBy("missing_id").agg(F.max("decided_at").alias("_settled"))
    out = out.join(settled, "missing_id", "left")
    sibling = F.col("_settled").isNotNull() & (F.col("status") == "pending") & F.col("_new").isNull()
    changed = out.withColumn("reviewed_at", F.when(F.col("_new").isNotNull(), F.col("decided_at")).when(sibling, F.col("_settled"))).withColumn("status", F.coalesce("_new", F.when(sibling, "dismissed").otherwise(F.col("status"))))
    log = enriched(out.where("_new is not null"), reports).select(F.col("id").alias("match_id"), "decision", F.col("missing_full_name").alias("missing_name"), F.col("found_full_name").alias("found_name"), "missing_source", "found_source", F.col("decided_at").alias("reviewed_at"))
    return changed.select(*matches.columns, "reviewed_at"), log


def review_log(log: DataFrame, limit: int = 30, offset: int = 0) -> DataFrame:
    """PL12, LM1: a page of the log, newest first, with the number of all rows."""
    page = log.orderBy(F.col("reviewed_at").desc(), "match_id").offset(offset).limit(max(1, min(limit, 200)))
    return page.join(F.broadcast(log.agg(F.count("*").alias("total")).withColumn("_k", F.lit(1))), F.lit(1) == F.col("_k")).drop("_k")


def record_acks(matches: DataFrame, disclosures: DataFrame, acks: DataFrame, hours: int = 72) -> DataFrame:
    """PL17, JN14, JN15: matches with the families' answers; their status never changes.

    disclosures: phone, match_id, report_id, ts (seconds); acks: phone, ack, ts. An answer belongs to the match that was shown
    to the phone last, within the hours before it, and uses it up, also when it comes too late: a second answer changes
    nothing until another match is shown. Of a match's answers, from several phones or showings, the latest counts. Shown
    matches and answers are merged by phone and time in one window, so no pair of them is formed."""
    shown = disclosures.select("phone", "ts", F.lit(0).alias("turn"), F.struct("match_id", "report_id", F.col("ts").alias("at")).alias("shown"), F.lit(None).cast("string").alias("ack"))
    told = acks.select("phone", "ts", F.lit(1).alias("turn"), F.lit(None).cast(shown.schema["shown"].dataType).alias("shown"), "ack")
    w = W.partitionBy("phone").orderBy("ts", "turn", F.col("shown.match_id"), "ack")
    # what comes right before an answer is what it answers, unless that is an answer itself
    met = shown.unionByName(told).withColumn("last", F.lag("shown").over(w)).where("turn = 1").where(F.col("ts") - F.col("last.at") <= hours * 3600)
    latest = collapse_batch(met.select(F.col("last.match_id").alias("id"), F.col("last.report_id").alias("_report"), F.col("ack").alias("_ack"), F.col("ts").alias("_ts")), ["id"], F.col("_ts").desc(), F.col("_ack"))
    out = matches.join(latest, "id", "left")
    side = F.when(F.col("_report") == F.col("missing_id"), "missing").when(F.col("_report") == F.col("found_id"), "found")
    return out.withColumn("family_ack_side", side).withColumn("family_ack_at", F.col("_ts")).withColumn("family_ack", F.coalesce("_ack", "family_ack")).drop("_report", "_ack", "_ts")


def valid_leads(raw: DataFrame, least: float = 0.6) -> DataFrame:
    """PF8: leads with a name and enough confidence (a malformed one counts as none), ages as numbers, short contexts."""
    name, sure = F.trim("full_name"), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))
    return raw.withColumns({"full_name": name, "confidence": sure, "age": F.col("age").try_cast("int"), "context": F.substring("context", 1, 200)}).where((F.coalesce(F.col("full_name"), F.lit("")) != "") & (F.col("confidence") >= least))


def lead_queue(raw: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """PL18, SK7: leads to review, without those already queued under source, address and name."""
    new = valid_leads(raw).withColumn("review_status", F.lit("pending"))
    keys = ["source", "source_url", "full_name"]
    return insert_new(existing if existing is not None else new.limit(0), new, keys)


def approve_leads(leads: DataFrame, reports: DataFrame) -> DataFrame:
    """PL18, NM22: reports with approved leads merged in under llm:<id>."""
    from .upsert import upsert

    new = leads.where("review_status = 'approved'").select(
        F.concat(F.lit("llm"), F.col("id").cast("string")).alias("id"), F.coalesce("kind", F.lit("missing")).alias("kind"), "full_name", F.col("age").cast("int").alias("age"), F.col("location").alias("last_seen_location"), F.col("context").alias("distinguishing_marks"), F.lit("llm_approved").alias("source"), F.concat(F.lit("llm:"), F.col("id").cast("string")).alias("source_url")
    )
    return upsert(reports, new, mode="merge")


def status_counts(matches: DataFrame) -> DataFrame:
    """AG1: matches by status."""
    return matches.groupBy("status").agg(F.count("*").alias("n"))


def source_counts(reports: DataFrame) -> DataFrame:
    """AG1: reports by source and kind, with totals of each source and of all."""
    return reports.rollup("source", "kind").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def external_leads(leads: DataFrame, least: float = 0.6, show_contact: bool = False) -> DataFrame:
    """PL22: leads from the score on, newest first; contacts only where asked for."""
    contact = F.col("contact") if show_contact else F.lit(None).cast("string")
    return leads.where(F.col("score") >= least).select("id", "full_name", "score", "created_at", contact.alias("contact")).orderBy(F.col("created_at").desc(), "id")


def decide(intent: Column, confidence: Column, urgency: Column, topic_change: Column, match: Column, node: Column | None = None) -> Column:
    """DR1: struct of target, reason and method, by six rules in order: a sure urgent intent, a change of topic, a similar
    node over an unsure intent, an intent of middling confidence, a similar node, or nothing. node is where an intent leads
    (by default the intent itself); an intent that leads nowhere still gives way to a similar node when it is unsure."""
    sure = F.when(intent.isNotNull(), F.coalesce(confidence, F.lit(0.0))).otherwise(0.0)
    match = F.nullif(match, F.lit(""))
    node = F.when(intent.isNotNull(), F.nullif(intent if node is None else node, F.lit("")))

    def answer(t, reason, method):
        return F.struct(t.alias("target"), F.lit(reason).alias("reason"), F.lit(method).alias("method"))

    return (
        F.when((sure > INTENT_HIGH) & (urgency == "high") & node.isNotNull(), answer(node, "high_confidence_urgent", "intent"))
        .when(F.coalesce(topic_change, F.lit(False)) & (sure > INTENT_MIDDLE) & node.isNotNull(), answer(node, "topic_change", "intent"))
        .when(intent.isNotNull() & (sure < INTENT_MIDDLE) & match.isNotNull(), answer(match, "following_flow", "similarity"))
        .when((sure > INTENT_LOW) & node.isNotNull(), answer(node, "intent_detected", "intent"))
        .when(match.isNotNull(), answer(match, "low_confidence_follow_flow", "similarity"))
        .otherwise(answer(F.lit("fallback"), "no_clear_intent", "fallback"))
    )


def clean_intent(raw: Column, known: tuple[str, ...], default: str = "unknown") -> Column:
    """DR2: struct of intent and confidence from a classifier's JSON: unknown intents become the default, confidences are
    held in 0..1, malformed JSON gives the default with 0."""
    v = F.from_json(raw, "intent string, confidence string")
    sure = F.least(F.greatest(F.coalesce(v["confidence"].try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    name = F.lower(F.trim(v["intent"]))
    good = F.coalesce(name.isin(*known), F.lit(False))
    return F.struct(F.when(good, name).otherwise(default).alias("intent"), F.when(good, sure).otherwise(0.0).alias("confidence"))


def user_type(node: Column, types: dict[str, str], default: str = "unknown") -> Column:
    """DR3: the kind of user that a dialog node stands for."""
    m = F.create_map(*(F.lit(x) for kv in types.items() for x in kv))
    return F.coalesce(F.try_element_at(m, node), F.lit(default))


def route(messages: DataFrame, nodes: DataFrame) -> DataFrame:
    """JN19: messages with next_node: the node's transition for exactly that text (keys list alternatives split by |), else
    its default. nodes: node, transitions (map)."""
    t = nodes.select("node", F.explode("transitions").alias("key", "next"))
    exact = t.where("key <> 'default'").select("node", F.explode(F.split(F.lower("key"), "\\|")).alias("text"), "next").groupBy("node", "text").agg(F.min("next").alias("next"))
    default = t.where("key = 'default'").select("node", F.col("next").alias("_default"))
    m = messages.withColumn("_text", F.lower(F.trim("text")))
    out = m.join(exact.withColumnRenamed("text", "_text"), ["node", "_text"], "left").join(default, "node", "left")
    return out.withColumn("next_node", F.coalesce("next", "_default")).drop("next", "_default", "_text")


def resolve_tenant(messages: DataFrame, tenants: DataFrame, single: bool = False) -> DataFrame:
    """JN20: messages with tenant_id: the active tenant of their session; with single, the only active tenant, if it is
    the only one."""
    active = tenants.where("active")
    if single:
        only = active.agg(F.count("*").alias("n"), F.min("tenant_id").alias("tenant_id")).select(F.when(F.col("n") == 1, F.col("tenant_id")).alias("tenant_id"), F.lit(1).alias("_k"))
        return messages.withColumn("_k", F.lit(1)).join(F.broadcast(only), "_k").drop("_k")
    return messages.join(active.groupBy("session").agg(F.min("tenant_id").alias("tenant_id")), "session", "left")


def _letters(text: str) -> list[tuple[int, str]]:
    """A text's letters as a set: each with its turn among equal ones, those of late turns first, as few texts have them."""
    seen: dict[str, int] = {}
    out = []
    for c in text:
        seen[c] = seen.get(c, 0) + 1
        out.append((-seen[c], c))
    return sorted(out)


def _prefix(text: str, cutoff: float) -> list[str]:
    """Letters of which one at least is shared with the prefix of any text whose ratio reaches the cutoff: two texts of a and b
    letters share cutoff * (a + b) / 2 of them at least, and b is a * cutoff / (2 - cutoff) at least."""
    a = len(text)
    shortest = math.ceil(a * cutoff / (2 - cutoff) - 1e-9)
    shared = max(1, math.ceil(cutoff * (a + shortest) / 2 - 1e-9))
    # two empty texts are alike
    return [f"{c}{-n}" for n, c in _letters(text)[: a - shared + 1]] or [""]


def _best_of(texts: list[str], folded: Texts, faqs: list, questions: Texts, x: np.ndarray, y: np.ndarray, cutoff: float) -> list[tuple]:
    """(text, faq, ratio) of each text's best question among the pairs x of texts and y of questions: the letters that two
    texts share bound their ratio, so the pairs of the highest bounds show what others must reach."""
    best, top = np.full(len(texts), cutoff), {}
    most = gestalt.bounds(folded, questions, x, y)
    order = np.lexsort((-most, x))
    x, y, most = x[order], y[order], most[order]
    rank = np.arange(len(x)) - np.searchsorted(x, x)
    for some in (rank < FAQ_FIRST, rank >= FAQ_FIRST):
        # ratios are rounded to six places
        some = np.flatnonzero(some & (most >= best[x] - 1e-6))
        got = gestalt.ratios(folded, questions, x[some], y[some], x[some], best)
        for k in np.flatnonzero(got >= best[x[some]] - 1e-6):
            r, i, faq = round(float(got[k]), 6), x[some[k]], faqs[y[some[k]]]
            if r >= cutoff and (i not in top or (-r, faq) < top[i]):
                top[i] = (-r, faq)
    return [(texts[i], faq, -r) for i, (r, faq) in top.items()]


def best_faq(messages: DataFrame, faqs: DataFrame, cutoff: float = 0.65, most_sent: int = FAQ_BYTES) -> DataFrame:
    """JN18: (message_id, faq_id, ratio): each message's most similar question, if the gestalt ratio reaches the cutoff (above
    0); ties to the smaller faq_id. Distinct messages are compared once. Null messages, questions and faq_ids match nothing.

    Questions of up to most_sent bytes go to every task, which has all of them for each message. More are joined: two texts
    whose ratio reaches the cutoff share many letters, counted with their repeats, so one of the first letters of both, in
    an order of rarity, is the same (a prefix join of letter multisets), and their lengths are not far apart. What is joined
    is compared in either way by the ratio of shared letters first, which bounds the gestalt ratio from above."""
    from ..functions import fuzzy

    if not 0 < cutoff <= 1:
        raise ValueError(f"cutoff is {cutoff}, not above 0 and up to 1")
    kind = faqs.schema["faq_id"].dataType.simpleString()
    texts = messages.where("text is not null").select("text").distinct()
    asked = faqs.where("faq_id is not null and question is not null").select("faq_id", "question")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("question") + 64), F.lit(0))).first()[0]
    if size <= most_sent:
        least: dict = {}
        for r in asked.collect():
            q = fuzzy._fold(r.question)
            least[q] = min(least.get(q, r.faq_id), r.faq_id)
        known = messages.sparkSession.sparkContext.broadcast(least)

        def best(batches):
            questions, faqs = Texts(list(known.value)), list(known.value.values())
            some = max(1, FAQ_PAIRS // max(1, len(faqs)))
            for pdf in batches:
                for at in range(0, len(pdf), some):
                    part = pdf["text"].iloc[at : at + some].tolist()
                    x, y = np.divmod(np.arange(len(part) * len(faqs)), max(1, len(faqs)))
                    rows = _best_of(part, Texts([fuzzy._fold(t) for t in part]), faqs, questions, x, y, cutoff)
                    yield pd.DataFrame(rows, columns=["text", "faq_id", "ratio"])

        # short texts are much work, which a number of partitions chosen by their bytes would leave to one task
        spark = messages.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
        met = texts.repartition(tasks, "text").mapInPandas(best, f"text string, faq_id {kind}, ratio double")
    else:
        # what rounding to six places lets pass must be joined
        low = max(cutoff - 1e-6, 1e-6)

        def keys(names: list[str], text: str):
            def emit(batches):
                for pdf in batches:
                    folded = [fuzzy._fold(t) for t in pdf[text]]
                    out = pd.DataFrame({**{n: pdf[n] for n in names}, "letter": [_prefix(t, low) for t in folded], "n": [len(t) for t in folded]})
                    yield out.explode("letter").astype({"n": "int32"})

            return emit

        left = texts.mapInPandas(keys(["text"], "text"), "text string, letter string, n int")
        right = asked.mapInPandas(keys(["faq_id", "question"], "question"), f"faq_id {kind}, question string, letter string, n int").withColumnRenamed("n", "m")
        near = left.join(right, "letter").where(F.lit(2.0) * F.least("n", "m") >= F.lit(low) * (F.col("n") + F.col("m")))

        def verify(batches):
            for pdf in batches:
                (x, texts), (y, faqs) = pd.factorize(pdf["text"]), pd.factorize(pd.MultiIndex.from_frame(pdf[["faq_id", "question"]]))
                folded, questions = Texts([fuzzy._fold(t) for t in texts]), Texts([fuzzy._fold(q) for _, q in faqs])
                rows = _best_of(list(texts), folded, [f for f, _ in faqs], questions, x, y, cutoff)
                yield pd.DataFrame(rows, columns=["text", "faq_id", "ratio"])

        met = near.select("text", "faq_id", "question").distinct().mapInPandas(verify, f"text string, faq_id {kind}, ratio double")
    top = met.groupBy("text").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "faq_id")).alias("top"))
    return messages.select("message_id", "text").join(top, "text").select("message_id", F.col("top.faq_id").alias("faq_id"), (-F.col("top.r")).alias("ratio"))
