"""The registered queries: operators applied to the test tables, each with the SQL that DuckDB runs on the same tables.

The tables stand in for supplier evidence: lineitem for signals, orders for analyses, customer for users, documents for reviews, events for
timed reviews, requests and status events, embeddings for review vectors, pages for fetched pages, conversations for model calls.
Where the tables hold no case for a default (the complaint lexicon, a cosine of 0.88, a burst ratio of 0.6), a query passes other values; the
defaults are tested on literal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import scalars, text as tx, urls
from attesta.operators import admission, extraction, identity, merge, models, policy, report, reviews, scoring, serving, similarity, workflow
from attesta.plans.registry import query
from attesta.sources.tables import read_table

#: Stand-in phrases by category, as the tables hold none of the real ones.
STEMS = {"QUALITY": ["tion"], "DELIVERY": ["ción"], "AFTER_SALES": ["schen"], "PACKAGING": ["license"]}
FOLDED = r"trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g'))"
AS_OF = "2026-01-01 00:00:00"
DIMENSIONS = list(scoring.WEIGHTS["v0.2.1"])


def _reviews(spark, d, by="source") -> DataFrame:
    return read_table(spark, d, "documents").select(F.col(by).alias("supplier"), F.col("doc_id").alias("evidence_id"), "text")


def _rated(spark, d) -> DataFrame:
    labels = read_table(spark, d, "labels").select(F.col("doc_id").alias("evidence_id"), (F.col("quality") * 4 + 1).alias("rating"))
    return _reviews(spark, d).join(labels, "evidence_id", "left")


def _signals(spark, d) -> DataFrame:
    """Signals from lineitem: see SIGNALS for the same in SQL."""
    dims = F.array(*map(F.lit, DIMENSIONS))
    return read_table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("supplier"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("evidence_id"), F.element_at(dims, (F.col("l_linenumber") % 5 + 1).cast("int")).alias("dimension"),
        (F.col("l_quantity") * 2).alias("severity"), (F.col("l_discount") * 10).alias("reliability"), (F.col("l_tax") * 10 + 0.1).alias("importance"), (F.col("l_returnflag") == "R").alias("review_derived"),
        (F.col("l_quantity") >= 45).alias("critical_candidate"), (F.col("l_linestatus") == "F").alias("independently_verified"), F.col("l_linenumber").alias("corroborating"), F.col("l_orderkey").alias("order_id"),
    )


SIGNALS = f"""sig as (select l_suppkey as supplier, l_orderkey || '-' || l_linenumber as evidence_id, ({DIMENSIONS!r})[l_linenumber % 5 + 1] as dimension, l_quantity * 2 as severity,
l_discount * 10 as reliability, l_tax * 10 + 0.1::double as importance, l_returnflag = 'R' as review_derived, l_quantity >= 45 as critical_candidate, l_linestatus = 'F' as independently_verified,
l_linenumber as corroborating, l_orderkey as order_id from lineitem)"""
RISKS = """risks as (select supplier, dimension, count(*) as signals, sum(importance * reliability * severity) / nullif(sum(importance * reliability), 0) as risk,
coalesce(sum(case when review_derived then importance * reliability else 0 end) / nullif(sum(importance * reliability), 0), 0) as review_share from sig group by all)"""
WEIGHTS = "weights as (select * from (values " + ", ".join(f"('{d}', {w}::double)" for d, w in scoring.WEIGHTS["v0.2.1"].items()) + ") w(dimension, weight))"
CONFIDENCES = "conf as (select supplier, dimension, least(1.0, count(*) / 8.0)::double as confidence from sig group by all)"
FACTORS = "factors as (select s_suppkey as supplier, (s_suppkey % 10) / 10.0::double + 0.1 as data_coverage, 0.8::double as source_reliability, 0.6::double as sample_adequacy, (s_suppkey % 7) / 7.0::double as data_freshness from supplier)"
SCORED = """scored as (select f.supplier, w.dimension, w.weight, r.risk, coalesce(r.review_share, 0) as review_share, coalesce(c.confidence, 0) as confidence from factors f cross join weights w
left join risks r on r.supplier = f.supplier and r.dimension = w.dimension left join conf c on c.supplier = f.supplier and c.dimension = w.dimension),
eff as (select s.*, confidence * (1 - case when s.dimension in ('PRODUCT_QUALITY', 'DELIVERY', 'AFTER_SALES') then s.review_share * coalesce(m.risk, 0) / 100 * 0.5 else 0 end) as effective_confidence
from scored s left join (select supplier, risk from scored where dimension = 'REVIEW_MANIPULATION') m on m.supplier = s.supplier)"""


def _confidences(signals: DataFrame) -> DataFrame:
    return signals.groupBy("supplier", "dimension").agg(F.least(F.lit(1.0), F.count("*") / 8).alias("confidence"))


def _factors(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return read_table(spark, d, "supplier").select(k.alias("supplier"), (k % 10 / 10 + 0.1).alias("data_coverage"), F.lit(0.8).alias("source_reliability"), F.lit(0.6).alias("sample_adequacy"), (k % 7 / 7).alias("data_freshness"))


# Projections, filters, presence -----------------------------------------------------------------------------------------------------


@query("select o_orderkey, o_custkey, round(o_totalprice, 2) as total from orders where o_orderstatus = 'F' and o_totalprice > 100000")
def scan_filter_project(spark, d):
    o = read_table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 100000")
    return o.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("total"))


@query("select event_id, props ->> '$.k' as k, try_cast(nullif(props ->> '$.k', '') as double) as k_value, props ->> '$.absent' as absent from events")
def json_path_project(spark, d):
    k = F.get_json_object("props", "$.k")
    return read_table(spark, d, "events").select("event_id", k.alias("k"), F.nullif(k, F.lit("")).try_cast("double").alias("k_value"), F.get_json_object("props", "$.absent").alias("absent"))


@query(r"select doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) as folded from documents")
def review_text_normalize(spark, d):
    return read_table(spark, d, "documents").select("doc_id", tx.folded(F.col("text")).alias("folded"))


@query(r"select doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) as squeezed_length, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 80) as head, substr(trim(substr(text, 1, 4096), ' '), 1, 2000) as bounded from documents where trim(text) <> ''")
def text_cleanup(spark, d):
    t = F.col("text")
    return read_table(spark, d, "documents").where(F.trim("text") != "").select("doc_id", F.length(tx.squeezed(t)).alias("squeezed_length"), tx.clean_to(t, 80).alias("head"), tx.bounded(t).alias("bounded"))


@query("""with i as (select doc_id, text as t, unnest(range(0, least(length(text), 6000), 700)) as p from documents)
select doc_id, (p / 700)::bigint as chunk_no, length(substr(t, p + 1, 900)) as n_chars, md5(substr(t, p + 1, 900)) as digest from i where length(substr(t, p + 1, 900)) >= 16""")
def context_chunks(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.posexplode(tx.chunks(F.col("text"))).alias("chunk_no", "c")).select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.length("c").cast("bigint").alias("n_chars"), F.md5("c").alias("digest"))


@query(r"""select doc_id, regexp_matches(text, '(?i)(?:password|passwd|cookie|authorization|token|secret|api[_-]?key)["'']?\s*[:=]\s*["'']?[A-Za-z0-9._-]{8,}') as has_secret from documents""")
def secret_filter(spark, d):
    return read_table(spark, d, "documents").select("doc_id", tx.has_secret(F.col("text")).alias("has_secret"))


@query("select o.o_orderkey, exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = 'R') as has_return from orders o")
def exists_flag(spark, d):
    returned = read_table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return serving.exists_flag(read_table(spark, d, "orders").select("o_orderkey"), returned, ["o_orderkey"], "has_return")


@query("""with f as (select o_orderkey, [nullif(o_orderstatus, 'F'), o_orderpriority, case when o_totalprice > 50000 then 'x' end, case when o_custkey % 3 = 0 then '' else 'y' end] as v from orders)
select o_orderkey, len(list_filter(v, lambda x: x is not null and x <> '')) as present_fields, round(len(list_filter(v, lambda x: x is not null and x <> '')) / 4.0::double, 4) as completeness,
concat_ws(',', case when v[1] is null or v[1] = '' then 'status' end, case when v[2] is null or v[2] = '' then 'priority' end, case when v[3] is null or v[3] = '' then 'price' end, case when v[4] is null or v[4] = '' then 'customer' end) as missing from f""")
def completeness(spark, d):
    o = read_table(spark, d, "orders")
    values = {"status": F.nullif(F.col("o_orderstatus"), F.lit("F")), "priority": F.col("o_orderpriority"), "price": F.when(F.col("o_totalprice") > 50000, "x"), "customer": F.when(F.col("o_custkey") % 3 == 0, "").otherwise("y")}
    here = {k: scalars.present(v, "string") for k, v in values.items()}
    n = sum((p.cast("bigint") for p in here.values()), F.lit(0).cast("bigint"))
    return o.select("o_orderkey", n.alias("present_fields"), F.round(n / len(here), 4).alias("completeness"), F.array_join(F.array_compact(F.array(*(F.when(~p, k) for k, p in here.items()))), ",").alias("missing"))


@query("""select event_id, case when value between 0 and 5 then value end as rating, least(1, greatest(0, value / 10)) as clamped, least(2.0::double * pow(2.0, event_id % 9), 60) as delay,
case when event_id % 4 = 0 then null when floor(value) = value then value::bigint end as whole from events""")
def numeric_guards(spark, d):
    v = F.col("value")
    whole = F.when(F.col("event_id") % 4 != 0, scalars.non_negative(v, whole=True))
    return read_table(spark, d, "events").select("event_id", scalars.rating(v).alias("rating"), scalars.clamp(v / 10).alias("clamped"), scalars.backoff(F.col("event_id") % 9 + 1).alias("delay"), whole.cast("bigint").alias("whole"))


@query(f"""select o_orderkey, floor((epoch(timestamp '{AS_OF}') - epoch(o_orderdate)) / 86400)::int as age_days, (epoch(timestamp '{AS_OF}') - epoch(o_orderdate)) / 86400 >= 900 as stale,
floor(epoch(o_orderdate) / 604800)::bigint as week_number, date_diff('year', o_orderdate, timestamp '{AS_OF}') - case when strftime(o_orderdate, '%m%d') > '0101' then 1 else 0 end as years from orders""")
def freshness_days(spark, d):
    as_of, t = F.lit(AS_OF).cast("timestamp"), F.col("o_orderdate")
    age = scalars.age_days(t, as_of)
    return read_table(spark, d, "orders").select("o_orderkey", age.alias("age_days"), (age >= 900).alias("stale"), scalars.window_number(t, 604800).alias("week_number"), scalars.completed_years(t, as_of).cast("bigint").alias("years"))


# Review signals -----------------------------------------------------------------------------------------------------------------------


def _duplicates_sql(by: str) -> str:
    return f"""with k as (select {by} as supplier, {FOLDED} as key from documents), g as (select supplier, key, count(*) as n from k group by all),
p as (select supplier, sum((length(key) >= 8 and n >= 2)::bigint)::bigint as duplicate_groups, sum(case when length(key) >= 8 and n >= 2 then n else 0 end)::bigint as duplicate_reviews, sum(n)::bigint as review_count from g group by supplier)
select *, round(least(1.0, duplicate_reviews / review_count::double), 4) as strength from p where duplicate_groups > 0"""


@query(_duplicates_sql("lang"))
def review_exact_duplicates(spark, d):
    return reviews.exact_duplicates(_reviews(spark, d, "lang"))


@query(_duplicates_sql("source"))
def review_exact_duplicates_by_source(spark, d):
    return reviews.exact_duplicates(_reviews(spark, d))


@query(f"""with k as (select lang as supplier, doc_id as evidence_id, {FOLDED} as key from documents), g as (select supplier, key, count(*) as copies, min(evidence_id) as first_id from k where length(key) >= 8 group by all having count(*) >= 2)
select supplier, evidence_id, copies, first_id from k join g using (supplier, key)""")
def duplicate_members(spark, d):
    docs = read_table(spark, d, "documents").select(F.col("lang").alias("supplier"), F.col("doc_id").alias("evidence_id"), "text")
    return reviews.duplicate_members(docs)


@query("""with w as (select user_id, event_id, ts, count(*) over (partition by user_id order by ts range between current row and interval 24 hours following) as n from events),
b as (select user_id, max(n) as n, count(*) as timed, arg_max(ts, (n, -epoch_us(ts))) as burst_start from w group by all)
select user_id as supplier, event_id as evidence_id from events join b using (user_id) where n >= 3 and n / timed::double >= 0.05 and ts between burst_start and burst_start + interval 24 hours""")
def burst_members(spark, d):
    events = read_table(spark, d, "events").select(F.col("user_id").alias("supplier"), F.col("event_id").alias("evidence_id"), "ts")
    return reviews.burst_members(events, reviews.timing_bursts(events, ["supplier"], min_ratio=0.05))


def _bad(stems: dict[str, list[str]]) -> str:
    return "list_filter([" + ", ".join(f"case when {' or '.join(f'contains({FOLDED}, {p!r})' for p in ps)} then {c!r} end" for c, ps in stems.items()) + "], lambda x: x is not null)"


@query(f"with c as (select source as supplier, unnest({_bad(STEMS)}) as category from documents) select supplier, category, count(*) as review_count from c group by all having count(*) >= 2")
def complaint_topics(spark, d):
    return reviews.topics(_reviews(spark, d), STEMS)


@query(f"""with r as (select source as supplier, len({_bad(STEMS)}) > 0 as bad, quality * 4 + 1 as r from documents left join labels using (doc_id)),
p as (select supplier, count(*) filter (bad and r >= 4) as mismatches, count(*) filter (bad and r is not null) as rated_complaints, round(count(r) / count(*)::double, 4) as reliability from r group by supplier)
select *, round(mismatches / rated_complaints::double, 4) as strength from p where mismatches >= 2""")
def rating_text_mismatch(spark, d):
    return reviews.rating_mismatch(_rated(spark, d), STEMS)


@query("""with c as (select source as supplier, count(*) as review_count from documents group by all), a as (select supplier, case when supplier in ('src1', 'src3', 'src7') then 10 else 100000 end as aggregate_count from c)
select supplier, review_count, aggregate_count, round((review_count - aggregate_count) / review_count::double, 4) as strength from c join a using (supplier) where aggregate_count < review_count""")
def review_volume_inconsistency(spark, d):
    captured = _reviews(spark, d).groupBy("supplier").agg(F.count("*").alias("review_count"))
    return reviews.volume_inconsistency(captured, captured.select("supplier", F.when(F.col("supplier").isin("src1", "src3", "src7"), 10).otherwise(100000).alias("aggregate_count")))


@query("""with w as (select user_id, event_type, ts, count(*) over (partition by user_id, event_type order by ts range between current row and interval 24 hours following) as n from events),
b as (select user_id, event_type, max(n) as burst_count, count(*) as timed, arg_max(ts, (n, -epoch_us(ts))) as burst_start from w group by all)
select user_id, event_type, burst_start, burst_count, timed, round(burst_count / timed::double, 4) as strength from b where burst_count >= 3 and burst_count / timed::double >= 0.2""")
def timing_burst_24h(spark, d):
    bursts = reviews.timing_bursts(read_table(spark, d, "events"), ["user_id", "event_type"], min_ratio=0.2)
    return bursts.withColumn("burst_start", F.col("burst_start").cast("timestamp_ntz"))


@query(f"""with n as (select source as supplier, count(*) as review_count from documents group by all), k as (select source as supplier, {FOLDED} as key from documents), g as (select supplier, key, count(*) as n from k group by all),
dup as (select supplier, round(least(1.0, sum(case when length(key) >= 8 and n >= 2 then n else 0 end) / sum(n)::double), 4) as s, 1.0::double as r, 0.35::double as w, sum((length(key) >= 8 and n >= 2)::int) as c from g group by supplier),
rr as (select source as supplier, len({_bad(STEMS)}) > 0 as bad, quality * 4 + 1 as r from documents left join labels using (doc_id)),
mis as (select supplier, count(*) filter (bad and r >= 4) as m, count(*) filter (bad and r is not null) as c, round(count(r) / count(*)::double, 4) as rel from rr group by supplier),
pat as (select supplier, w * s * r as x from dup where c > 0 union all select supplier, 0.25::double * round(m / c::double, 4) * rel from mis where m >= 2), raw as (select supplier, sum(x) as raw from pat group by supplier)
select n.supplier, review_count, round(least(1.0, review_count / 8.0::double) * (1 - least(0.75, coalesce(raw, 0))), 4) as reliability from n left join raw using (supplier)""")
def review_reliability(spark, d):
    r = _rated(spark, d)
    dup = reviews.exact_duplicates(r).select("supplier", F.lit("EXACT_DUPLICATE").alias("kind"), "strength", F.lit(1.0).alias("reliability"))
    mis = reviews.rating_mismatch(r, STEMS).select("supplier", F.lit("RATING_TEXT_MISMATCH").alias("kind"), "strength", "reliability")
    return reviews.reliability(r.groupBy("supplier").agg(F.count("*").alias("review_count")), dup.unionByName(mis))


@query("""select source as supplier, concat_ws(',', 'timestamps', case when count(quality) < count(*) then 'ratings' end, case when source <> 'src1' then 'aggregate_count' end) as missing from documents left join labels using (doc_id) group by source""")
def missing_inputs(spark, d):
    declared = spark.createDataFrame([("src1", 5)], "supplier string, aggregate_count int")
    return reviews.missing_inputs(_rated(spark, d).withColumn("ts", F.lit(None).cast("timestamp")), declared)


# Similarity ---------------------------------------------------------------------------------------------------------------------------

PAIRS = """rep as (select label, embedding, min(vec_id) as vec_id, count(*) as copies from embeddings group by all), member as (select e.label as supplier, e.vec_id as id, rep.vec_id as rep from embeddings e join rep using (label, embedding)),
p as (select a.label as supplier, a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as similarity, a.copies * b.copies as weight from rep a join rep b on a.label = b.label and a.vec_id < b.vec_id),
pairs as (select * from p where similarity >= 0.3 union all select label, vec_id, vec_id, 1.0, copies * (copies - 1) // 2 from rep where copies > 1)"""
CLUSTERS = """edges as (select supplier, a as x, b as y from pairs union all select supplier, b, a from pairs), walk(supplier, id, seen) as (select distinct supplier, x, x from edges union select w.supplier, w.id, e.y from walk w join edges e on e.x = w.seen and e.supplier = w.supplier),
found as (select supplier, id, min(seen) as cluster from walk group by all), clusters as (select m.supplier, m.id, f.cluster from member m join found f on f.supplier = m.supplier and f.id = m.rep)"""


def _vectors(spark, d) -> DataFrame:
    return read_table(spark, d, "embeddings").select(F.col("label").alias("supplier"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _pairs(spark, d) -> DataFrame:
    """Written once: the pairs are read by every step behind them."""
    return similarity.similar_pairs(_vectors(spark, d), 0.3)


def _clusters(spark, d, pairs: DataFrame) -> DataFrame:
    return similarity.clusters(pairs, similarity.members(_vectors(spark, d)))


@query(f"with {PAIRS} select supplier, a, b, round(similarity, 4) as similarity, weight::bigint as weight from pairs")
def near_duplicate_pairs(spark, d):
    return _pairs(spark, d).withColumn("similarity", F.round("similarity", 4))


@query(f"with recursive {PAIRS}, {CLUSTERS} select supplier, id, cluster from clusters")
def near_duplicate_clusters(spark, d):
    return _clusters(spark, d, _pairs(spark, d))


@query(f"""with recursive {PAIRS}, {CLUSTERS}, st as (select p.supplier, c.cluster, min(similarity) as lo, sum(similarity * weight) / sum(weight) as mean from pairs p join clusters c on c.supplier = p.supplier and c.id = p.a group by all),
sz as (select supplier, cluster, count(*) as members from clusters group by all)
select st.supplier, st.cluster, members, round(lo, 4) as min_similarity, round(mean, 4) as avg_similarity, round(least(1.0, (mean - 0.3) / 0.7 * 0.25 + 0.75), 4) as reliability, (dense_rank() over (partition by st.supplier order by st.cluster) - 1)::int as number from st join sz using (supplier, cluster)""")
def cluster_statistics(spark, d):
    pairs = _pairs(spark, d)
    s = similarity.cluster_statistics(pairs, _clusters(spark, d, pairs), 0.3)
    return s.select("supplier", "cluster", "members", *(F.round(c, 4).alias(c) for c in ("min_similarity", "avg_similarity", "reliability")), "number")


@query(f"""with recursive {PAIRS}, {CLUSTERS}, st as (select p.supplier, c.cluster, sum(similarity * weight) / sum(weight) as mean from pairs p join clusters c on c.supplier = p.supplier and c.id = p.a group by all),
sz as (select supplier, cluster, count(*) as members from clusters group by all), q as (select supplier, sum(members) as clustered, avg(least(1.0, (mean - 0.3) / 0.7 * 0.25 + 0.75)) as rel from st join sz using (supplier, cluster) group by supplier),
n as (select label as supplier, count(*) as n from embeddings group by all)
select n.supplier, coalesce(clustered, 0)::bigint as clustered, round(least(0.5, coalesce(clustered / n::double * rel * 0.5, 0)), 4) as penalty from n left join q using (supplier)""")
def semantic_penalty(spark, d):
    pairs = _pairs(spark, d)
    counts = read_table(spark, d, "embeddings").groupBy(F.col("label").alias("supplier")).agg(F.count("*").alias("review_count"))
    out = similarity.semantic_penalty(similarity.cluster_statistics(pairs, _clusters(spark, d, pairs), 0.3), counts)
    return out.withColumn("clustered", F.col("clustered").cast("bigint"))


# Scoring ------------------------------------------------------------------------------------------------------------------------------


@query(f"with {SIGNALS}, {RISKS} select supplier, dimension, signals, round(risk, 4) as risk, round(review_share, 4) as review_share from risks")
def dimension_risk(spark, d):
    return scoring.dimension_risk(_signals(spark, d)).withColumns({"risk": F.round("risk", 4), "review_share": F.round("review_share", 4)})


def _scored(spark, d):
    signals = _signals(spark, d)
    scored = scoring.scaffolded(_factors(spark, d).select("supplier"), scoring.dimension_risk(signals), "v0.2.1").join(_confidences(signals), ["supplier", "dimension"], "left")
    return scoring.effective_confidence(scored.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))))


@query(f"with {SIGNALS}, {RISKS}, {WEIGHTS}, {CONFIDENCES}, {FACTORS}, {SCORED} select supplier, dimension, weight, round(effective_confidence, 4) as effective_confidence from eff")
def effective_confidence(spark, d):
    return _scored(spark, d).select("supplier", "dimension", "weight", F.round("effective_confidence", 4).alias("effective_confidence"))


OVERALL = """o as (select supplier, sum(case when risk is not null and effective_confidence > 0 then weight * effective_confidence * risk end) / sum(case when risk is not null and effective_confidence > 0 then weight * effective_confidence end) as overall,
count(*) filter (risk is not null and effective_confidence > 0) as dimensions, count(*) filter (risk is null) as missing from eff group by supplier)"""


@query(f"with {SIGNALS}, {RISKS}, {WEIGHTS}, {CONFIDENCES}, {FACTORS}, {SCORED}, {OVERALL} select supplier, round(overall, 4) as overall, dimensions, missing from o")
def overall_risk(spark, d):
    return scoring.overall_risk(_scored(spark, d)).withColumn("overall", F.round("overall", 4))


@query(f"with {FACTORS} select supplier, round(data_coverage, 4) as data_coverage, round(0.4 * data_coverage + 0.25 * source_reliability + 0.2 * sample_adequacy + 0.15 * data_freshness, 4) as confidence from factors")
def overall_confidence(spark, d):
    return scoring.overall_confidence(_factors(spark, d)).withColumns({"confidence": F.round("confidence", 4), "data_coverage": F.round("data_coverage", 4)})


CRITICAL = "crit as (select supplier, count(*) as critical_signals from sig where critical_candidate and independently_verified and not review_derived and severity >= 90 and reliability >= 0.9 and corroborating >= 2 group by supplier)"


@query(f"with {SIGNALS}, {CRITICAL} select * from crit")
def critical_floor(spark, d):
    return scoring.critical(_signals(spark, d))


@query(f"""with {SIGNALS}, {RISKS}, {WEIGHTS}, {CONFIDENCES}, {FACTORS}, {SCORED}, {OVERALL}, {CRITICAL},
j as (select f.supplier, f.data_coverage, 0.4 * data_coverage + 0.25 * source_reliability + 0.2 * sample_adequacy + 0.15 * data_freshness as confidence, missing, critical_signals is not null as critical,
case when overall is null then null when critical_signals is not null then greatest(overall, 65) else overall end as overall from factors f join o using (supplier) left join crit using (supplier)),
l as (select *, case when overall is null or round(data_coverage, 4) < 0.45 or round(confidence, 4) < 0.4 then 'INSUFFICIENT_INFORMATION' when round(overall, 4) <= 34 then 'LOW' when round(overall, 4) <= 64 then 'MODERATE' else 'HIGH' end as risk_label from j)
select supplier, round(case when risk_label <> 'INSUFFICIENT_INFORMATION' then overall end, 4) as overall_risk, round(confidence, 4) as confidence, risk_label, missing as missing_dimensions, critical from l""")
def supplier_assessment(spark, d):
    signals = _signals(spark, d)
    return scoring.assess(signals, _confidences(signals), _factors(spark, d))


@query(f"with {SIGNALS} select supplier, dimension, count(*) as signals, round(coalesce(sum(importance * reliability) / nullif(sum(reliability), 0), 0), 4) as confidence from sig group by all")
def merge_dimension_inputs(spark, d):
    groups = _signals(spark, d).withColumn("confidence", F.col("importance"))
    return scoring.merged_confidence(groups).withColumn("confidence", F.round("confidence", 4))


@query(f"""with {SIGNALS}, {WEIGHTS}, held as (select supplier, sum(weight) as held from (select distinct supplier, dimension from sig where severity > 90) join weights using (dimension) group by supplier)
select s_suppkey as supplier, round(least((s_suppkey % 10) / 10.0::double, coalesce(held, 0)), 4) as coverage from supplier left join held on held.supplier = s_suppkey""")
def dimension_coverage(spark, d):
    whole = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), (F.col("s_suppkey") % 10 / 10).alias("completeness"))
    return scoring.dimension_coverage(_signals(spark, d).where("severity > 90"), whole).withColumn("coverage", F.round("coverage", 4))


IDENTITY = "ev as (select l_suppkey as supplier, case when l_returnflag = 'A' then 'FACTORY' when l_returnflag = 'R' then 'TRADER' else 'NEUTRAL' end as direction, l_quantity / 50 as strength, l_discount * 10 as reliability, case when l_linestatus = 'F' then 'SELF_CLAIM' else 'DOCUMENT' end as source_kind from lineitem)"


@query(f"""with {IDENTITY}, m as (select supplier, count(*) filter (direction <> 'NEUTRAL') as n, sum(case when direction = 'FACTORY' then strength * reliability else 0 end) as f, sum(case when direction = 'TRADER' then strength * reliability else 0 end) as t,
coalesce(max(strength * reliability) filter (direction = 'FACTORY'), 0) as tf, coalesce(max(strength * reliability) filter (direction = 'TRADER'), 0) as tt, coalesce(max(reliability) filter (direction <> 'NEUTRAL' and source_kind <> 'SELF_CLAIM'), 0) as ind,
coalesce(bool_and(source_kind = 'SELF_CLAIM') filter (direction <> 'NEUTRAL'), false) as claims from ev group by supplier), k as (select *, case when f + t > 0 then f / (f + t) else 0.5 end as lf, tf >= 0.35 and tt >= 0.35 as contra from m),
c as (select *, least(1.0, n / 4.0::double) * (0.45 + 0.55 * abs(2 * lf - 1)) * (0.5 + 0.5 * ind) as raw from k), r as (select *, case when claims then least(raw, 0.25) else raw end as capped from c),
o as (select supplier, n, round(lf, 4) as factory_likelihood, round(1 - lf, 4) as trader_likelihood, round(case when n = 0 then 0 when contra then capped * 0.45 else capped end, 4) as confidence, contra as contradictory from r)
select *, case when confidence < 0.4 then 'UNCERTAIN' when factory_likelihood >= 0.7 then 'FACTORY' when factory_likelihood <= 1 - 0.7::double then 'TRADER' else 'MIXED' end as classification from o""")
def identity_class(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "FACTORY").when(F.col("l_returnflag") == "R", "TRADER").otherwise("NEUTRAL")
    ev = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), kind.alias("direction"), (F.col("l_quantity") / 50).alias("strength"), (F.col("l_discount") * 10).alias("reliability"), F.when(F.col("l_linestatus") == "F", "SELF_CLAIM").otherwise("DOCUMENT").alias("source_kind"))
    return identity.classified(identity.masses(ev))


@query(f"""with {IDENTITY.replace('l_suppkey as supplier', 'l_orderkey as supplier')}, m as (select supplier, count(*) filter (direction <> 'NEUTRAL') as n, coalesce(max(strength * reliability) filter (direction = 'FACTORY'), 0) as tf, coalesce(max(strength * reliability) filter (direction = 'TRADER'), 0) as tt,
coalesce(max(reliability) filter (direction <> 'NEUTRAL' and source_kind <> 'SELF_CLAIM'), 0) as ind, coalesce(bool_and(source_kind = 'SELF_CLAIM') filter (direction <> 'NEUTRAL'), false) as claims from ev group by supplier)
select supplier, concat_ws(',', case when n = 0 then 'NO_DIRECTIONAL_EVIDENCE' end, case when claims then 'SELF_CLAIM_ONLY' end, case when tf >= 0.35 and tt >= 0.35 then 'CONTRADICTORY_EVIDENCE' end, case when n = 1 then 'LIMITED_EVIDENCE' end, case when ind < 0.5 and n > 0 and not claims then 'LOW_INDEPENDENT_RELIABILITY' end) as reasons from m""")
def identity_uncertainty(spark, d):
    """Orders in the place of suppliers, as they have few lines each."""
    kind = F.when(F.col("l_returnflag") == "A", "FACTORY").when(F.col("l_returnflag") == "R", "TRADER").otherwise("NEUTRAL")
    ev = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("supplier"), kind.alias("direction"), (F.col("l_quantity") / 50).alias("strength"), (F.col("l_discount") * 10).alias("reliability"), F.when(F.col("l_linestatus") == "F", "SELF_CLAIM").otherwise("DOCUMENT").alias("source_kind"))
    return identity.uncertainty(identity.masses(ev)).select("supplier", F.array_join("reasons", ",").alias("reasons"))


@query("""with p as (select p_partkey as supplier, p_size as factory_area_sqm, p_partkey % 4 as production_line_count, p_size % 3 as employee_count from part)
select supplier, 'factory_area_sqm' as source_field, factory_area_sqm::double as value, 0.75::double as strength from p where factory_area_sqm > 0 union all select supplier, 'production_line_count', production_line_count, 0.9 from p where production_line_count > 0
union all select supplier, 'employee_count', employee_count, 0.3 from p where employee_count > 0""")
def identity_numeric_evidence(spark, d):
    p = read_table(spark, d, "part").select(F.col("p_partkey").alias("supplier"), F.col("p_size").alias("factory_area_sqm"), (F.col("p_partkey") % 4).alias("production_line_count"), (F.col("p_size") % 3).alias("employee_count"), *(F.lit(None).cast("int").alias(c) for c in ("qc_staff_count", "rd_team_count", "equipment_count")))
    return identity.numeric_evidence(p).select("supplier", "source_field", "value", "strength")


# Serving ------------------------------------------------------------------------------------------------------------------------------


@query("""select o_orderkey as analysis_id, c_name as name, coalesce(n.n_name, 'unknown') as nation, lines, lines is not null as report_available, o_orderdate as created_at from orders o left join customer c on c.c_custkey = o.o_custkey
left join nation n on n.n_nationkey = c.c_nationkey left join (select l_orderkey, count(*) as lines from lineitem where l_returnflag = 'R' group by 1) l on l.l_orderkey = o.o_orderkey order by o_orderdate desc, o_orderkey desc limit 100""")
def history(spark, d):
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"))
    nation = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    users = read_table(spark, d, "customer").join(nation, "c_nationkey", "left").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), "n_name")
    snapshots = o.join(users, "user_id", "left").select("analysis_id", "name", F.coalesce("n_name", F.lit("unknown")).alias("nation"))
    reports = read_table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("analysis_id")).agg(F.count("*").alias("lines")).withColumn("report_id", F.col("analysis_id"))
    return serving.history(o, snapshots, reports, limit=100).select("analysis_id", "name", "nation", "lines", "report_available", "created_at")


@query("""with l as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders where o_orderstatus = 'O')
select c_custkey as user_id, c_name as name, o_orderkey as analysis_id, round(o_totalprice, 2) as total from customer left join l on l.o_custkey = c_custkey and r = 1""")
def watchlist_latest(spark, d):
    entries = read_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("supplier"), F.col("c_name").alias("name"))
    analyses = read_table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_custkey").alias("supplier"), F.col("o_orderkey").alias("analysis_id"), F.col("o_orderdate").alias("created_at"), F.round("o_totalprice", 2).alias("total"), F.when(F.col("o_orderstatus") == "O", "COMPLETED").alias("status"))
    return serving.watchlist(entries, analyses).select("user_id", "name", "analysis_id", "total")


@query("select d.doc_id, d.source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 0) order by d.source desc, d.doc_id limit 100")
def blind_sample_anti(spark, d):
    cases = read_table(spark, d, "documents").select("doc_id", "source")
    labels = read_table(spark, d, "labels").select("doc_id", F.col("toxic").alias("reviewer_id"))
    return serving.unlabelled(cases, labels, ["doc_id"], 0).orderBy(F.desc("source"), "doc_id").limit(100)


@query("""select c_custkey, c_mktsegment from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'F' and o.o_orderdate <= timestamp '1995-06-17' and o.o_orderdate + interval 90 days > timestamp '1995-06-17')""")
def entitlement_semi(spark, d):
    at = F.lit("1995-06-17").cast("timestamp_ntz")
    valid = read_table(spark, d, "orders").where("o_orderstatus = 'F'").where(serving.valid_at(F.col("o_orderdate"), F.expr("o_orderdate + interval 90 days"), at))
    users = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return users.join(valid.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("""select o_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' order by l_linenumber, l_returnflag) as items, count(*) as n from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey""")
def analysis_detail_events(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey")
    rows = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag").join(o, "o_orderkey")
    items = report.ordered_list(rows, "o_orderkey", "l_linenumber", "l_returnflag")
    return items.select("o_orderkey", F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["l_linenumber"], i["l_returnflag"])), ",").alias("items"), F.size("items").cast("bigint").alias("n"))


@query("select o_orderkey, round(o_totalprice, 2) as total from orders order by o_totalprice desc, o_orderkey limit 20")
def limit_ties_topk(spark, d):
    return read_table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", F.round("o_totalprice", 2).alias("total"))


@query("select 'document' as kind, source as key, count(*) as n from documents group by source union all select 'event', event_type, count(*) from events group by event_type union all select 'role', role, count(*) from conversations group by role")
def union_concat(spark, d):
    parts = [("document", "documents", "source"), ("event", "events", "event_type"), ("role", "conversations", "role")]
    frames = [read_table(spark, d, t).groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "key", "n") for k, t, c in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("""with t as (select doc_id, list_distinct(string_split(substr(lang || ',' || source, 1, 30), ',')) as tags from documents) select doc_id, len(list_filter(tags, lambda x: not list_contains(['en', 'de', 'src1', 'src2', 'src3'], x))) = 0 as allowed, len(list_filter(tags, lambda x: list_contains(['en', 'src1'], x))) as overlap from t""")
def array_subset_check(spark, d):
    tags = F.array_distinct(F.split(F.substring(F.concat_ws(",", "lang", "source"), 1, 30), ","))
    allowed, some = F.array(*map(F.lit, ["en", "de", "src1", "src2", "src3"])), F.array(F.lit("en"), F.lit("src1"))
    return read_table(spark, d, "documents").select("doc_id", (F.size(F.array_except(tags, allowed)) == 0).alias("allowed"), F.size(F.array_intersect(tags, some)).cast("bigint").alias("overlap"))


@query("""select l_orderkey as o_orderkey, count(*) filter (l_returnflag = 'R' or (l_returnflag = 'N' and l_linestatus = 'F')) as key_risks, count(*) filter (l_returnflag = 'A') as positive, count(*) filter (l_returnflag = 'N' and l_linestatus <> 'F') as other, max(l_quantity * 2) as max_severity from lineitem group by l_orderkey""")
def findings_partition(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "SUPPLIER_RISK").when(F.col("l_returnflag") == "A", "SUPPLIER_POSITIVE").otherwise("MEDIA_CONSISTENCY")
    f = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), kind.alias("finding_type"), (F.col("l_quantity") * 2).alias("severity"), F.when(F.col("l_linestatus") == "F", "CONTRADICTS").alias("consistency"))
    return report.parts(f, "o_orderkey")


@query("select o_orderkey as analysis_id, case when o_totalprice > 200000 then 'HIGH' when o_totalprice > 100000 then 'MODERATE' else 'LOW' end as risk_label, round(o_custkey % 12 / 12.0::double, 4) as completeness from orders")
def guest_preview(spark, d):
    p = F.col("o_totalprice")
    o = read_table(spark, d, "orders").withColumns({"analysis_id": F.col("o_orderkey"), "risk_label": F.when(p > 200000, "HIGH").when(p > 100000, "MODERATE").otherwise("LOW"), "completeness": F.round(F.col("o_custkey") % 12 / 12, 4)})
    return report.preview(o)


@query("""with f as (select l_orderkey, unnest([l_linenumber, l_linenumber + 1]) as evidence_id from lineitem where l_returnflag = 'R') select distinct f.l_orderkey as finding, f.evidence_id::bigint as evidence_id from f left join lineitem l on l.l_orderkey = f.l_orderkey and l.l_linenumber = f.evidence_id where l.l_orderkey is null""")
def finding_evidence_integrity(spark, d):
    line = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("finding"), F.col("l_linenumber").cast("bigint").alias("evidence_id"), "l_returnflag")
    findings = line.where("l_returnflag = 'R'").select("finding", F.array("evidence_id", F.col("evidence_id") + 1).alias("evidence_ids"))
    return report.missing_evidence(findings, line, "finding")


@query("""select role, count(*) as calls, sum(length(text)) as tokens, case when count(case when turn < 6 then length(text) * 0.25 end) = count(*) then round(sum(length(text) * 0.25), 4) end as cost from conversations group by role""")
def cost_rollup_null_strict(spark, d):
    c = read_table(spark, d, "conversations").select("role", F.length("text").alias("tokens"), F.when(F.col("turn") < 6, F.length("text") * 0.25).cast("double").alias("cost"))
    return c.groupBy("role").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.when(F.count("cost") == F.count("*"), F.round(F.sum("cost"), 4)).alias("cost"))


# Merge, sinks -------------------------------------------------------------------------------------------------------------------------


def _sides(spark, d):
    """The documents split into an older and a newer capture that overlap in two thirds of the items."""
    doc = read_table(spark, d, "documents").select(F.col("source").alias("owner"), F.col("doc_id").alias("item"), F.col("doc_id").alias("pos"), F.col("lang").alias("payload"))
    return doc.where("item % 3 <> 0"), doc.where("item % 3 <> 1").withColumn("payload", F.upper("payload"))


@query("""with o as (select source as owner, doc_id as item, doc_id as pos, lang as payload from documents where doc_id % 3 <> 0), n as (select source as owner, doc_id as item, doc_id as pos, upper(lang) as payload from documents where doc_id % 3 <> 1),
j as (select coalesce(n.owner, o.owner) as owner, coalesce(n.item, o.item) as item, coalesce(n.payload, o.payload) as payload, concat_ws(',', case when o.pos is not null then 'old' end, case when n.pos is not null then 'new' end) as lineage, n.pos is null as late, coalesce(n.pos, o.pos) as p from n full join o on n.owner = o.owner and n.item = o.item),
r as (select owner, item, payload, lineage, row_number() over (partition by owner order by late, p, item)::int as rank, greatest(count(*) over (partition by owner) - 20, 0) as omitted from j) select * from r where rank <= 20""")
def keyed_merge(spark, d):
    old, new = _sides(spark, d)
    return merge.keyed(old, new, ["owner", "item"])


@query("""with o as (select sha256(text) as k, count(*) as o from documents where doc_id % 3 <> 0 group by 1), n as (select sha256(text) as k, count(*) as n from documents where doc_id % 3 <> 1 group by 1)
select coalesce(o.k, n.k) as k, greatest(coalesce(o, 0), coalesce(n, 0)) as copies from o full join n on o.k = n.k""")
def multiset_merge(spark, d):
    t = read_table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("k"))
    return merge.multiset(t.where("doc_id % 3 <> 0"), t.where("doc_id % 3 <> 1"), "k")


@query("""with o as (select c_custkey as id, c_name as name, case when c_custkey % 2 = 0 then c_mktsegment end as segment from customer where c_custkey % 3 <> 0), n as (select c_custkey as id, case when c_custkey % 5 = 0 then null else upper(c_name) end as name, case when c_custkey % 4 = 0 then c_mktsegment || '!' end as segment from customer where c_custkey % 3 <> 1)
select coalesce(n.id, o.id) as id, coalesce(n.name, o.name) as name, coalesce(n.segment, o.segment) as segment, case when n.name is not null then 'new' when o.name is not null then 'old' end as name_from, case when n.segment is not null then 'new' when o.segment is not null then 'old' end as segment_from from n full join o on n.id = o.id""")
def scalar_coalesce_merge(spark, d):
    c = read_table(spark, d, "customer")
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    old = c.where(k % 3 != 0).select(k.alias("id"), F.col("c_name").alias("name"), F.when(k % 2 == 0, seg).alias("segment"))
    new = c.where(k % 3 != 1).select(k.alias("id"), F.when(k % 5 != 0, F.upper("c_name")).alias("name"), F.when(k % 4 == 0, F.concat(seg, F.lit("!"))).alias("segment"))
    return merge.scalars(old, new, "id", ["name", "segment"])


@query("with r as (select *, row_number() over (partition by lang, source order by n_chars, doc_id) as r from documents) select lang, source, doc_id, n_chars from r where r = 1")
def first_write_wins(spark, d):
    return merge.first_written(read_table(spark, d, "documents").select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], ["n_chars", "doc_id"])


@query("""with s as (select c_custkey as id, c_mktsegment as v from customer where c_custkey % 2 = 0), a as (select c_custkey as id, case when c_custkey % 6 = 0 then c_mktsegment || '*' else c_mktsegment end as v from customer)
select 'added' as outcome, count(*) as n from a where not exists (select 1 from s where s.id = a.id) union all select 'conflict', count(*) from a join s using (id) where a.v is distinct from s.v union all select 'replayed', count(*) from a join s using (id) where a.v is not distinct from s.v""")
def idempotent_insert(spark, d):
    c, k, seg = read_table(spark, d, "customer"), F.col("c_custkey"), F.col("c_mktsegment")
    stored = c.where(k % 2 == 0).select(k.alias("id"), seg.alias("v"))
    arriving = c.select(k.alias("id"), F.when(k % 6 == 0, F.concat(seg, F.lit("*"))).otherwise(seg).alias("v"))
    added, conflicts = serving.insert_absent(stored, arriving, ["id"], "v")
    outcome = arriving.join(added.select("id", F.lit("added").alias("a")), "id", "left").join(conflicts.select("id", F.lit("conflict").alias("c")), "id", "left")
    return outcome.groupBy(F.coalesce("a", "c", F.lit("replayed")).alias("outcome")).agg(F.count("*").alias("n"))


@query("""with s as (select s_suppkey as id, s_name as name, case when s_suppkey % 2 = 0 then s_acctbal end as bal from supplier where s_suppkey % 3 <> 0), a as (select s_suppkey as id, case when s_suppkey % 5 = 0 then null else lower(s_name) end as name, s_acctbal + 1 as bal from supplier where s_suppkey % 3 <> 1)
select coalesce(s.id, a.id) as id, coalesce(a.name, s.name) as name, round(coalesce(a.bal, s.bal), 2) as bal from s full join a on a.id = s.id""")
def supplier_upsert(spark, d):
    t, k = read_table(spark, d, "supplier"), F.col("s_suppkey")
    stored = t.where(k % 3 != 0).select(k.alias("id"), F.col("s_name").alias("name"), F.when(k % 2 == 0, F.col("s_acctbal")).alias("bal"))
    arriving = t.where(k % 3 != 1).select(k.alias("id"), F.when(k % 5 != 0, F.lower("s_name")).alias("name"), (F.col("s_acctbal") + 1).alias("bal"))
    return serving.upserted(stored, arriving, ["id"], ["name", "bal"]).withColumn("bal", F.round("bal", 2))


@query("select doc_id, (row_number() over (partition by doc_id order by p) - 1)::int as ordinal, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as p from documents)")
def review_children(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "line"))


# Admission and work state -------------------------------------------------------------------------------------------------------------


def _requests(spark, d) -> DataFrame:
    return read_table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("subject"), "ts")


@query("""with w as (select event_id as request_id, user_id as subject, floor(epoch(ts) / 86400)::bigint as window_number, row_number() over (partition by user_id, floor(epoch(ts) / 86400) order by ts, event_id)::int as place from events) select *, place <= 3 as accepted from w""")
def admission_window(spark, d):
    return admission.admitted(_requests(spark, d), 3, 86400, ["subject"]).select("request_id", "subject", "window_number", "place", "accepted")


@query("""with w as (select event_id, ts, user_id, floor(epoch(ts) / 86400) as w, row_number() over (partition by user_id, floor(epoch(ts) / 86400) order by ts, event_id) as own from events),
g as (select event_id, row_number() over (partition by w order by ts, event_id) as place from w where own <= 1), a as (select w.*, coalesce(place <= 20, false) as ok from w left join g using (event_id))
select event_id as request_id, case when ok then 'ACCEPTED' when count(*) filter (ok) over (partition by user_id, w) < 1 then 'GLOBAL_LIMIT' else 'OWN_LIMIT' end as outcome from a""")
def admission_two_level(spark, d):
    return admission.two_level(_requests(spark, d), 1, 20, 86400, "subject").select("request_id", "outcome")


@query("select user_id as subject, floor(epoch(ts) / 604800)::bigint as window_number, count(*) as requests, least(count(*), 5) as used, greatest(5 - count(*), 0) as remaining from events group by 1, 2")
def admission_usage(spark, d):
    return admission.usage(_requests(spark, d), 5, 604800, ["subject"])


@query("""with s as (select user_id, arg_max(event_type, event_id) as t, count(*) as attempts, max(ts) as last from events group by user_id),
c as (select user_id, case t when 'purchase' then 'COMPLETED' when 'error' then 'FAILED_FINAL' else 'QUEUED' end as status, attempts % 7 as attempts, last from s)
select user_id, case when status = 'COMPLETED' then 'completed' when status = 'FAILED_FINAL' or attempts >= 5 then 'final' when last + interval 5 minutes > timestamp '2024-01-30 12:00:00' then 'busy' when last + interval 1 day > timestamp '2024-01-30 12:00:00' then 'waiting' else 'acquired' end as outcome from c""")
def claim_state(spark, d):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    s = read_table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("t"), F.count("*").alias("n"), F.max("ts").alias("last"))
    status = F.when(F.col("t") == "purchase", "COMPLETED").when(F.col("t") == "error", "FAILED_FINAL").otherwise("QUEUED")
    return s.select("user_id", workflow.claim_outcome(status, F.expr("last + interval 5 minutes"), F.expr("last + interval 1 day"), F.col("n") % 7, now).alias("outcome"))


@query("""select event_id, case when event_type = 'error' or event_id % 8 + 1 >= 5 then 'FAILED_FINAL' else 'FAILED_RETRYABLE' end as status, case when event_type = 'error' or event_id % 8 + 1 >= 5 then null else least(2.0::double * pow(2.0, event_id % 8), 60) end as delay_seconds from events""")
def retry_backoff(spark, d):
    e = read_table(spark, d, "events")
    return e.select("event_id", workflow.failure(F.col("event_id") % 8 + 1, F.col("event_type") != "error", F.col("ts")).alias("f")).select("event_id", "f.status", "f.delay_seconds")


@query("select user_id, arg_max(event_type, event_id) as status, max(event_id) as event_id, count(*) as events from events group by user_id")
def latest_status(spark, d):
    return workflow.latest_status(read_table(spark, d, "events").select("user_id", F.col("event_type").alias("status"), "event_id"), "user_id")


# Pages --------------------------------------------------------------------------------------------------------------------------------


@query(r"""select page_id, 'https://' || lower(regexp_extract(url, '(?i)^https?://([^/?#@\s:]+)(?::\d+)?(/[^?#\s]*)?', 1)) || coalesce(nullif(regexp_extract(url, '(?i)^https?://([^/?#@\s:]+)(?::\d+)?(/[^?#\s]*)?', 2), ''), '/') as canonical,
lower(regexp_extract(url, '(?i)^https?://([^/?#@\s:]+)', 1)) as host from pages""")
def url_canonicalize(spark, d):
    u = F.col("url")
    return read_table(spark, d, "pages").select("page_id", urls.canonical(u).alias("canonical"), urls.host(u).alias("host"))


#: Addresses made of the pages' ids, in forms that are accepted and forms that are not; the SQL parses them by rules of its own.
ADDRESSES = {
    0: ("https://detail.1688.com/offer/", ".html?spm=a"), 1: ("https://item.taobao.com/item.htm?x=2&id=", ""), 2: ("https://shop", ".world.taobao.com/category.htm?v=1"), 3: ("https://www.alibaba.com/product-detail/Some-thing_", ".html"),
    4: ("https://co", ".en.alibaba.com/company_profile.html"), 5: ("https://m.1688.com/offer/", ".html"), 6: ("https://item.taobao.com/item.htm?id=1&id=", ""), 7: ("https://user@detail.1688.com/offer/", ".html"),
    8: ("https://shop", ".1688.com/"), 9: ("https://www.1688.com/factory/m", ".html"), 10: ("https://co", ".m.en.alibaba.com/index.html"), 11: ("http://detail.1688.com/offer/", ".html"),
}
_ADDRESS = "case page_id % 12 " + " ".join(f"when {k} then '{a}' || (100000 + page_id) || '{b}'" for k, (a, b) in ADDRESSES.items()) + " end"


def _addresses(spark, d) -> DataFrame:
    u, k = F.lit(None).cast("string"), F.col("page_id")
    for n, (a, b) in ADDRESSES.items():
        u = F.when(k % 12 == n, F.concat(F.lit(a), (100000 + k).cast("string"), F.lit(b))).otherwise(u)
    return read_table(spark, d, "pages").select("page_id", u.alias("u"))


@query(rf"""with a as (select page_id, {_ADDRESS} as u from pages), s as (select page_id, u, split_part(u, '?', 1) as p, string_split(split_part(u, '?', 2), '&') as q from a),
n as (select page_id, u, case when starts_with(p, 'https://detail.1688.com/offer/') then p when p = 'https://item.taobao.com/item.htm' and len(list_filter(q, lambda x: starts_with(x, 'id='))) = 1 then p || '?' || list_filter(q, lambda x: starts_with(x, 'id='))[1]
when starts_with(p, 'https://shop') and p like '%.taobao.com/%' then p when starts_with(p, 'https://www.alibaba.com/product-detail/') then p when p like 'https://%.en.alibaba.com/company_profile.html' and p not like '%.m.en.%' then p end as normalized from s)
select page_id, case when normalized like '%1688.com%' then '1688' when normalized like '%taobao.com%' then 'TAOBAO' when normalized is not null then 'ALIBABA' end as platform, normalized,
case when u like '%taobao.com%' then 'paused' when normalized like '%/offer/%' or normalized like '%/product-detail/%' then 'product' when normalized like '%/company_profile.html' then 'profile' when u like 'https://shop%.1688.com/' or u like '%.m.en.alibaba.com/%' then 'company' when u like '%/factory/%' then 'factory' else 'unsupported' end as page_kind,
case when u = normalized then u end as safe from n""")
def url_platform(spark, d):
    u = F.col("u")
    return _addresses(spark, d).select("page_id", urls.platform(u).alias("platform"), urls.normalize(u).alias("normalized"), urls.page_kind(u).alias("page_kind"), urls.safe_source(u).alias("safe"))


@query(rf"""with a as (select page_id, {_ADDRESS} as u from pages) select page_id, case when u like '%.en.alibaba.com/%' then 'https://co' || (100000 + page_id) || '.en.alibaba.com/' end as company, case when u like 'https://shop%.1688.com/' then u end as shop, case when u like '%/factory/%' then u end as factory,
case when page_id % 12 = 1 then 'item:' || (100000 + page_id) when page_id % 12 = 2 then 'shop:' || (100000 + page_id) when page_id % 12 = 3 then 'product:' || (100000 + page_id) when page_id % 12 = 4 then 'profile:co' || (100000 + page_id) end as identity from a""")
def url_identities(spark, d):
    u = F.col("u")
    return _addresses(spark, d).select("page_id", urls.company_alibaba(u).alias("company"), urls.shop_1688(u).alias("shop"), urls.factory_1688(u).alias("factory"), F.coalesce(urls.taobao_identity(u), urls.alibaba_identity(u)).alias("identity"))


@query("select page_id, sha256(html) as html_sha256, 'page:' || substr(sha256(url || html), 1, 16) as section_id from pages")
def page_sections(spark, d):
    return read_table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("html_sha256"), tx.section_id(F.lit("page"), F.col("url"), F.col("html")).alias("section_id"))


@query(None)
def html_text_extract(spark, d):
    return extraction.parsed(read_table(spark, d, "pages")).select("page_id", "title", F.length("body").alias("n_chars"), F.md5("body").alias("body_md5"), "links", "scripts", F.size("headings").alias("headings"))


@query("""with t as (select doc_id, case when doc_id % 5 = 0 then 'Security Verification' when doc_id % 7 = 0 then ' Sign in ' else lang end as title, case when doc_id % 11 = 0 then 'Please log in first' else text end as body, doc_id % 2 = 0 as evidence from documents)
select doc_id, case when title = 'Security Verification' or contains(lower(substr(body, 1, 2000)), 'captcha') or contains(lower(substr(body, 1, 2000)), 'access denied') then 'BLOCKED' when trim(title) = 'Sign in' or (not evidence and contains(lower(substr(body, 1, 2000)), 'please log in')) then 'AUTH_REQUIRED' end as access from t""")
def access_wall(spark, d):
    k = F.col("doc_id")
    t = read_table(spark, d, "documents").withColumns({"title": F.when(k % 5 == 0, "Security Verification").when(k % 7 == 0, " Sign in ").otherwise(F.col("lang")), "body": F.when(k % 11 == 0, "Please log in first").otherwise(F.col("text"))})
    return t.select("doc_id", extraction.access(F.col("title"), F.col("body"), evidence=k % 2 == 0).alias("access"))


@query(r"""with recursive s as (select doc_id as page, p as pos, substr(text, p * 700 + 1, 900) as text from (select doc_id, text, unnest(range(0, (least(length(text), 6000) + 699) // 700)) as p from documents) where length(substr(text, p * 700 + 1, 900)) >= 16),
i as (select page, pos, not regexp_matches(text, '(?i)refund|return|exchange|warranty|after.sales|certif|minimum.order|MOQ|payment|price') as late, text, md5(text) as section_id from s),
u as (select page, section_id, min(late) as late, min(pos) as pos, any_value(strlen(json_object('section_id', section_id, 'text', text)::varchar)) + 3 as size from i group by page, section_id), o as (select *, row_number() over (partition by page order by late, pos) as n from u),
f(page, n, used, kept, taken) as (select page, 0::bigint, 146::bigint, 0, null::bigint from (select distinct page from o) union all select f.page, o.n, case when f.kept < 24 and f.used + o.size + case when f.kept > 0 then 2 else 0 end <= 2500 then f.used + o.size + case when f.kept > 0 then 2 else 0 end else f.used end,
case when f.kept < 24 and f.used + o.size + case when f.kept > 0 then 2 else 0 end <= 2500 then f.kept + 1 else f.kept end, case when f.kept < 24 and f.used + o.size + case when f.kept > 0 then 2 else 0 end <= 2500 then o.pos end from f join o on o.page = f.page and o.n = f.n + 1)
select page, count(taken) as sections, max(used) as used, count(*) - 1 > count(taken) as truncated from f group by page having count(taken) > 0""")
def context_greedy_budget(spark, d):
    """A document is a page here and its chunks are the sections: a page's sections are bounded by the first 6000 characters that they start in."""
    s = read_table(spark, d, "documents").select(F.col("doc_id").alias("page"), F.posexplode(tx.chunks(F.col("text"))).alias("pos", "text")).select("page", "pos", F.md5("text").alias("section_id"), "text")
    return extraction.budgeted(s, "page", most=2500).groupBy("page").agg(F.count("*").alias("sections"), F.max("used").cast("bigint").alias("used"), F.bool_or("truncated").alias("truncated"))


@query("select doc_id, false as phrase, contains(text, substr(text, 20, 18)) and length(trim(substr(text, 20, 18))) >= 16 as own_words, false as short from documents")
def quote_support(spark, d):
    fragments = F.array("text", "lang")
    return read_table(spark, d, "documents").select("doc_id", extraction.quote_supported(F.lit("and this is why"), fragments).alias("phrase"), extraction.quote_supported(F.substring("text", 20, 18), fragments).alias("own_words"), extraction.quote_supported(F.col("lang"), fragments).alias("short"))


@query("""with b as (select c_custkey as id, c_name as name, case when c_custkey % 2 = 0 then c_mktsegment end as seg from customer), n as (select c_custkey as id, case when c_custkey % 3 = 0 then 'other' else c_name end as name, c_mktsegment as seg from customer where c_custkey % 4 <> 0)
select b.id, b.name, case when n.id is not null and b.name = n.name and b.seg is null then n.seg else b.seg end as seg, case when n.id is not null and b.name = n.name and b.seg is null and n.seg is not null then 'candidate' else 'base' end as taken from b left join n using (id)""")
def browser_gain(spark, d):
    c, k = read_table(spark, d, "customer"), F.col("c_custkey")
    base = c.select(k.alias("id"), F.col("c_name").alias("name"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("seg"))
    new = c.where(k % 4 != 0).select(k.alias("id"), F.when(k % 3 == 0, "other").otherwise(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("seg"))
    return extraction.better(base, new, "id", ["name", "seg"])


@query("select l_orderkey as review_id, round(avg(1 + (case l_returnflag when 'A' then 1.1 when 'R' then 0.5 else 1.0 end::double - 1) * l_discount * 10), 6) as factor from lineitem group by l_orderkey")
def media_review_factors(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "SUPPORTS").when(F.col("l_returnflag") == "R", "CONTRADICTS").otherwise("CANNOT_DETERMINE")
    found = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("review_id"), kind.alias("consistency"), (F.col("l_discount") * 10).alias("confidence"))
    return models.media_factors(found).withColumn("factor", F.round("factor", 6))


# Policy and accounts ------------------------------------------------------------------------------------------------------------------


@query("""with f as (select doc_id, source as supplier, case doc_id % 6 when 0 then 'QUALITY' when 1 then 'DELIVERY' when 2 then 'AFTER_SALES' when 3 then 'PRODUCT_MISMATCH' when 4 then 'PACKAGING' else 'OTHER' end as category, case n_chars % 4 when 0 then 'NONE' when 1 then 'LOW' when 2 then 'MEDIUM' else 'HIGH' end as l, (n_chars % 10) / 10.0::double as confidence, n_chars % 3 as reviews, (doc_id % 5) / 4.0::double as rel, case doc_id % 4 when 0 then null when 1 then 0.5 else 1.1 end::double as media from documents)
select doc_id, supplier, case category when 'DELIVERY' then 'DELIVERY' when 'AFTER_SALES' then 'AFTER_SALES' else 'PRODUCT_QUALITY' end as dimension, case l when 'LOW' then 25.0 when 'MEDIUM' then 55.0 else 80.0 end::double as severity,
round(least(1.0, rel * confidence * coalesce(media, 1.0), case when category = 'AFTER_SALES' then case when reviews < 2 then 0.4 else 0.6 end else 1.0 end), 6) as reliability from f where category <> 'OTHER' and l <> 'NONE'""")
def review_score_inputs(spark, d):
    k, n = F.col("doc_id"), F.col("n_chars")
    category = F.element_at(F.array(*map(F.lit, ["QUALITY", "DELIVERY", "AFTER_SALES", "PRODUCT_MISMATCH", "PACKAGING", "OTHER"])), (k % 6 + 1).cast("int"))
    label = F.element_at(F.array(*map(F.lit, ["NONE", "LOW", "MEDIUM", "HIGH"])), (n % 4 + 1).cast("int"))
    media = F.when(k % 4 == 1, 0.5).when(k % 4 > 1, 1.1)
    f = read_table(spark, d, "documents").select("doc_id", F.col("source").alias("supplier"), category.alias("category"), label.alias("severity_label"), (n % 10 / 10).alias("confidence"), (k % 5 / 4).alias("review_reliability"), media.alias("media_factor"), (n % 3).alias("accessible_reviews"))
    return policy.score_inputs(f).select("doc_id", "supplier", "dimension", "severity", F.round("reliability", 6).alias("reliability"))


@query(f"""with c as (select user_id as supplier, count(*) as n, count(*) filter (value > 25) / count(*)::double as conf, user_id % 3 = 0 as no_t, user_id % 4 = 0 as no_r from events group by 1), b as (select distinct user_id as supplier from events where event_type = 'error' and value > 45)
select supplier, 'review-sample:credibility' as evidence_id, 'REVIEW_MANIPULATION' as dimension, 35.0::double as severity, round(least(conf, 0.6, case when no_t then 0.45 else 1 end, case when no_r then 0.4 else 1 end), 6) as confidence from c where n >= 10 and supplier not in (select supplier from b)""")
def preliminary_credibility(spark, d):
    e = read_table(spark, d, "events").withColumnRenamed("user_id", "supplier")
    counts = e.groupBy("supplier").agg(F.count("*").alias("review_count"), (F.count_if(F.col("value") > 25) / F.count("*")).alias("review_confidence")).withColumns({"no_timestamps": F.col("supplier") % 3 == 0, "no_ratings": F.col("supplier") % 4 == 0})
    return policy.preliminary_credibility(counts, e.where("event_type = 'error' and value > 45")).withColumn("confidence", F.round("confidence", 6))


@query("""with t as (select doc_id, case doc_id % 5 when 0 then 'SUPPLIER_IDENTITY' when 1 then 'AFTER_SALES' when 2 then 'PRICING' else 'PRODUCT_QUALITY' end as dim, case n_chars % 3 when 0 then 'UNKNOWN' when 1 then 'HIGH' else 'LOW' end as sev,
case when doc_id % 11 = 0 then 'none' when doc_id % 13 = 0 then 'unquoted' when doc_id % 2 = 0 then 'reviews' else 'page_context' end as f, n_chars % 4 as reviews, substr(text, 1, 40) as q, (n_chars % 10) / 10.0 as conf from documents)
select doc_id, case when dim = 'SUPPLIER_IDENTITY' then 'skipped' when sev = 'UNKNOWN' then 'unknown severity' when f = 'none' then 'no fields' when f = 'unquoted' then 'fields are not quoted' when (dim = 'PRODUCT_QUALITY' and f = 'page_context') or (dim = 'PRICING' and f = 'reviews') then 'out of scope'
when f = 'page_context' and length(trim(q)) < 16 then 'no such passage' when f = 'page_context' and dim = 'AFTER_SALES' and not regexp_matches(q, '(?i)refund|return|exchange|warranty|after.sales|dispute|compensation') then 'off topic'
when f = 'page_context' and dim = 'PRICING' and not regexp_matches(q, '(?i)USD|CNY|RMB|price|MOQ|minimum|payment') then 'off topic' when f = 'reviews' and q = '' then 'quote not in the source' when f = 'reviews' and reviews < 2 and not (dim = 'AFTER_SALES' and sev = 'HIGH') then 'too few reviews' when conf <= 0 then 'no confidence' end as rejection from t""")
def dimension_gates(spark, d):
    k, n, none = F.col("doc_id"), F.col("n_chars"), F.array().cast("array<string>")
    dim = F.when(k % 5 == 0, "SUPPLIER_IDENTITY").when(k % 5 == 1, "AFTER_SALES").when(k % 5 == 2, "PRICING").otherwise("PRODUCT_QUALITY")
    sev = F.when(n % 3 == 0, "UNKNOWN").when(n % 3 == 1, "HIGH").otherwise("LOW")
    one = F.when(k % 2 == 0, "reviews").otherwise("page_context")
    fields = F.when(k % 11 == 0, none).otherwise(F.array(one))
    quotes = F.when(k % 13 == 0, F.create_map(F.lit("products"), F.lit("x"))).otherwise(F.create_map(one, F.substring("text", 1, 40)))
    metrics = F.lit(None).cast("array<struct<label:string,value:string>>")
    rows = read_table(spark, d, "documents").select("doc_id", "n_chars", "text", dim.alias("dim"), sev.alias("sev"), fields.alias("fields"), quotes.alias("quotes"), F.create_map(one, F.array("text")).alias("fragments"))
    return rows.select("doc_id", policy.gate(F.col("dim"), F.col("sev"), F.col("fields"), F.col("quotes"), F.col("fragments"), metrics, n % 4, n % 10 / 10).alias("rejection"))


@query("select c_custkey, c_name from customer where contains(lower(c_name), '12') or contains(lower(c_mktsegment), '12') or contains(c_custkey::varchar, '12')")
def history_search(spark, d):
    return read_table(spark, d, "customer").where(policy.matches("12", F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey"))).select("c_custkey", "c_name")


@query("""with e as (select o_custkey as user_id, o_orderpriority as entitlement, o_orderdate as starts_at, case when o_orderkey % 4 <> 0 then o_orderdate + interval 400 days end as expires_at, case when o_orderstatus = 'O' then 'ACTIVE' else 'ENDED' end as status from orders),
a as (select *, status = 'ACTIVE' and starts_at <= timestamp '1998-01-01' and (expires_at is null or expires_at > timestamp '1998-01-01') as active from e), r as (select user_id, entitlement, active, row_number() over (partition by user_id order by active desc, starts_at desc, entitlement) as r from a),
u as (select o_custkey as user_id, count(*) as used from orders group by 1)
select c_custkey as user_id, entitlement, coalesce(active, false) as active, case when coalesce(active, false) then 40 else 20 end as "limit", coalesce(used, 0) as used, greatest(case when coalesce(active, false) then 40 else 20 end - coalesce(used, 0), 0) as remaining
from customer left join r on r.user_id = c_custkey and r.r = 1 left join u on u.user_id = c_custkey""")
def account_state(spark, d):
    o = read_table(spark, d, "orders")
    ent = o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("entitlement"), F.col("o_orderdate").alias("starts_at"), F.when(F.col("o_orderkey") % 4 != 0, F.expr("o_orderdate + interval 400 days")).alias("expires_at"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("ENDED").alias("status"))
    used = o.groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("used"))
    users = read_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return policy.account_state(users, ent, used, F.lit("1998-01-01").cast("timestamp_ntz"))


@query("""with w as (select lang as k, count(*) as w from documents group by lang), p as (select lang as k, count(*) as p from documents where doc_id % 3 = 0 and lang <> 'es' group by lang) select k, w - coalesce(p, 0) as missing from w left join p using (k) where w > coalesce(p, 0)""")
def multiset_difference(spark, d):
    t = read_table(spark, d, "documents").select(F.col("lang").alias("k"), "doc_id")
    return policy.missing_copies(t, t.where("doc_id % 3 = 0 and k <> 'es'"), "k")


@query("select o_custkey as supplier, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as earliest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as latest from orders group by o_custkey")
def earliest_and_latest_capture(spark, d):
    at = F.struct("o_orderdate", "o_orderkey")
    return read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("supplier")).agg(F.min_by("o_orderkey", at).alias("earliest"), F.max_by("o_orderkey", at).alias("latest"))


@query("""select l_suppkey as supplier, l_orderkey as order_id, l_linenumber as line, l_linestatus as status from lineitem where l_shipdate <= timestamp '1995-06-17' and l_returnflag = 'R' order by l_shipdate, l_orderkey, l_linenumber, l_suppkey limit 10""")
def expired_oldest_first(spark, d):
    rows = read_table(spark, d, "lineitem").where((F.col("l_shipdate") <= F.lit("1995-06-17").cast("timestamp_ntz")) & (F.col("l_returnflag") == "R"))
    return rows.orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey").limit(10).select(F.col("l_suppkey").alias("supplier"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("status"))


@query(f"with {SIGNALS}, {RISKS}, {CONFIDENCES} select supplier, dimension, risk >= 55 and confidence >= 0.4 and dimension <> 'REVIEW_MANIPULATION' as material from risks join conf using (supplier, dimension)")
def material_findings(spark, d):
    signals = _signals(spark, d)
    joined = scoring.dimension_risk(signals).join(_confidences(signals), ["supplier", "dimension"])
    return joined.select("supplier", "dimension", policy.material(F.col("dimension"), F.col("risk"), F.col("confidence")).alias("material"))
