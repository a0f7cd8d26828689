"""The registered queries on evidence: findings, reports, claims and provenance, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import claims
from attesta.operators import findings, platforms, policy, report, serving, similarity, workflow
from attesta.plans.registry import query
from attesta.sources.tables import read_table, spread

NOW = "1995-06-17 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _pick(of, *names: str):
    """One of the names by a number."""
    return F.element_at(F.array(*map(F.lit, names)), (of % len(names) + 1).cast("int"))


# Claims -------------------------------------------------------------------------------------------------------------------------------


@query("""with p as (select p_partkey, p_size, '企业面积: ' || p_size || ' 平方米; 生产线数量: ' || (p_size % 4) || '条; 工厂面积: ' || p_size || '㎡;厂房面积: ' || (p_size + p_partkey % 2) || 'm2; 设备总数: many; 员工总数: ' || p_brand || '; other: x' as t from part)
select p_partkey, nullif(p_size, 0)::double as company_area_sqm, case when p_partkey % 2 = 0 then nullif(p_size, 0) when p_size = 0 then 1 end::double as factory_area_sqm, nullif(p_size % 4, 0)::double as production_line_count, null::double as equipment_count, p_brand as employee_count_display_text, len(string_split(t, ';')) - 1 as labels from p join part using (p_partkey, p_size)""")
def factory_claims(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    s = lambda c: c.cast("string")
    text = F.concat(F.lit("企业面积: "), s(n), F.lit(" 平方米; 生产线数量: "), s(n % 4), F.lit("条; 工厂面积: "), s(n), F.lit("㎡;厂房面积: "), s(n + k % 2), F.lit("m2; 设备总数: many; 员工总数: "), F.col("p_brand"), F.lit("; other: x"))
    p = read_table(spark, d, "part").select("p_partkey", claims.labelled_claims(text).alias("c"))
    return p.select("p_partkey", F.size("c").cast("bigint").alias("labels"), claims.factory_numbers(F.col("c")).alias("f")).select("p_partkey", "labels", *(f"f.{c}" for c in ("company_area_sqm", "factory_area_sqm", "production_line_count", "equipment_count", "employee_count_display_text")))


@query("""select p_partkey, case p_partkey % 4 when 0 then p_size when 1 then p_size end::int as years, list_filter([case when contains(lower(p_type), 'brass') then 'FACTORY' end, case when p_partkey % 3 = 0 then 'TRADER' end], lambda x: x is not null).array_to_string(',') as directions,
lower(case when p_partkey % 2 = 0 then p_brand else 'HTTPS://X/' || p_partkey end) as product_key, (floor(p_size / 50 * 100 + 0.5)::bigint)::varchar || '%' as percent, (least(100, floor(p_size / 25 * 100 + 0.5))::bigint)::varchar || '%' as bar,
sha256(p_name) as media_sha256 from part""")
def claim_scalars(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    age = F.when(k % 4 == 0, F.concat(n.cast("string"), F.lit("年老店"))).when(k % 4 == 1, F.concat(n.cast("string"), F.lit(" yrs"))).when(k % 4 == 2, F.concat(n.cast("string"), F.lit(" years")))
    kind = F.concat_ws(" ", F.when(F.contains(F.lower("p_type"), F.lit("brass")), "Manufacturer of"), F.lit("goods"), F.when(k % 3 == 0, "Trading Co"))
    offer = F.when(k % 2 == 0, F.col("p_brand")).otherwise("")
    url = F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("p_name").cast("binary")))
    return read_table(spark, d, "part").select(
        "p_partkey", claims.years_active(age).alias("years"), F.array_join(claims.business_directions(kind), ",").alias("directions"), claims.product_key(offer, F.concat(F.lit("HTTPS://X/"), k.cast("string"))).alias("product_key"),
        claims.percent(n / 50).alias("percent"), claims.bar_width(n / 25).alias("bar"), claims.media_fingerprint(url).alias("media_sha256"),
    )


@query("""select o_orderkey, case o_orderkey % 5 when 0 then 'unsupported field' when 1 then 'quote of no length' when 2 then 'conflicting quotes' end as error, case when o_orderkey % 5 > 2 then o_clerk_quote end as quote, case when o_orderkey % 5 > 2 then 1 end::bigint as fields from (select o_orderkey, o_orderpriority as o_clerk_quote from orders)""")
def quotes_canonical(spark, d):
    k, text = F.col("o_orderkey"), F.col("o_orderpriority")
    other = F.when(k % 5 == 0, F.create_map(F.lit("notes"), F.lit("x"))).when(k % 5 == 1, F.create_map(F.lit("products"), F.lit(" "))).when(k % 5 == 2, F.create_map(F.lit("reviews.1"), F.lit("other"))).when(k % 5 == 3, F.create_map(F.lit("reviews.2"), text)).otherwise(F.create_map(F.lit("products"), F.lit(None).cast("string")))
    q = claims.canonical_quotes(F.map_concat(F.create_map(F.lit("reviews.0.text"), text), other), ["reviews", "products"])
    return read_table(spark, d, "orders").select("o_orderkey", q.alias("q")).select("o_orderkey", "q.error", F.col("q.quotes")["reviews"].alias("quote"), F.when(F.col("q.quotes").isNotNull(), F.size("q.quotes")).cast("bigint").alias("fields"))


@query("""select event_id, event_id % 4 = 0 as storable from events""")
def storable_json(spark, d):
    k, v = F.col("event_id"), F.col("value").cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit('{"a": '), v, F.lit("}"))).when(k % 4 == 1, F.concat(F.lit('{"a": '), v, F.lit(', "a": 1}'))).when(k % 4 == 2, F.lit('{"a": "\\u0000"}')).otherwise(F.concat(F.lit('{"a": NaN, "b": '), v))
    return read_table(spark, d, "events").select("event_id", claims.storable(text).alias("storable"))


# Findings -----------------------------------------------------------------------------------------------------------------------------


def _runs(spark, d) -> DataFrame:
    """Orders as model runs: their lines are signals, by return flag."""
    l = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("supplier"), "l_linenumber", "l_returnflag", F.col("l_discount").alias("confidence"), F.when(F.col("l_linestatus") == "F", "reviews").otherwise("rating").alias("field"))  # noqa: E741
    signal = F.struct("l_linenumber", "confidence", F.array("field").alias("evidence_fields"))
    of = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == flag, signal))), lambda s: F.struct(s["confidence"].alias("confidence"), s["evidence_fields"].alias("evidence_fields")))
    return l.repartition(spread(l), "supplier").groupBy("supplier").agg(of("A").alias("positive"), of("R").alias("risk"), of("N").alias("uncertainty"))


@query("""with k as (select l_orderkey as supplier, case l_returnflag when 'A' then 'positive' when 'R' then 'risk' else 'uncertainty' end as kind, l_discount::double as confidence, row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber, l_discount) - 1 as n from lineitem)
select supplier, 'supplier_' || kind || ':' || n as finding_key, 'SUPPLIER_' || upper(kind) as finding_type, null::varchar as dimension, null::double as severity, confidence from k""")
def supplier_findings(spark, d):
    return findings.supplier_findings(_runs(spark, d))


@query("select distinct l_orderkey as supplier, 'supplier:' || case when l_linestatus = 'F' then 'reviews' else 'rating' end as evidence_id, 'SUPPLIER_DATA' as source_kind, case when l_linestatus = 'F' then 'reviews' else 'rating' end as source_field from lineitem")
def supplier_evidence(spark, d):
    return findings.supplier_evidence(_runs(spark, d))


LEXICON = {"DELIVERY": ["tion"], "QUALITY": ["schen"]}


@query(r"""with f as (select source as supplier, doc_id, trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')) as t from documents), c as (select supplier, doc_id, unnest(list_filter([case when contains(t, 'tion') then 'DELIVERY' end, case when contains(t, 'schen') then 'QUALITY' end], lambda x: x is not null)) as category from f),
g as (select supplier, category, count(*) as n, row_number() over (partition by supplier order by category) - 1 as number from c group by supplier, category having count(*) >= 2) select supplier, 'review-topic:' || number || ':' || category as finding_key, 'REVIEW_COMPLAINT_TOPIC' as finding_type, case category when 'DELIVERY' then 'DELIVERY' else 'PRODUCT_QUALITY' end as dimension, null::double as severity, 1.0::double as confidence from g""")
def topic_findings(spark, d):
    r = read_table(spark, d, "documents").select(F.col("source").alias("supplier"), F.col("doc_id").cast("string").alias("evidence_id"), "text")
    return findings.topic_findings(findings.topics(r, LEXICON))


@query("""with f as (select l_orderkey as supplier, l_linenumber as number, case l_linenumber % 3 when 0 then 'QUALITY' when 1 then 'DELIVERY' else 'OTHER' end as category, case l_returnflag when 'A' then 'LOW' when 'R' then 'HIGH' else 'NONE' end as s, l_discount::double as confidence from lineitem)
select supplier, 'review:' || number || ':' || category || ':review:' || number as finding_key, 'REVIEW_FINDING' as finding_type, case category when 'QUALITY' then 'PRODUCT_QUALITY' when 'DELIVERY' then 'DELIVERY' end as dimension, case s when 'LOW' then 25 when 'HIGH' then 80 else 0 end::double as severity, confidence from f
union all select supplier, 'review-pattern:' || number || ':TIMING_BURST', 'REVIEW_PATTERN', 'REVIEW_MANIPULATION', confidence * 100, confidence from f""")
def review_findings(spark, d):
    n, flag = F.col("number"), F.col("l_returnflag")
    l = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("supplier"), F.col("l_linenumber").alias("number"), "l_returnflag", F.col("l_discount").cast("double").alias("confidence"))  # noqa: E741
    f = l.select("supplier", "number", _pick(n, "QUALITY", "DELIVERY", "OTHER").alias("category"), F.when(flag == "A", "LOW").when(flag == "R", "HIGH").otherwise("NONE").alias("severity_label"), "confidence", F.array(F.concat(F.lit("review:"), n.cast("string"))).alias("evidence_ids"))
    p = l.select("supplier", "number", F.lit("TIMING_BURST").alias("kind"), F.col("confidence").alias("strength"), F.col("confidence").alias("reliability"))
    return findings.review_findings(f).unionByName(findings.pattern_findings(p))


@query("""with a as (select s_suppkey as supplier, (s_suppkey % 10) / 10.0::double as confidence, s_suppkey % 3 = 0 as c from supplier) select supplier, 'identity:assessment' as finding_key, case when c then 60 end::double as severity, confidence, case when c then greatest(confidence, 0.25) end::double as reliability from a""")
def identity_findings(spark, d):
    k = F.col("s_suppkey")
    a = read_table(spark, d, "supplier").select(k.alias("supplier"), (k % 10 / 10).alias("confidence"), (k % 3 == 0).alias("contradictory"))
    inputs = findings.identity_inputs(a).select("supplier", "reliability")
    return findings.identity_findings(a).select("supplier", "finding_key", "severity", "confidence").join(inputs, "supplier", "left")


@query("""with p as (select s_suppkey as supplier, case s_suppkey % 4 when 0 then ['FACTORY'] when 1 then ['TRADER'] when 2 then ['FACTORY', 'TRADER'] else [] end as d from supplier), e as (select supplier, unnest(d) as direction from p)
select supplier, 'company_information.business_type.' || lower(direction) as evidence_id, direction, 0.75::double as strength, 0.55::double as reliability from e union all select s_suppkey, 'certifications.present', 'NEUTRAL', 0, 0.5 from supplier where s_suppkey % 5 = 0""")
def identity_business_evidence(spark, d):
    k = F.col("s_suppkey")
    kind = _pick(k, "A factory", "Wholesale trader", "Manufacturer and trading company", "Shop")
    cert = F.when(k % 5 == 0, F.array(F.lit("ISO"))).otherwise(F.array().cast("array<string>"))
    p = read_table(spark, d, "supplier").select(k.alias("supplier"), claims.business_directions(kind).alias("directions"), cert.alias("certifications"))
    return findings.business_evidence(p).select("supplier", "evidence_id", "direction", "strength", "reliability")


@query("""with p as (select s_suppkey as supplier, s_suppkey % 3 as m from supplier where s_suppkey % 5 > 0) select supplier, 'factory_profile_source_url' as field, 'FACTORY' as direction, 0.35::double as strength from p union all select supplier, 'factory_profile_claims.company_area', 'NEUTRAL', 0 from p where m = 0
union all select supplier, 'factory_profile_claims.staffing', 'NEUTRAL', 0 from p union all select supplier, 'processing_methods_display_text', 'FACTORY', 0.6 from p where m = 1""")
def identity_factory_claims(spark, d):
    k = F.col("s_suppkey")
    text = F.concat(F.lit("员工总数: 10"), F.when(k % 3 == 0, "; 企业面积: 5㎡").otherwise(""), F.when(k % 3 == 1, "; 加工方式: 来样加工").otherwise(""))
    p = read_table(spark, d, "supplier").select(k.alias("supplier"), F.when(k % 5 > 0, "https://www.1688.com/factory/ab.html").alias("profile_url"), claims.labelled_claims(text).alias("claims"))
    return findings.factory_claim_evidence(p).select("supplier", F.substring("evidence_id", len("company_information.") + 1, 100).alias("field"), "direction", "strength")


@query("""with e as (select l_orderkey as supplier, l_partkey % 4 as evidence_id, 1 as g, l_linestatus as payload from lineitem where l_returnflag = 'R' union all select l_orderkey, l_partkey % 4, 2, l_linestatus from lineitem where l_returnflag <> 'R') select supplier, evidence_id, arg_min(payload, (g, payload)) as payload from e group by all""")
def evidence_first_written(spark, d):
    rows = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("supplier"), (F.col("l_partkey") % 4).alias("evidence_id"), "l_returnflag", F.col("l_linestatus").alias("payload"))
    return findings.first_written(rows.where("l_returnflag = 'R'").drop("l_returnflag"), rows.where("l_returnflag <> 'R'").drop("l_returnflag"))


@query("""with r as (select conv_id as supplier, role as run_kind, turn as created_at, length(text) as p, turn as c, case when turn < 6 then length(text) * 0.25 end::double as cost from conversations) select supplier, run_kind, count(*) as calls, sum(p)::bigint as prompt_tokens, sum(c)::bigint as completion_tokens, sum(p + c)::bigint as total_tokens,
case when count(cost) = count(*) then round(sum(cost), 4) end as cost_usd, case when count(cost) = count(*) then 'REPORTED' else 'UNAVAILABLE' end as cost_status, max(p) as latency_ms, min(created_at) as created_at from r group by all""")
def model_run_provenance(spark, d):
    n = F.length("text")
    r = read_table(spark, d, "conversations").select(F.col("conv_id").alias("supplier"), F.col("role").alias("run_kind"), n.alias("prompt_tokens"), F.col("turn").alias("completion_tokens"), F.when(F.col("turn") < 6, n * 0.25).cast("double").alias("cost_usd"), n.cast("bigint").alias("latency_ms"), F.col("turn").alias("created_at"))
    return findings.model_runs(r).withColumn("cost_usd", F.round("cost_usd", 4))


@query("""with b as (select l_suppkey as supplier, case when l_linenumber % 2 = 0 then 'DELIVERY' else 'PRICING' end as dimension, l_linestatus = 'F' as review_derived, l_orderkey, l_linenumber from lineitem), h as (select distinct o_custkey as supplier, 'DELIVERY' as dimension from orders where o_orderstatus = 'F')
select b.supplier, b.dimension, count(*) as claims from b left join h using (supplier, dimension) where h.supplier is null or not review_derived group by all""")
def review_overlap(spark, d):
    c = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.when(F.col("l_linenumber") % 2 == 0, "DELIVERY").otherwise("PRICING").alias("dimension"), (F.col("l_linestatus") == "F").alias("review_derived"))
    held = read_table(spark, d, "orders").select(F.col("o_custkey").alias("supplier"), F.lit("DELIVERY").alias("dimension"), (F.col("o_orderstatus") == "F").alias("review_derived"))
    return policy.without_review_overlap(c, held).groupBy("supplier", "dimension").agg(F.count("*").alias("claims"))


@query("""with s as (select s_suppkey as supplier, s_suppkey % 12 as n, (s_suppkey % 7) / 7.0::double as run, (s_suppkey % 5) / 5.0::double as rev, case when s_suppkey % 3 = 0 then (s_suppkey % 11) / 11.0 end::double as ident from supplier)
select supplier, round(list_avg(list_filter([run, case when n > 0 then rev end, ident], lambda x: x is not null)), 6) as source_reliability, round(least(1.0, n / 8.0::double), 6) as sample_adequacy, case when supplier % 4 = 0 then 0 else 1 end::double as data_freshness from s""")
def confidence_factors(spark, d):
    k = F.col("s_suppkey")
    f = policy.confidence_factors(k % 7 / 7, k % 5 / 5, F.when(k % 3 == 0, k % 11 / 11), k % 12, k % 4 == 0)
    return read_table(spark, d, "supplier").select(k.alias("supplier"), f.alias("f")).select("supplier", F.round("f.source_reliability", 6).alias("source_reliability"), F.round("f.sample_adequacy", 6).alias("sample_adequacy"), "f.data_freshness")


@query("""select user_id, count(*) as reviews, round(count(*) filter (event_id % 3 > 0) / count(*)::double, 4) as timing_coverage from events group by user_id""")
def timing_coverage(spark, d):
    e = read_table(spark, d, "events").select("user_id", F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("ts"))
    return e.groupBy("user_id").agg(F.count("*").alias("reviews"), F.round(F.avg(F.col("ts").isNotNull().cast("double")), 4).alias("timing_coverage"))


# Reports ------------------------------------------------------------------------------------------------------------------------------


def _report_rows(spark, d) -> tuple[DataFrame, DataFrame]:
    l = read_table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("number"), "l_returnflag", "l_linestatus", F.col("l_quantity").cast("double").alias("severity"), F.col("l_discount").cast("double").alias("confidence"))  # noqa: E741
    kind = F.when(F.col("l_returnflag") == "R", "SUPPLIER_RISK").when(F.col("l_returnflag") == "A", "SUPPLIER_POSITIVE").otherwise("MEDIA_CONSISTENCY")
    f = l.select(F.col("l_orderkey").alias("report"), "number", F.concat(F.lit("k"), F.col("number").cast("string")).alias("finding_key"), kind.alias("finding_type"), "severity", "confidence", F.when(F.col("l_linestatus") == "F", "CONTRADICTS").otherwise("SUPPORTS").alias("consistency"), F.array((F.col("number") % 3).cast("string")).alias("evidence_ids"))
    e = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("report"), F.explode(F.array(F.lit("0"), F.lit("1"))).alias("evidence_id"))
    return f, e


@query("""with f as (select l_orderkey as report, l_linenumber as n, case when l_returnflag = 'R' or (l_returnflag = 'N' and l_linestatus = 'F') then 'key' when l_returnflag = 'A' then 'pos' else 'other' end as part from lineitem)
select report, coalesce(string_agg(n::varchar, ',' order by n) filter (part = 'key'), '') as key_risks, coalesce(string_agg(n::varchar, ',' order by n) filter (part = 'pos'), '') as positive_signals, count(*) filter (part = 'other') as other_findings, '0,1' as evidence_ids, case when bool_or(part <> 'other' and n % 3 = 2) then '2' else '' end as missing_evidence from f group by report""")
def report_built(spark, d):
    r = report.built(*_report_rows(spark, d), "report")
    numbers = lambda c: F.array_join(F.transform(c, lambda x: x["number"].cast("string")), ",")
    return r.select("report", numbers("key_risks").alias("key_risks"), numbers("positive_signals").alias("positive_signals"), F.size("other_findings").cast("bigint").alias("other_findings"), F.array_join("evidence_ids", ",").alias("evidence_ids"), F.array_join("missing_evidence", ",").alias("missing_evidence"))


@query("""select doc_id, array_to_string(case doc_id % 5 when 0 then [lang, source] when 1 then ['media:' || lang, source] when 2 then [source] when 3 then ['supplier:' || lang, 'supplier:' || source] else [] end, ',') as ids from documents""")
def finding_evidence_ids(spark, d):
    kind = _pick(F.col("doc_id"), "REVIEW_FINDING", "MEDIA_CONSISTENCY", "IDENTITY_ASSESSMENT", "SUPPLIER_RISK", "OTHER")
    l, s = F.col("lang"), F.col("source")
    return read_table(spark, d, "documents").select("doc_id", F.array_join(report.evidence_ids(kind, F.array(l, l, s, F.lit("")), l, s, F.array(s), F.array(l, s, F.lit(""))), ",").alias("ids"))


@query("""select o_orderkey, case o_orderkey % 3 when 0 then o_orderstatus when 1 then null else 'own' end as value, o_orderkey % 3 = 2 as own from orders""")
def evidence_resolved(spark, d):
    o, k = read_table(spark, d, "orders"), F.col("o_orderkey")
    e = o.select("o_orderkey", F.lit("e").alias("evidence_id"), F.when(k % 3 == 2, "DERIVED").otherwise("SUPPLIER_DATA").alias("source_kind"), F.when(k % 3 == 0, "rating").otherwise("products").alias("source_field"), F.create_map(F.lit("value"), F.lit("own")).alias("payload"))
    s = o.select("o_orderkey", F.create_map(F.lit("rating"), F.col("o_orderstatus")).alias("fields"))
    return report.resolved(e, s, "o_orderkey").select("o_orderkey", F.col("payload")["value"].alias("value"), (F.col("source_kind") == "DERIVED").alias("own"))


@query("""with e as (select l_orderkey as k, l_linenumber as n, l_linestatus as a from lineitem where l_linenumber <= 3), r as (select l_orderkey as k, l_linenumber as n, l_returnflag as b from lineitem where l_linenumber >= 2)
select coalesce(e.k, r.k) as k, 'review:' || coalesce(e.n, r.n) as evidence_id, case when r.k is not null then 'REVIEW' else 'DERIVED' end as source_kind, case when r.k is not null then r.b else a end as text, case when e.k is not null then a end as pattern from e full join r on e.k = r.k and e.n = r.n""")
def evidence_overlay(spark, d):
    l = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_linestatus", "l_returnflag")  # noqa: E741
    e = l.where("n <= 3").select("k", F.concat(F.lit("review:"), F.col("n").cast("string")).alias("evidence_id"), F.lit("DERIVED").alias("source_kind"), F.lit("x").alias("source_field"), F.create_map(F.lit("text"), F.col("l_linestatus"), F.lit("pattern"), F.col("l_linestatus")).alias("payload"))
    r = l.where("n >= 2").select("k", F.col("n").alias("ordinal"), F.create_map(F.lit("text"), F.col("l_returnflag")).alias("payload"))
    return report.overlaid(e, r, "k", spread(l)).select("k", "evidence_id", "source_kind", F.col("payload")["text"].alias("text"), F.col("payload")["pattern"].alias("pattern"))


@query("""with o as (select o_orderkey, o_orderkey % 2 = 0 as low, o_orderkey % 3 = 0 as miss, o_orderkey % 5 = 0 as up, o_orderkey % 7 = 0 as pages, o_orderkey % 4 = 0 as ctx, o_orderkey % 11 = 0 as html, o_orderkey % 6 = 0 as unsure, o_orderstatus = 'F' as sem from orders)
select o_orderkey, concat_ws(',', case when low then 'INSUFFICIENT_INFORMATION' end, 'AS_OF_COLLECTION,NO_VERIFICATION', case when miss then 'FIELDS_UNKNOWN' end, case when up then 'AGE_OF_SAVED_PAGE_UNKNOWN' end, case when pages then 'PAGES_NOT_COLLECTED' end, case when ctx then 'CONTEXT_IS_AN_EXCERPT' end, case when html then 'HTML_INCOMPLETE' end, case when unsure then 'IDENTITY_UNCERTAIN' end, case when not sem then 'NO_SEMANTIC_REVIEWS' end) as limitations,
concat_ws(',', 'VERIFY_LEGAL_ENTITY,REQUEST_SAMPLE,WRITTEN_TERMS', case when low or miss then 'COMPLETE_EVIDENCE' end, case when miss then 'DELIVERY_PROOF' end, case when unsure then 'CAPACITY_PROOF' end, o_orderstatus_action) as actions from o join (select o_orderkey, case when o_orderstatus = 'O' then 'ask' end as o_orderstatus_action from orders) using (o_orderkey)""")
def report_limitations(spark, d):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    label = F.when(k % 2 == 0, "INSUFFICIENT_INFORMATION").otherwise("LOW")
    gaps = F.when(k % 3 == 0, F.array(F.lit("DELIVERY"))).otherwise(F.array().cast("array<string>"))
    limits = report.limitations(label, gaps, F.when(k % 5 == 0, "USER_UPLOAD"), k % 7 == 0, k % 4 == 0, k % 11 == 0, k % 6 == 0, F.when(status == "F", "semantic"))
    steps = report.actions(label, gaps, k % 6 == 0, F.when(status == "O", F.array(F.lit(" ask "), F.lit("ask"), F.lit(" "))))
    return read_table(spark, d, "orders").select("o_orderkey", F.array_join(limits, ",").alias("limitations"), F.array_join(steps, ",").alias("actions"))


@query("""select o_orderkey, case when o_orderstatus = 'F' then 'semantic' else 'deterministic' end as mode, case when o_orderstatus = 'F' then o_orderkey % 10 end::bigint as confidence, case when o_orderstatus <> 'F' then o_custkey end as review_count from orders""")
def review_summary(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.struct((F.col("o_orderkey") % 10).alias("confidence"), F.col("o_custkey").alias("review_count")).alias("a"))
    shown = report.review_summary(F.when(F.col("s") == "F", "semantic").otherwise("other"), F.col("a"), ["confidence"], ["review_count"])
    return o.select("o_orderkey", F.from_json(shown, "mode string, confidence bigint, review_count bigint").alias("j")).select("o_orderkey", "j.mode", "j.confidence", "j.review_count")


@query("""with e as (select doc_id, source, case doc_id % 4 when 0 then 'reviews' when 1 then 'price_information' when 2 then 'page_context' else 'certifications' end as f, case when doc_id % 9 = 0 then '[]' else substr(text, 1, 60) end as v from documents), b as (select doc_id, source, f, v, unnest(case f when 'reviews' then ['PRODUCT_QUALITY', 'REVIEW_MANIPULATION', 'AFTER_SALES'] when 'price_information' then ['PRICING'] when 'page_context' then ['AFTER_SALES', 'PRICING'] else ['PRODUCT_QUALITY', 'SUPPLIER_IDENTITY'] end) as dimension from e where v not in ('', '[]', '{}', 'null'))
select doc_id, dimension from b where f <> 'page_context' or regexp_matches(v, case when dimension = 'AFTER_SALES' then '(?i)refund|return|exchange|warranty|after.sales|dispute|compensation' else '(?i)USD|CNY|RMB|price|MOQ|minimum|payment' end)""")
def evidence_by_dimension(spark, d):
    k = F.col("doc_id")
    e = read_table(spark, d, "documents").select("doc_id", k.cast("string").alias("evidence_id"), F.lit("SUPPLIER_DATA").alias("source_kind"), _pick(k, "reviews", "price_information", "page_context", "certifications").alias("source_field"), F.when(k % 9 == 0, "[]").otherwise(F.substring("text", 1, 60)).alias("value"))
    return report.captured_for(e, "doc_id").select("doc_id", "dimension")


# Serving and workflow -----------------------------------------------------------------------------------------------------------------


def _analyses(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return read_table(spark, d, "orders").select(k.alias("analysis_id"), F.col("o_custkey").alias("user_id"), k.alias("snapshot_id"), F.when(k % 4 == 0, "GUEST").otherwise("CUSTOMER").alias("actor_type"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("ASSESSING").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("claim_token"))


def _snapshots(spark, d) -> DataFrame:
    return read_table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_suppkey").alias("supplier_id"), F.col("l_linestatus").alias("normalized"))


@query("""select o_orderkey as analysis_id, o_custkey as user_id, l_suppkey as supplier_id, s_name, r.n as results from orders join lineitem on l_orderkey = o_orderkey and l_linenumber = 1 join supplier on s_suppkey = l_suppkey join (select l_orderkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1) r on r.l_orderkey = o_orderkey where o_orderkey % 4 <> 0""")
def renormalize_source(spark, d):
    suppliers = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier_id"), "s_name")
    results = read_table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("analysis_id")).agg(F.count("*").alias("results"))
    return serving.renormalize_source(_analyses(spark, d), _snapshots(spark, d), suppliers, results).select("analysis_id", "user_id", "supplier_id", "s_name", "results")


@query("select o_orderkey as analysis_id, o_custkey as user_id, l_suppkey as supplier_id from orders join lineitem on l_orderkey = o_orderkey and l_linenumber = 1 join supplier on s_suppkey = l_suppkey where o_orderkey % 4 <> 0")
def watched_supplier(spark, d):
    return serving.watched_supplier(_analyses(spark, d), _snapshots(spark, d), read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier_id")))


@query("select o_orderkey as analysis_id, l_linestatus as normalized, o_orderstatus <> 'F' and o_orderpriority = '1-URGENT' as current from orders join lineitem on l_orderkey = o_orderkey and l_linenumber = 1")
def assessment_snapshot(spark, d):
    s = _snapshots(spark, d).withColumn("analysis_id", F.col("snapshot_id"))
    return serving.assessment_snapshot(_analyses(spark, d), s, "1-URGENT").select("analysis_id", "normalized", "current")


@query("""with r as (select l_orderkey, count(*) as lines from lineitem group by 1) select o_orderkey as analysis_id, lines from orders join r on l_orderkey = o_orderkey where o_custkey = 7 and o_orderkey % 4 <> 0 and o_orderstatus = 'F' union all
select o_orderkey, lines from orders join r on l_orderkey = o_orderkey where o_custkey = 10 and o_orderkey % 4 = 0 and o_orderstatus = 'F' and o_orderdate >= timestamp '1993-01-01'""")
def owned_report(spark, d):
    a = _analyses(spark, d)
    r = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("analysis_id")).agg(F.count("*").alias("lines"))
    return serving.owned_report(r, a, "user_id", 7, "CUSTOMER").unionByName(serving.owned_report(r, a, "user_id", 10, "GUEST", F.lit("1993-01-01").cast("timestamp_ntz")))


@query("select l_orderkey as k, l_linenumber as review_id from lineitem where l_linenumber > 3")
def media_references(spark, d):
    l = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("review_id"))  # noqa: E741
    reviews = l.select("k", F.col("review_id").alias("evidence_id"), F.when(F.col("review_id") <= 3, "said").otherwise(" ").alias("text"))
    return serving.unknown_reviews(l, reviews, "k")


@query("""with t as (select conv_id, turn, strlen(to_json(text)) as n, row_number() over (partition by conv_id order by turn) as p from conversations), w as (select *, strlen('{"conv_id": ' || conv_id || ', "reviews": []}') + sum(n) over (partition by conv_id order by turn) + 2 * (p - 1) as s from t)
select conv_id, count(*)::int as captured, (count(*) filter (s <= 600))::int as retained from w group by 1""")
def kept_reviews(spark, d):
    turns = read_table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("reviews"))
    return serving.kept_reviews(turns, most_bytes=600).select("conv_id", "captured", "retained")


@query("select c_custkey, c_name from customer order by c_acctbal desc, c_custkey limit 5 offset 10")
def second_page(spark, d):
    return serving.page_of(read_table(spark, d, "customer"), 2, F.desc("c_acctbal"), "c_custkey").select("c_custkey", "c_name")


@query(f"""select o_orderkey as analysis_id, o_custkey + 1 as attempts from (select *, case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then o_orderdate + interval 1 day else timestamp '2030-01-01' end as claimed from orders) where o_orderdate <= timestamp '{NOW}' and (claimed is null or claimed < timestamp '{NOW}') order by o_orderdate, o_orderkey limit 10""")
def queue_heads(spark, d):
    k = F.col("o_orderkey")
    until = F.when(k % 3 == 1, F.expr("o_orderdate + interval 1 day")).when(k % 3 == 2, F.lit("2030-01-01").cast("timestamp_ntz"))
    q = read_table(spark, d, "orders").select(k.alias("analysis_id"), F.col("o_orderdate").alias("available_at"), until.alias("claimed_until"), F.col("o_custkey").alias("attempts"))
    return workflow.claimed(workflow.queue_heads(q, _now(), 10), _now()).select("analysis_id", "attempts")


@query("""with a as (select o_orderkey as k, case o_orderkey % 3 when 0 then 'OUTBOX_PUBLISH_EXHAUSTED' when 1 then 'OTHER' end as code, o_orderkey % 2 = 0 as seen from orders) select k as analysis_id, case when seen and code = 'OUTBOX_PUBLISH_EXHAUSTED' then 'QUEUED' else 'FAILED_FINAL' end as status, case when not (seen and coalesce(code, '') = 'OUTBOX_PUBLISH_EXHAUSTED') then code end as failure_code, case when seen then 'PUBLISHED' else 'PENDING' end as state from a""")
def delivery_reconciled(spark, d):
    k = F.col("o_orderkey")
    o = read_table(spark, d, "orders")
    a = o.select(k.alias("analysis_id"), F.lit("FAILED_FINAL").alias("status"), F.when(k % 3 == 0, "OUTBOX_PUBLISH_EXHAUSTED").when(k % 3 == 1, "OTHER").alias("failure_code"), F.lit("PUBLICATION_FAILED").alias("final_disposition"))
    box = o.select(k.alias("analysis_id"), F.lit("PENDING").alias("state"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("timestamp").alias("leased_until"))
    done, sent = workflow.delivered(a, box, o.where(k % 2 == 0).select(k.alias("analysis_id")), F.lit(NOW).cast("timestamp"))
    return done.join(sent.select("analysis_id", "state"), "analysis_id").select("analysis_id", "status", "failure_code", "state")


STATES = ("QUEUED", "PROCESSING", "ASSESSING", "REPORTING", "COMPLETED", "FAILED_RETRYABLE", "FAILED_FINAL")
EXTRACTIONS = ("SUCCESS", "PARTIAL", "BLOCKED")


@query(f"""with s as (select event_id, {list(STATES)}[event_id % 7 + 1] as status, case when event_id % 2 = 0 then {list(EXTRACTIONS)}[event_id % 3 + 1] end as x from events), b as (select *, status = 'COMPLETED' as done, coalesce(status = 'COMPLETED' and x = 'BLOCKED', false) as blocked from s)
select event_id, case when done and not blocked then 4 when status = 'REPORTING' then 3 when status = 'ASSESSING' then 2 when status in ('PROCESSING', 'FAILED_RETRYABLE') then 1 else 0 end as step, done and not blocked as complete, done or status = 'FAILED_FINAL' as terminal,
case when blocked or coalesce(x = 'PARTIAL', false) or status in ('FAILED_FINAL', 'FAILED_RETRYABLE') then 'warning' when done then 'good' else 'neutral' end as tone, case when blocked then 'SOURCE_UNAVAILABLE' else status end as headline, case when done then 'LOW' end as risk_label from b""")
def status_presentation(spark, d):
    k = F.col("event_id")
    s = read_table(spark, d, "events").select("event_id", _pick(k, *STATES).alias("status"), F.when(k % 2 == 0, _pick(k, *EXTRACTIONS)).alias("x"))
    p = s.select("event_id", workflow.presentation(F.col("status"), F.col("x"), F.lit(None).cast("string")).alias("p"), workflow.verdict(F.col("status"), F.col("x"), F.lit("LOW")).alias("v"))
    return p.select("event_id", "p.step", "p.complete", "p.terminal", "p.tone", "v.headline", "v.risk_label")


@query("""select event_id, case when event_id % 2 = 0 then 'INELIGIBLE_STATUS' when event_id % 3 = 0 then 'INELIGIBLE_MODE' when event_id % 5 = 0 then 'INVALID_EVIDENCE' when event_id % 7 = 0 then 'INPUT_LIMIT' when event_id % 11 >= 6 then 'ENOUGH_FIELDS' when event_id % 13 = 0 then 'NO_DOM_SIGNAL' end as reason from events""")
def render_eligibility(spark, d):
    k = F.col("event_id")
    reason = workflow.eligible(F.when(k % 2 > 0, "PARTIAL").otherwise("SUCCESS"), F.when(k % 3 > 0, "GUEST_PUBLIC"), F.lit("PUBLIC_HTTP"), k % 5 > 0, F.when(k % 7 == 0, 3_000_000).otherwise(10), k % 11, k % 13 > 0)
    return read_table(spark, d, "events").select("event_id", reason.alias("reason"))


@query("select conv_id, turn, role from conversations where role in ('user', 'system')")
def role_filter(spark, d):
    return workflow.allowed(read_table(spark, d, "conversations").select("conv_id", "turn", "role"), "role", "user", "system")


@query("""with w as (select unnest(['PRODUCT', 'SHOP', 'FACTORY']) as page), h as (select distinct c_custkey, ['PRODUCT', 'SHOP', 'FACTORY', 'OTHER'][c_custkey % 4 + 1] as page from customer) select c_custkey, string_agg(w.page, ',' order by w.page) as not_captured from h, w where w.page <> h.page group by c_custkey""")
def pages_not_captured(spark, d):
    want = F.array(*map(F.lit, ("PRODUCT", "SHOP", "FACTORY")))
    missing = F.array_sort(F.array_except(want, F.array(_pick(F.col("c_custkey"), "PRODUCT", "SHOP", "FACTORY", "OTHER"))))
    return read_table(spark, d, "customer").select("c_custkey", F.array_join(missing, ",").alias("not_captured"))


@query("""select source, string_agg(distinct lang, ',' order by lang) as cited, count(distinct lang) as n from documents where lang is not null group by source""")
def cited_union(spark, d):
    lists = read_table(spark, d, "documents").groupBy("source", F.pmod(F.col("doc_id"), F.lit(8)).alias("cluster")).agg(F.collect_set("lang").alias("ids"))
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids"))))
    return lists.groupBy("source").agg(union.alias("ids")).select("source", F.array_join("ids", ",").alias("cited"), F.size("ids").cast("bigint").alias("n"))


@query("""with r as (select conv_id as supplier, turn, row_number() over (partition by conv_id order by turn) - 1 as pos, case when role = 'assistant' then ' ' else text end as t, conv_id % 3 as c from conversations) select supplier, 'review:' || pos as evidence_id, t as text, case when c > 0 then c end::bigint as aggregate_count from r where trim(t) <> ''""")
def adapted_reviews(spark, d):
    """The turns of a conversation as the reviews of a stored document; what the assistant says is left blank."""
    text = F.when(F.col("role") == "assistant", " ").otherwise(F.col("text"))
    lists = read_table(spark, d, "conversations").groupBy(F.col("conv_id").alias("supplier")).agg(F.array_sort(F.collect_list(F.struct("turn", text.alias("text")))).alias("reviews"))
    total = F.col("supplier") % 3
    return findings.adapted_reviews(lists.withColumn("transaction_review_count", F.when(total == 0, -1).otherwise(total)))


@query("""with c as (select label as supplier, count(*) as n from embeddings group by 1) select supplier, 'SEMANTIC_NEAR_DUPLICATE' as kind, round(3 / n::double, 4) as strength, 0.8::double as reliability from c union all select supplier, 'TIMING_BURST', 0.5, 1.0 from c""")
def combined_patterns(spark, d):
    counts = read_table(spark, d, "embeddings").groupBy(F.col("label").alias("supplier")).agg(F.count("*").alias("review_count"))
    clusters = counts.select("supplier", F.lit(3).alias("members"), F.lit(0.8).alias("reliability"))
    return similarity.combined_patterns(counts.select("supplier", F.lit("TIMING_BURST").alias("kind"), F.lit(0.5).alias("strength"), F.lit(1.0).alias("reliability")), clusters, counts)


# Marketplaces: pages made of the test tables' rows, in the platforms' layouts ----------------------------------------------------------


@query("""with b as (select s_suppkey, s_name, round(s_acctbal, 1) as grade, case when s_acctbal < 0 then 'BLOCKED' when s_nationkey = 3 then 'OFFER_MISMATCH' when s_nationkey = 7 then 'UNVERIFIED_OFFER' when s_nationkey = 9 then 'MALFORMED_PAGE' end as f, s_nationkey from supplier),
q as (select l_suppkey, l_partkey, count(*) as n, min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem group by 1, 2), s as (select 1000000 + l_partkey as offer, q.*, b.*, p_name from q join b on s_suppkey = l_suppkey join part on p_partkey = l_partkey)
select l_suppkey, l_partkey, case when f is null then offer::varchar end as offer_id, case when f is null then s_name end as supplier_name, case when f is null then p_name end as product_title, case when f is null then low end::double as low, case when f is null then high end::double as high, case when f is null and n > 1 then n end as review_count,
case when f is null and s_nationkey % 2 = 0 then grade end::double as rating, case when f is null then round((4 + (n > 1)::int + (s_nationkey % 2 = 0)::int) / 12, 4) end as completeness, case when f = 'BLOCKED' then f when f is not null then 'PARSE_FAILED' else 'PARTIAL' end as status, case when f <> 'BLOCKED' then f end as reason from s""")
def offers_1688(spark, d):
    """An offer page for what a supplier sells of a part, in the platform's layout: names, prices and counts are those of the tables."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    sold = read_table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))
    rows = sold.join(read_table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read_table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    offer, nation = 1000000 + F.col("l_partkey"), F.col("s_nationkey")
    rate = F.struct(
        F.when(nation == 9, "high").otherwise(F.when(nation % 2 == 0, F.lit("#"))).alias("goodsGrade"), F.when(F.col("n") > 1, F.array(F.struct(F.lit("全部").alias("name"), F.col("n").alias("count")))).alias("commonTagNodeList"),
    )
    fields = F.struct(F.col("p_name").alias("title"), F.struct(F.col("s_name").alias("companyName")).alias("shopInfo"), rate.alias("rateInfo"))
    price = F.struct(F.col("low").alias("offerMinPrice"), F.col("high").alias("offerMaxPrice"))
    own = F.struct(F.when(nation != 7, offer).alias("offerId"))
    path = lambda inner, *names: F.struct(inner.alias(names[-1])) if len(names) == 1 else F.struct(path(inner, *names[1:]).alias(names[0]))
    data = F.struct(F.struct(fields.alias("fields")).alias("productTitle"), path(price, "fields", "finalPriceModel", "tradeWithoutPromotion").alias("mainPrice"), path(own, "fields", "dataJson", "offerBaseInfo").alias("Root"))
    model = F.replace(F.to_json(path(data, "result", "data")), F.lit('"#"'), F.round("s_acctbal", 1).cast("string"))
    model = F.when(nation == 3, F.replace(model, F.lit('"offerId":'), F.lit('"offerId":1,"offerId":2'))).otherwise(model)
    page = text("<title>", F.when(F.col("s_acctbal") < 0, "Access Denied").otherwise("offer"), "</title><body><script>(function(){})(window.contextPath, ", model, ");</script></body>")
    p = rows.select("l_suppkey", "l_partkey", text("https://detail.1688.com/offer/", offer, ".html").alias("source_url"), page.alias("html"))
    out = platforms.offers_1688(p).withColumns({"low": F.col("price_minimum").cast("double"), "high": F.col("price_maximum").cast("double")})
    return out.select("l_suppkey", "l_partkey", "offer_id", "supplier_name", "product_title", "low", "high", "review_count", "rating", "completeness", "status", "reason")


@query("""with p as (select page_id as k, case when page_id % 7 = 0 then 'x' when page_id % 5 = 0 then 'x' when page_id % 3 = 0 then 'x' end as f from pages) select k as page_id, case when f is null then (1000 + k)::varchar end as offer_id, case when f is null then 'Shop' end as supplier_name, case when f is null then '¥' || k end as price_text, case when f is null then round(4 / 12, 4) end as completeness, case when f is not null then 'PARSE_FAILED' else 'PARTIAL' end as status, case when f is not null then 'MALFORMED_PAGE' end as reason from p""")
def items_taobao(spark, d):
    k = F.col("page_id")
    n = k.cast("string")
    bound = F.when(k % 7 == 0, "1").otherwise((1000 + k).cast("string"))
    model = F.concat(F.lit('{"loaderData": {"home": {"data": {"ssrItemId": "'), bound, F.lit('", "res": {"item": {"itemId": "'), (1000 + k).cast("string"), F.lit('", "title": "Thing", "vagueSellCount": "9+"}, "seller": {"shopName": " Shop ", "sellerType": "'), F.when(k % 5 == 0, "B").otherwise("C"), F.lit('"}, "componentsVO": {"priceVO": {"price": {"priceText": "¥'), n, F.lit('"}}}}}}}'), F.when(k % 3 == 0, "").otherwise("}"))
    page = F.concat(F.lit("<title>t</title><script>!(function () {var a = window.__ICE_APP_CONTEXT__ || {};var b = "), model, F.lit(";for (var k in a) {b[k] = a[k]}window.__ICE_APP_CONTEXT__=b;})();</script>"))
    p = read_table(spark, d, "pages").select("page_id", F.concat(F.lit("https://item.taobao.com/item.htm?id="), (1000 + k).cast("string")).alias("source_url"), page.alias("html"))
    return platforms.items_taobao(p).select("page_id", "offer_id", "supplier_name", "price_text", "completeness", "status", "reason")


@query("""with p as (select page_id as k, page_id % 7 = 0 or page_id % 5 = 0 as bad from pages) select k as page_id, case when not bad then (1000 + k)::varchar end as offer_id, case when not bad then 'Co' end as supplier_name, case when not bad then k % 20 end as years_active, case when not bad then 'A,B' end as categories, case when not bad then 1.5 end::double as price_minimum, case when not bad and k % 2 = 0 then 4.9 end::double as rating,
case when bad then 'PARSE_FAILED' else 'PARTIAL' end as status, case when not bad then round((6 + (k % 2 = 0)::int) / 12, 4) end as completeness from p""")
def products_alibaba(spark, d):
    k = F.col("page_id")
    own = F.when(k % 7 == 0, F.lit(1)).otherwise(1000 + k).cast("string")
    model = F.concat(
        F.lit('{"globalData": {"product": {"productId": '), own, F.lit(', "subject": "Thing", "moq": 5, "price": {"productRangePrices": {"dollarPriceRangeLow": 1.5, "dollarPriceRangeHigh": '), F.when(k % 5 == 0, "1").otherwise("3"),
        F.lit('}}}, "seller": {"companyName": "Co", "companyJoinYears": "'), (k % 20).cast("string"), F.lit('"}, "seo": {"breadCrumb": {"pathList": [{"hrefObject": {"name": "A"}}, {"hrefObject": {"name": "B"}}, {"hrefObject": {"name": "A"}}]}}, "review": {"storeReview": {"averageStar": "'), F.when(k % 2 == 0, "4.9").otherwise("7"), F.lit('"}}}}'),
    )
    p = read_table(spark, d, "pages").select("page_id", F.concat(F.lit("https://www.alibaba.com/product-detail/Thing_"), (1000 + k).cast("string"), F.lit(".html")).alias("source_url"), F.concat(F.lit("<script>window.detailData = "), model, F.lit(";</script>")).alias("html"))
    return platforms.products_alibaba(p).select("page_id", "offer_id", "supplier_name", "years_active", F.array_join("categories", ",").alias("categories"), "price_minimum", "rating", "status", "completeness")


@query("""with p as (select page_id as k, page_id % 7 = 0 as bad from pages) select k as page_id, case when not bad then 'Shop' end as supplier_name, case when not bad and k % 2 = 0 then k % 30 end::int as years_active, case when not bad then 1 end::bigint as metrics, case when bad then 'PARSE_FAILED' else 'PARTIAL' end as status from p""")
def shops_taobao(spark, d):
    k = F.col("page_id")
    model = F.concat(F.lit('{"seller": {"shopId": "'), F.when(k % 7 == 0, F.lit(1)).otherwise(1000 + k).cast("string"), F.lit('", "shopName": "Shop", "shopDuration": "'), (k % 30).cast("string"), F.when(k % 2 == 0, "年老店").otherwise("年"), F.lit('", "evaluates": [{"title": "Service", "score": "4.8"}, {"title": " ", "score": "1"}]}}'))
    p = read_table(spark, d, "pages").select("page_id", F.concat(F.lit("https://shop"), (1000 + k).cast("string"), F.lit(".taobao.com/")).alias("source_url"), F.concat(F.lit("<script>window.g_config = "), model, F.lit(";</script>")).alias("html"))
    return platforms.shops_taobao(p).select("page_id", "supplier_name", "years_active", F.when(F.col("metrics").isNotNull(), F.size("metrics")).cast("bigint").alias("metrics"), "status")
