"""Queries over the corpus, joins and sets, the star schema, and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import quality, review
from scriptorium.operators.match import absent
from scriptorium.operators.order import latest, top_per
from scriptorium.plans.base import SQL_LATEST, SQL_TRANSLATIONS, last_passes, translations
from scriptorium.sources import table
from scriptorium.streaming import events as stream

#: Fields by the beginning of a category, in the order they are tried.
FIELDS = (
    ("cs", "Computer Science"), ("math", "Mathematics"), ("physics", "Physics"), ("q-bio", "Quantitative Biology"), ("stat", "Statistics"), ("eess", "Electrical Engineering"), ("econ", "Economics"),
    ("q-fin", "Quantitative Finance"), ("astro-ph", "Astrophysics"), ("cond-mat", "Condensed Matter"), ("gr-qc", "General Relativity"), ("hep", "High Energy Physics"), ("nlin", "Nonlinear Sciences"), ("nucl", "Nuclear Physics"), ("quant-ph", "Quantum Physics"),
)


def _manifest(spark, d):
    return table(spark, d, "arxiv_en2zh_manifest")


def field_of_category(spark, d):
    c = F.lit("Other")
    for prefix, name in reversed(FIELDS):
        c = F.when(F.startswith("main_category", F.lit(prefix)), name).otherwise(c)
    return table(spark, d, "papers").select("id", c.alias("field_name"))


def most_cited_per_field(spark, d):
    m = _manifest(spark, d).withColumn("c", F.coalesce(F.nullif("citations", F.lit(0)), F.lit(-1)))
    one = latest(m, ["arxiv_id"], [F.desc("c"), F.asc("field"), F.asc_nulls_first("authors")])
    return top_per(one, ["field"], [F.desc("c"), F.asc("arxiv_id")], 5).select("field", "arxiv_id", F.col("c").alias("citations"))


def tallies(spark, d):
    return _manifest(spark, d).groupBy("license_label").agg(F.count("*").alias("n"), F.countDistinct("arxiv_id").alias("papers"), F.min("citations").alias("least"), F.max("citations").alias("most"), F.count_if((F.coalesce("doi", F.lit("")) != "") | (F.coalesce("journal_ref", F.lit("")) != "")).alias("published"))


def experiment_matrix(spark, d):
    p = table(spark, d, "papers").where("license_permissive").select(F.col("id").alias("paper_id"))
    j = table(spark, d, "translation_jobs")
    # the two small dimensions are listed first, so the product is papers times what was ever run
    return p.join(j.select("language").distinct().join(j.select("variant").distinct(), how="cross"), how="cross")


def not_done_yet(spark, d):
    j = table(spark, d, "translation_jobs")
    m = j.select("paper_id").distinct().join(j.select("language").distinct(), how="cross")
    return absent(m, j.where("status = 'success'"), ["paper_id", "language"])


def units_without_target(spark, d):
    u = table(spark, d, "translation_units").select(F.col("id").alias("unit_id"), "paper_id", "src_text")
    j = table(spark, d, "translation_jobs").where("status = 'success'").select(F.col("id").alias("job_id"), "paper_id")
    t = last_passes(spark, d, "tgt_text").select("job_id", "unit_id", "tgt_text")
    out = j.join(u, "paper_id").join(t, ["job_id", "unit_id"], "left")
    return out.select("job_id", "unit_id", F.md5(F.coalesce("tgt_text", "src_text")).alias("text_md5"), F.col("tgt_text").isNull().alias("is_fallback"))


def jobs_with_scores(spark, d):
    j = table(spark, d, "translation_jobs").select(F.col("id").alias("job_id"), "language", "status")
    s = last_passes(spark, d, "fps_unit").groupBy("job_id").agg(F.count("*").alias("units"), F.round(F.avg(F.col("fps_unit").cast("double")), 6).alias("fps"))
    return j.join(s, "job_id", "left")


def claimed_units(spark, d):
    u = table(spark, d, "translation_units").select("id", "paper_id")
    c = table(spark, d, "verifiable_claims").select(F.col("unit_id").alias("id"))
    return u.join(c, "id", "left_semi").groupBy("paper_id").agg(F.count("*").alias("units"))


def stage_done(spark, d):
    j = table(spark, d, "translation_jobs").select(F.col("id").alias("job_id"), "paper_id")
    n = table(spark, d, "translation_units").groupBy("paper_id").agg(F.count("*").alias("units"))
    t = last_passes(spark, d).groupBy("job_id").agg(F.count("*").alias("done"))
    out = j.join(n, "paper_id", "left").join(t, "job_id", "left").select("job_id", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("done", F.lit(0)).alias("done"))
    return out.withColumns({"complete": F.col("done") >= F.col("units"), "coverage": F.round(F.try_divide(100.0 * F.col("done"), F.col("units")), 6)})


def languages_complete(spark, d):
    j = table(spark, d, "translation_jobs").where("status = 'success'").groupBy("paper_id").agg(F.array_sort(F.collect_set("language")).alias("done"))
    return j.select("paper_id", F.array_join("done", ",").alias("done"), (F.size(F.array_except(F.array(F.lit("zh"), F.lit("fr")), "done")) == 0).alias("has_both"))


def in_both_tables(spark, d):
    a, b = table(spark, d, "papers").select("arxiv_id"), _manifest(spark, d).select("arxiv_id")
    both = a.intersect(b).withColumn("kind", F.lit("both"))
    return both.union(b.distinct().exceptAll(a.distinct()).withColumn("kind", F.lit("manifest_only"))).groupBy("kind").agg(F.count("*").alias("n"))


def unioned_scores(spark, d):
    t = last_passes(spark, d, "comet_score", "xcomet_score")
    a = t.select("job_id", F.lit("comet").alias("metric"), F.col("comet_score").cast("double").alias("value"))
    b = t.select("job_id", F.lit("xcomet").alias("metric"), F.col("xcomet_score").cast("double").alias("value"), F.lit(1).alias("extra"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("metric").agg(F.count("value").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count("extra").alias("extra"))


def longest_units(spark, d):
    u = table(spark, d, "translation_units").withColumn("n", F.length("src_plain"))
    return top_per(u, ["paper_id"], [F.desc("n"), F.asc("ord"), F.asc("id")], 3).select("paper_id", "id", "n")


def sample_allocation(spark, d):
    pools = last_passes(spark, d).where("status <> 'fallback'").groupBy("job_id").agg(F.count("*").alias("size"))
    return review.allocation(pools, "job_id", "size", 200)


def stratified_sample(spark, d):
    rows = last_passes(spark, d).where("status <> 'fallback'").select("job_id", "unit_id")
    pools = rows.groupBy("job_id").agg(F.count("*").alias("size"))
    return review.draw(rows, "job_id", "unit_id", review.allocation(pools, "job_id", "size", 200), 2026)


def runs_expanded(spark, d):
    t = translations(spark, d, "job_id", "unit_id", "comet_score", "xcomet_score").select("id", F.to_json(F.array("comet_score", "xcomet_score")).alias("raw"))
    runs = F.from_json("raw", "array<double>")
    ok = t.where(F.size(F.filter(runs, lambda x: x.isNotNull())) >= 2)
    return ok.select("id", F.posexplode(runs).alias("pos", "v")).select("id", (F.col("pos") + 1).alias("run_no"), F.round("v", 4).alias("score"))


def repeated_translation_keys(spark, d):
    return quality.repeated_keys(table(spark, d, "translations").select("job_id", "unit_id", "pass_no"), ["job_id", "unit_id", "pass_no"])


def orphan_units(spark, d):
    u, s = table(spark, d, "translation_units").select("id", "section_id"), table(spark, d, "sections").select(F.col("id").alias("sid"))
    t, j = table(spark, d, "translations").select("id", "job_id"), table(spark, d, "translation_jobs").select(F.col("id").alias("jid"))
    a = quality.orphans(u, s, "section_id", "sid").agg(F.count("*").alias("n")).withColumn("kind", F.lit("unit"))
    return a.union(quality.orphans(t, j, "job_id", "jid").agg(F.count("*").alias("n")).withColumn("kind", F.lit("translation")))


def conversion_screen(spark, d):
    p = table(spark, d, "papers").select("id", "extract_status")
    n = table(spark, d, "translation_units").groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("units"))
    out = p.join(n, "id", "left").withColumn("units", F.coalesce("units", F.lit(0)))
    return out.select("id", "units", F.when(F.col("extract_status") != "done", "failed").when(F.col("units") == 0, "empty").otherwise("ok").alias("outcome"))


def price_summary(spark, d):
    l = table(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


def nation_revenue(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name = 'ASIA'")
    o = table(spark, d, "orders").join(c.select("c_custkey", "n_name"), F.col("o_custkey") == F.col("c_custkey"))
    l = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def customers_without_orders(spark, d):
    """Customers without an order in the last year of orders."""
    late = table(spark, d, "orders").where("o_orderdate >= timestamp'1998-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(late, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def events_tumbling(spark, d):
    return stream.windowed(table(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 4))


def events_sliding(spark, d):
    return stream.windowed(table(spark, d, "events"), "1 hour", "30 minutes").withColumn("total", F.round("total", 4))


def events_sessions(spark, d):
    return stream.sessions(table(spark, d, "events"), "30 minutes").select("user_id", "start", "events")


def token_bucket(spark, d):
    out = stream.token_bucket(table(spark, d, "events"), "event_type", "value", 0.05, 500.0, 0.001)
    return out.withColumns({"wait_s": F.round("wait_s", 3), "level": F.round("level", 3)})


QUERIES = {f.__name__: f for f in (
    field_of_category, most_cited_per_field, tallies, experiment_matrix, not_done_yet, units_without_target, jobs_with_scores, claimed_units, stage_done, languages_complete,
    in_both_tables, unioned_scores, longest_units, sample_allocation, stratified_sample, runs_expanded, repeated_translation_keys, orphan_units, conversion_screen,
    price_summary, nation_revenue, customers_without_orders, events_tumbling, events_sliding, events_sessions, token_bucket,
)}
_POOL = f"(select job_id, unit_id from {SQL_LATEST} where status <> 'fallback')"
_ALLOC = f"""(with p as (select job_id, count(*) size from {_POOL} group by 1), e as (select *, sum(size) over () total, floor(200.0 * size / sum(size) over ())::bigint f, round(200.0 * size / sum(size) over () - floor(200.0 * size / sum(size) over ()), 9) rest from p), k as (select *, row_number() over (order by rest desc, job_id) r, 200 - sum(f) over () missing from e)
 select job_id, (case when total <= 200 then size else f + case when r <= missing and f < size then 1 else 0 end end)::bigint allocated from k)"""
ORACLES = {
    "field_of_category": "select p.id, coalesce(max_by(f.name, length(f.prefix)), 'Other') field_name from papers p left join (values ('cs', 'Computer Science'), ('math', 'Mathematics'), ('physics', 'Physics'), ('q-bio', 'Quantitative Biology'), ('stat', 'Statistics'), ('eess', 'Electrical Engineering'), ('econ', 'Economics'), ('q-fin', 'Quantitative Finance'), ('astro-ph', 'Astrophysics'), ('cond-mat', 'Condensed Matter'), ('gr-qc', 'General Relativity'), ('hep', 'High Energy Physics'), ('nlin', 'Nonlinear Sciences'), ('nucl', 'Nuclear Physics'), ('quant-ph', 'Quantum Physics')) f(prefix, name) on left(p.main_category, length(f.prefix)) = f.prefix group by p.id",
    "most_cited_per_field": "with m as (select *, coalesce(nullif(citations, 0), -1) c, row_number() over (partition by arxiv_id order by coalesce(nullif(citations, 0), -1) desc, field, authors nulls first) r from arxiv_en2zh_manifest) select field, arxiv_id, c citations from (select *, row_number() over (partition by field order by c desc, arxiv_id) k from m where r = 1) where k <= 5",
    "tallies": "select license_label, count(*) n, count(distinct arxiv_id) papers, min(citations) least, max(citations) most, count_if(coalesce(doi, '') <> '' or coalesce(journal_ref, '') <> '') published from arxiv_en2zh_manifest group by license_label",
    "experiment_matrix": "select p.id paper_id, l.language, v.variant from papers p, (select distinct language from translation_jobs) l, (select distinct variant from translation_jobs) v where p.license_permissive",
    "not_done_yet": "select p.paper_id, l.language from (select distinct paper_id from translation_jobs) p, (select distinct language from translation_jobs) l where not exists (select 1 from translation_jobs j where j.status = 'success' and j.paper_id = p.paper_id and j.language = l.language)",
    "units_without_target": f"select j.id job_id, u.id unit_id, md5(coalesce(t.tgt_text, u.src_text)) text_md5, t.tgt_text is null is_fallback from translation_jobs j join translation_units u on u.paper_id = j.paper_id left join {SQL_LATEST} t on t.job_id = j.id and t.unit_id = u.id where j.status = 'success'",
    "jobs_with_scores": f"select j.id job_id, j.language, j.status, s.units, s.fps from translation_jobs j left join (select job_id, count(*) units, round(avg(fps_unit::double), 6) fps from {SQL_LATEST} group by 1) s on s.job_id = j.id",
    "claimed_units": "select paper_id, count(*) units from translation_units u where exists (select 1 from verifiable_claims c where c.unit_id = u.id) group by paper_id",
    "stage_done": f"select j.id job_id, coalesce(n.units, 0) units, coalesce(t.done, 0) done, coalesce(t.done, 0) >= coalesce(n.units, 0) complete, round(100.0 * coalesce(t.done, 0) / nullif(n.units, 0), 6) coverage from translation_jobs j left join (select paper_id, count(*) units from translation_units group by 1) n on n.paper_id = j.paper_id left join (select job_id, count(*) done from {SQL_LATEST} group by 1) t on t.job_id = j.id",
    "languages_complete": "select paper_id, string_agg(distinct language, ',' order by language) done, (count_if(language = 'zh') > 0 and count_if(language = 'fr') > 0) has_both from translation_jobs where status = 'success' group by paper_id",
    "in_both_tables": "select kind, count(*) n from (select distinct m.arxiv_id, case when p.arxiv_id is null then 'manifest_only' else 'both' end kind from arxiv_en2zh_manifest m left join papers p using (arxiv_id)) group by kind",
    "unioned_scores": f"select 'comet' metric, count(comet_score) n, round(sum(comet_score::double), 4) total, 0 extra from {SQL_LATEST} union all select 'xcomet', count(xcomet_score), round(sum(xcomet_score::double), 4), count(*) from {SQL_LATEST}",
    "longest_units": "select paper_id, id, n from (select paper_id, id, length(src_plain)::int n, row_number() over (partition by paper_id order by length(src_plain) desc nulls last, ord, id) r from translation_units) where r <= 3",
    "sample_allocation": f"select * from {_ALLOC}",
    "stratified_sample": f"select job_id, unit_id from (select p.*, a.allocated, row_number() over (partition by p.job_id order by md5('2026:' || p.unit_id::varchar), p.unit_id) r from {_POOL} p join {_ALLOC} a using (job_id)) where r <= allocated",
    "runs_expanded": f"select id, 1 run_no, round(comet_score::varchar::double, 4) score from {SQL_TRANSLATIONS} where comet_score is not null and xcomet_score is not null union all select id, 2, round(xcomet_score::varchar::double, 4) from {SQL_TRANSLATIONS} where comet_score is not null and xcomet_score is not null",
    "repeated_translation_keys": "select job_id, unit_id, pass_no, count(*) as rows from translations group by 1, 2, 3 having count(*) > 1",
    "orphan_units": "select count(*) n, 'unit' kind from translation_units u where section_id is not null and not exists (select 1 from sections s where s.id = u.section_id) union all select count(*), 'translation' from translations t where job_id is not null and not exists (select 1 from translation_jobs j where j.id = t.job_id)",
    "conversion_screen": "select p.id, coalesce(n.units, 0) units, case when extract_status <> 'done' then 'failed' when coalesce(n.units, 0) = 0 then 'empty' else 'ok' end outcome from papers p left join (select paper_id, count(*) units from translation_units group by 1) n on n.paper_id = p.id",
    "price_summary": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice), 2) sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) sum_net, round(avg(l_quantity), 6) avg_qty, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2",
    "nation_revenue": "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey where r_name = 'ASIA' group by n_name",
    "customers_without_orders": "select c_mktsegment, count(*) n from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderdate >= timestamp '1998-01-01') group by 1",
    "events_tumbling": "select time_bucket(interval 1 hour, ts) as start, time_bucket(interval 1 hour, ts) + interval 1 hour as \"end\", event_type, count(*) events, round(sum(value), 4) total from events group by 1, 2, 3",
    "events_sliding": "select s as start, s + interval 1 hour as \"end\", event_type, count(*) events, round(sum(value), 4) total from (select *, unnest([time_bucket(interval 30 minute, ts), time_bucket(interval 30 minute, ts) - interval 30 minute]) s from events) group by 1, 2, 3",
    "events_sessions": "with e as (select *, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 30 minute then 1 else 0 end new from events window w as (partition by user_id order by ts, event_id)), r as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) k from e) select user_id, min(ts) as start, count(*) events from r group by user_id, k",
    "token_bucket": """with recursive e as (select event_type, event_id, epoch_us(ts) / 1e6 t, least(coalesce(value, 0)::double, 500.0) c, row_number() over (partition by event_type order by ts, event_id) n from events),
 b as (select event_type, event_id, n, t, 500.0::double - c tokens, 0.0::double calls, t now from e where n = 1
 union all select event_type, event_id, n, t, least(500.0, tin + wait * 0.05) - c, least(1.0, cin + wait * 0.001) - 1, greatest(was, t) + wait from (select *, greatest(0.0, (c - tin) / 0.05, (1 - cin) / 0.001) wait from (select e.event_type, e.event_id, e.n, e.t, e.c, b.now was, least(500.0, b.tokens + greatest(0.0, e.t - b.now) * 0.05) tin, least(1.0, b.calls + greatest(0.0, e.t - b.now) * 0.001) cin from b join e on e.event_type = b.event_type and e.n = b.n + 1)))
 select event_type, event_id, round(now - t, 3) wait_s, round(tokens, 3) as level from b""",
}
