"""Queries over passes, scores and the review gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import review, statistics
from scriptorium.operators.order import top_per
from scriptorium.plans.base import SQL_LATEST, SQL_TRANSLATIONS, last_passes, translations
from scriptorium.sources import table

SCORES = ("xcomet_score", "fps_unit", "comet_score")

LANGUAGES = ("zh", "fr", "es", "ja", "th", "en")


def latest_pass(spark, d):
    return last_passes(spark, d).select("job_id", "unit_id", "id", "pass_no", "status")


def _gated(spark, d):
    t = last_passes(spark, d, *SCORES, "tgt_plain")
    return review.gate(t.withColumn("is_fallback", F.col("status") == "fallback"))


def latest_pass_triage(spark, d):
    return _gated(spark, d).groupBy("job_id").agg(F.count("*").alias("units"), F.count_if("flag").alias("flagged"), F.round(F.max("risk"), 6).alias("worst_risk"))


def gate_reasons(spark, d):
    return _gated(spark, d).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def gate_risk_topk(spark, d):
    g = _gated(spark, d).where("flag").withColumn("risk", F.round("risk", 6))
    return top_per(g, ["job_id"], [F.desc("risk"), F.asc("unit_id")], 5).select("job_id", "unit_id", "risk")


def gate_saving(spark, d):
    u = table(spark, d, "translation_units").select(F.col("id").alias("unit_id"), F.length("src_plain").alias("n"))
    g = _gated(spark, d).join(u, "unit_id")
    g = g.groupBy("job_id").agg(F.sum("n").alias("chars"), F.sum(F.when(F.col("flag"), F.col("n")).otherwise(0)).alias("flagged_chars"))
    return g.withColumn("saved_percent", F.round(F.try_divide(100.0 * (F.col("chars") - F.col("flagged_chars")), F.col("chars")), 6))


def pass_counters(spark, d):
    t = translations(spark, d, "job_id", "status", "pass_no")
    count = {s: F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("translated", "refined", "fallback", "accepted", "pending")}
    return t.groupBy("job_id").agg(F.count("*").alias("n"), *count.values(), F.count_if(F.col("pass_no") == 1).alias("n_first"))


def token_totals(spark, d):
    t = translations(spark, d, "job_id", "cached_prompt_tokens", "fresh_prompt_tokens", "completion_tokens", "elapsed_ms")
    total = [F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in ("cached_prompt_tokens", "fresh_prompt_tokens", "completion_tokens", "elapsed_ms")]
    return t.groupBy("job_id").agg(*total)


def _with_lang(spark, d, *columns):
    j = table(spark, d, "translation_jobs").select(F.col("id").alias("job_id"), "language", "variant", "paper_id", F.col("status").alias("job_status"))
    return last_passes(spark, d, *columns).join(j, "job_id")


def qe_mean_median_p10(spark, d):
    t = _with_lang(spark, d, "xcomet_score").select("language", F.col("xcomet_score").cast("double").alias("x"))
    q = statistics.quantiles(t, ["language"], "x", {"median": 0.5, "p10": 0.1})
    m = t.groupBy("language").agg(F.avg("x").alias("mean"))
    return q.join(m, "language").select("language", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p10")])


def qe_p10_nearest_rank(spark, d):
    t = _with_lang(spark, d, "xcomet_score").select("paper_id", F.col("xcomet_score").cast("double").alias("x"))
    return statistics.quantiles(t, ["paper_id"], "x", {"p10": 0.1}, nearest=True).select("paper_id", "n", F.round("p10", 6).alias("p10"))


def qe_rollup_all(spark, d):
    x = F.col("comet_score").cast("double")
    t = _with_lang(spark, d, "comet_score").withColumn("paper", F.col("paper_id").cast("string"))
    out = t.rollup("paper").agg(F.grouping("paper").alias("g"), F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"))
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("paper")).alias("paper"), "n", "mean")


def summary_grouping_sets(spark, d):
    t = _with_lang(spark, d, "completion_tokens", "fps_unit")
    g = t.groupingSets([["language"], ["variant"]], "language", "variant").agg(
        F.grouping("variant").alias("g"), F.count("*").alias("n"), F.round(F.avg(F.col("fps_unit").cast("double")), 6).alias("mean_fps"), F.sum(F.coalesce("completion_tokens", F.lit(0))).cast("bigint").alias("tokens")
    )
    return g.select(F.when(F.col("g") == 1, "language").otherwise("variant").alias("dimension"), F.coalesce("language", "variant").alias("value"), "n", "mean_fps", "tokens")


def _variants(spark, d, languages):
    t = _with_lang(spark, d, "fps_unit").where("job_status = 'success'")
    p = t.groupBy("variant").pivot("language", list(languages)).agg(F.round(F.avg(F.col("fps_unit").cast("double")), 6).alias("fps"), F.count(F.lit(1)).alias("n"))
    zero = {f"n_{k}": F.coalesce(F.col(f"{k}_n"), F.lit(0)) for k in languages}
    return p.select("variant", *[F.col(f"{k}_fps").alias(f"fps_{k}") for k in languages], *[v.alias(k) for k, v in zero.items()])


def variant_languages_all(spark, d):
    """Mean fidelity and number of units of each variant, by every language jobs are in."""
    return _variants(spark, d, LANGUAGES)


def pearson_scores(spark, d):
    t = _with_lang(spark, d, "comet_score", "xcomet_score")
    r = statistics.pearson(F.col("comet_score"), F.col("xcomet_score"))
    return t.groupBy("language").agg(F.round(r, 6).alias("r"))


def spearman_scores(spark, d):
    t = _with_lang(spark, d, "comet_score", "xcomet_score")
    s = statistics.spearman(t.select("language", F.col("comet_score").cast("double").alias("a"), F.col("xcomet_score").cast("double").alias("b")), ["language"], "a", "b")
    return s.withColumn("spearman", F.round("spearman", 6))


def krippendorff_alpha(spark, d):
    t = _with_lang(spark, d, "comet_score", "xcomet_score").select("language", "unit_id", F.explode(F.array("comet_score", "xcomet_score")).alias("v"))
    a = statistics.krippendorff(t, ["language"], "unit_id", "v")
    return a.select("language", F.round("alpha", 5).alias("alpha"), F.col("n_values").cast("bigint").alias("n_values"))


def verifier_confusion(spark, d):
    t = last_passes(spark, d, "fps_unit", "xcomet_score")
    c = statistics.confusion(t, F.col("fps_unit") >= 0.95, F.col("xcomet_score") >= 0.25)
    return c.select("tp", "fp", "fn", "tn", *[F.round(k, 6).alias(k) for k in ("precision", "recall", "f1", "accuracy")])


def paired_delta(spark, d):
    t = translations(spark, d, "job_id", "unit_id", "pass_no", "status", "comet_score").where("status <> 'pending' and pass_no in (1, 2)")
    p = t.groupBy("job_id", "unit_id").pivot("pass_no", [1, 2]).agg(F.avg(F.col("comet_score").cast("double")))
    p = p.where("`1` is not null and `2` is not null").withColumn("delta", F.col("2") - F.col("1"))
    return p.agg(F.count("*").alias("pairs"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.round(F.median("delta"), 6).alias("median_delta"), F.count_if(F.col("delta") <= 0).alias("not_better"))


def two_level_mean(spark, d):
    t = _with_lang(spark, d, "rcs_unit", "xcomet_score")
    u = t.groupBy("language", "unit_id").agg(F.avg(F.col("rcs_unit").cast("double")).alias("r"), F.avg(F.col("xcomet_score").cast("double")).alias("x"))
    return u.groupBy("language").agg(F.count("r").alias("units"), F.round(F.avg("r"), 6).alias("rcs"), F.round(statistics.pearson(F.col("r"), F.col("x")), 6).alias("with_xcomet"))


def row_mean(spark, d):
    parts = F.filter(F.array(*[F.col(c).cast("double") for c in ("comet_score", "xcomet_score", "ppa_unit", "rcs_unit")]), lambda v: v.isNotNull())
    t = last_passes(spark, d, "comet_score", "xcomet_score", "ppa_unit", "rcs_unit")
    m = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / F.size(parts))
    return t.select("job_id", "unit_id", F.size(parts).alias("known"), F.round(m, 5).alias("mean"))


QUERIES = {f.__name__: f for f in (
    latest_pass, latest_pass_triage, gate_reasons, gate_risk_topk, gate_saving, pass_counters, token_totals, qe_mean_median_p10, qe_p10_nearest_rank,
    qe_rollup_all, summary_grouping_sets, variant_languages_all, pearson_scores, spearman_scores, krippendorff_alpha, verifier_confusion, paired_delta,
    two_level_mean, row_mean,
)}
_GATED = f"""(select *, list_filter([case when status = 'fallback' then 'fallback' end, case when fps_unit::double < 0.95 then 'fps' end, case when xcomet_score::double < 0.25 then 'xcomet' end], lambda x: x is not null) reasons,
 greatest(case when status = 'fallback' then 1.0 else 0 end, case when fps_unit::double < 0.95 then 1 - fps_unit::double else 0 end, case when xcomet_score::double < 0.25 then least(1.0, (0.25 - xcomet_score::double) / 0.25) else 0 end) risk from {SQL_LATEST})"""
_LANG = f"(select t.*, j.language, j.variant, j.paper_id, j.status job_status from {SQL_LATEST} t join translation_jobs j on j.id = t.job_id)"
ORACLES = {
    "latest_pass": f"select job_id, unit_id, id, pass_no, status from {SQL_LATEST}",
    "latest_pass_triage": f"select job_id, count(*) units, count_if(len(reasons) > 0) flagged, round(max(risk), 6) worst_risk from {_GATED} group by job_id",
    "gate_reasons": f"select reason, count(*) n from (select unnest(reasons) reason from {_GATED}) group by reason",
    "gate_risk_topk": f"select job_id, unit_id, risk from (select job_id, unit_id, round(risk, 6) risk, row_number() over (partition by job_id order by round(risk, 6) desc, unit_id) r from {_GATED} where len(reasons) > 0) where r <= 5",
    "gate_saving": f"select job_id, chars, flagged_chars, round(100.0 * (chars - flagged_chars) / nullif(chars, 0), 6) saved_percent from (select job_id, sum(length(src_plain))::bigint chars, sum(case when len(reasons) > 0 then length(src_plain) else 0 end)::bigint flagged_chars from {_GATED} g join translation_units u on u.id = g.unit_id group by job_id)",
    "pass_counters": f"select job_id, count(*) n, count_if(status = 'translated') n_translated, count_if(status = 'refined') n_refined, count_if(status = 'fallback') n_fallback, count_if(status = 'accepted') n_accepted, count_if(status = 'pending') n_pending, count_if(pass_no = 1) n_first from {SQL_TRANSLATIONS} group by job_id",
    "token_totals": f"select job_id, sum(coalesce(cached_prompt_tokens, 0))::bigint cached_prompt_tokens, sum(coalesce(fresh_prompt_tokens, 0))::bigint fresh_prompt_tokens, sum(coalesce(completion_tokens, 0))::bigint completion_tokens, sum(coalesce(elapsed_ms, 0))::bigint elapsed_ms from {SQL_TRANSLATIONS} group by job_id",
    "qe_mean_median_p10": f"select language, count(xcomet_score) n, round(avg(xcomet_score::double), 6) mean, round(median(xcomet_score::double), 6) median, round(quantile_cont(xcomet_score::double, 0.1), 6) p10 from {_LANG} group by language",
    "qe_p10_nearest_rank": f"select paper_id, len(v) n, round(v[round_even(0.1 * (len(v) - 1), 0)::int + 1], 6) p10 from (select paper_id, coalesce(list(xcomet_score::double order by xcomet_score) filter (where xcomet_score is not null), []) v from {_LANG} group by paper_id)",
    "qe_rollup_all": f"select case when grouping(paper_id) = 1 then 'ALL' else paper_id::varchar end paper, count(comet_score) n, round(avg(comet_score::double), 6) mean from {_LANG} group by rollup(paper_id)",
    "summary_grouping_sets": f"select case when grouping(language) = 0 then 'language' else 'variant' end dimension, coalesce(language, variant) as value, count(*) n, round(avg(fps_unit::double), 6) mean_fps, sum(coalesce(completion_tokens, 0))::bigint tokens from {_LANG} group by grouping sets ((language), (variant))",
    "variant_languages_all": "select variant, " + ", ".join(f"round(avg(fps_unit::double) filter (where language = '{k}'), 6) fps_{k}, count(*) filter (where language = '{k}') n_{k}" for k in LANGUAGES) + f" from {_LANG} where job_status = 'success' group by variant",
    "pearson_scores": f"select language, round(case when count(*) filter (where a is not null and b is not null) >= 3 and stddev_pop(a) filter (where b is not null) > 0 and stddev_pop(b) filter (where a is not null) > 0 then corr(a, b) end, 6) r from (select language, comet_score::double a, xcomet_score::double b from {_LANG}) group by language",
    "spearman_scores": f"select language, round(corr(ra, rb), 6) spearman from (select language, rank() over (partition by language order by a) + (count(*) over (partition by language, a) - 1) / 2.0 ra, rank() over (partition by language order by b) + (count(*) over (partition by language, b) - 1) / 2.0 rb from (select language, comet_score::double a, xcomet_score::double b from {_LANG} where comet_score is not null and xcomet_score is not null)) group by language",
    "krippendorff_alpha": f"with v as (select language, unit_id, comet_score::double x from {_LANG} where comet_score is not null union all select language, unit_id, xcomet_score::double from {_LANG} where xcomet_score is not null), u as (select language, unit_id, count(*) m, sum(x) s, sum(x * x) q from v group by 1, 2 having count(*) >= 2) select language, round(1 - (sum(2 * (m * q - s * s) / (m - 1)) / sum(m)) / (2 * (sum(m) * sum(q) - sum(s) * sum(s)) / (sum(m) * (sum(m) - 1))), 5) alpha, sum(m)::bigint n_values from u group by language",
    "verifier_confusion": f"select tp, fp, fn, tn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) recall, round(2.0 * tp / (2 * tp + fp + fn), 6) f1, round((tp + tn) / (tp + tn + fp + fn), 6) accuracy from (select count_if(g and p) tp, count_if(not g and p) fp, count_if(g and not p) fn, count_if(not g and not p) tn from (select fps_unit::double >= 0.95::double g, xcomet_score::double >= 0.25::double p from {SQL_LATEST}) where g is not null and p is not null)",
    "paired_delta": f"select count(*) pairs, round(avg(b - a), 6) mean_delta, round(median(b - a), 6) median_delta, count_if(b - a <= 0) not_better from (select job_id, unit_id, avg(comet_score::double) filter (where pass_no = 1) a, avg(comet_score::double) filter (where pass_no = 2) b from {SQL_TRANSLATIONS} where status <> 'pending' group by 1, 2) where a is not null and b is not null",
    "two_level_mean": f"select language, count(r) units, round(avg(r), 6) rcs, round(corr(r, x), 6) with_xcomet from (select language, unit_id, avg(rcs_unit::double) r, avg(xcomet_score::double) x from {_LANG} group by 1, 2) group by language",
    "row_mean": f"select job_id, unit_id, len(p)::int known, round(list_sum(p) / nullif(len(p), 0), 5) mean from (select job_id, unit_id, list_filter([comet_score::double, xcomet_score::double, ppa_unit::double, rcs_unit::double], lambda x: x is not null) p from {SQL_LATEST})",
}
