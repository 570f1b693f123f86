"""Queries over passes as runs: medians of judges, refinement, edits, prompts, samples, selections, lookups and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import facts, text
from scriptorium.operators import review, select, statistics
from scriptorium.operators.order import latest, listed, neighbours
from scriptorium.plans.base import SQL_CLAIMS, SQL_LATEST, SQL_TRANSLATIONS, claims, last_passes, translations
from scriptorium.sources import table


def judge_medians(spark, d):
    """Median of each score over a unit's passes, as over a judge's runs, and the states they went through."""
    t = translations(spark, d, "job_id", "unit_id", "pass_no", "status", "comet_score", "xcomet_score", "ppa_unit")
    return statistics.medians(t, ["job_id", "unit_id"], ["comet_score", "xcomet_score", "ppa_unit"]).join(
        t.groupBy("job_id", "unit_id").agg(F.array_join(listed(F.col("status"), F.struct("pass_no", "id")), "+").alias("states")), ["job_id", "unit_id"]
    )


def rubric_check(spark, d):
    """Weighted sum of four scores against a total, as a rubric's items against what a judge added up."""
    weights = {"comet_score": 0.4, "xcomet_score": 0.3, "ppa_unit": 0.2, "rcs_unit": 0.1}
    t = last_passes(spark, d, *weights)
    return t.select("job_id", "unit_id", F.round(statistics.weighted([(F.col(c).cast("double"), w) for c, w in weights.items()]), 6).alias("total"))


def token_split(spark, d):
    """Tokens of each request, divided evenly among its items, what is left over dropped."""
    t = translations(spark, d, "batch_request_id", "completion_tokens").where("batch_request_id is not null")
    n = t.groupBy("batch_request_id").agg(F.count("*").alias("items"), F.sum(F.coalesce("completion_tokens", F.lit(0))).cast("bigint").alias("tokens"))
    return n.withColumn("each", F.expr("tokens div items"))


def with_max_pass(spark, d):
    """Every pass beside the highest of its unit; a hot unit's maximum is found first and joined, so no window holds it."""
    t = translations(spark, d, "job_id", "unit_id", "pass_no")
    top = t.groupBy("job_id", "unit_id").agg(F.max("pass_no").alias("max_pass"))
    return t.join(top, ["job_id", "unit_id"]).select("id", "pass_no", "max_pass")


def newest_job(spark, d):
    """The newest successful job."""
    return table(spark, d, "translation_jobs").where("status = 'success'").orderBy(F.desc("id")).limit(1).select("id", "paper_id", "language")


def any_pending(spark, d):
    """For each job, whether anything is pending: an existence test that stops at the first."""
    j = table(spark, d, "translation_jobs").select(F.col("id").alias("job_id"))
    p = table(spark, d, "translations").where("status = 'pending'").select("job_id")
    yes = j.join(p, "job_id", "left_semi").withColumn("pending", F.lit(True))
    return yes.union(j.join(p, "job_id", "left_anti").withColumn("pending", F.lit(False)))


def model_bases(spark, d):
    """Passes by the model's name without a date at its end."""
    t = translations(spark, d, "model_used")
    dated = F.concat("model_used", F.lit("-2024-05-13"))
    return t.groupBy(text.base_name(dated).alias("model")).agg(F.count("*").alias("n"))


def plain_ids(spark, d):
    """Identifiers of the harvest without prefix or version."""
    raw = F.concat(F.lit("arxiv-"), "arxiv_id", F.lit("v2"))
    return table(spark, d, "arxiv_en2zh_manifest").select(raw.alias("raw"), text.plain_id(raw).alias("id")).distinct()


def language_names(spark, d):
    """Jobs by their language's name; a code without one stands for itself."""
    j = table(spark, d, "translation_jobs")
    return j.groupBy(text.language_name(F.col("language")).alias("language_name")).agg(F.count("*").alias("jobs"))


def request_numbers(spark, d):
    """The number at the end of each request's id, null where it isn't one."""
    t = table(spark, d, "translations").select("batch_request_id").distinct()
    return t.select("batch_request_id", F.substring_index("batch_request_id", "_", -1).try_cast("bigint").alias("number"))


def claim_spans(spark, d):
    """Where each claim first stands in its unit, against where it was said to."""
    u = table(spark, d, "translation_units").select(F.col("id").alias("unit_id"), "src_plain")
    c = claims(spark, d).join(u, "unit_id").withColumn("found", text.place_of(F.col("src_plain"), F.col("surface_form")))
    return c.select("id", "found", (F.col("found") == F.col("span_start")).alias("as_said"))


def zipped_tokens(spark, d):
    """Tokens of source and target by place: how many places agree, and how many have one side only."""
    u = table(spark, d, "translation_units").select(F.col("id").alias("unit_id"), text.placeholders(F.col("src_text")).alias("s"))
    t = last_passes(spark, d, "tgt_text").where("tgt_text is not null").select("job_id", "unit_id", text.placeholders(F.col("tgt_text")).alias("t")).join(u, "unit_id")
    z = t.withColumn("z", F.arrays_zip("s", "t"))
    return z.groupBy("job_id").agg(
        F.sum(F.size(F.filter("z", lambda x: x["s"] == x["t"]))).alias("same"), F.sum(F.size(F.filter("z", lambda x: x["s"].isNull() | x["t"].isNull()))).alias("alone"),
    )


def judged_by_both(spark, d):
    """Units that two judges scored, with both scores: an inner join of two keyed results."""
    t = last_passes(spark, d, "comet_score", "rcs_unit")
    a = t.where("comet_score is not null").select("job_id", "unit_id", F.round(F.col("comet_score").cast("double"), 6).alias("comet"))
    b = t.where("rcs_unit is not null").select("job_id", "unit_id", F.round(F.col("rcs_unit").cast("double"), 6).alias("rcs"))
    return a.join(b, ["job_id", "unit_id"])


def refine_candidates(spark, d):
    """Units to be refined: last passes below a threshold, or with a claim that doesn't survive, and passes left."""
    t = last_passes(spark, d, "xcomet_score", "fps_unit", "tgt_plain").where("status <> 'fallback'")
    kept = facts.anchor_kept(F.col("claim_type"), F.col("surface_form"), F.col("normalized"), F.col("tgt_plain"))
    bad = claims(spark, d).where("claim_type <> 'comparison'").join(t.select("job_id", "unit_id", "tgt_plain"), "unit_id").where(~kept).select("job_id", "unit_id").distinct().withColumn("failed_claim", F.lit(True))
    t = t.join(bad, ["job_id", "unit_id"], "left")
    fails = review.fails(F.col("xcomet_score"), F.col("fps_unit"), F.coalesce("failed_claim", F.lit(False)))
    return t.where(fails & (F.col("pass_no") < 3)).select("job_id", "unit_id", "pass_no")


def refined_passes(spark, d):
    """Passes after bounded refinement by an offline producer: each round writes a pass for what still fails, then gives up."""
    t = last_passes(spark, d, "xcomet_score").where("xcomet_score is not null").select("job_id", "unit_id", F.col("pass_no").cast("int").alias("pass_no"), F.col("xcomet_score").cast("double").alias("score"))
    # the producer stands in for a model: what it rewrites scores half the way to 1
    out = review.refined(t, "score", 0.9, 2, lambda f: f.withColumn("score", (F.col("score") + 1) / 2))
    return out.select("job_id", "unit_id", "pass_no", F.round("score", 6).alias("score"), "is_fallback")


def edited_passes(spark, d):
    """New passes from edits: units whose target has doubled spaces get them collapsed, as the pass after the last."""
    t = last_passes(spark, d, "tgt_plain").where("tgt_plain is not null")
    edits = t.select("job_id", "unit_id", text.collapse(F.col("tgt_plain")).alias("new_text")).join(t.select("job_id", "unit_id", "tgt_plain"), ["job_id", "unit_id"]).where("new_text <> tgt_plain").drop("tgt_plain")
    new = review.edited(edits, t.select("job_id", "unit_id", "pass_no"))
    return new.select("job_id", "unit_id", "pass_no", "status", F.md5("new_text").alias("text_md5"))


def prompts(spark, d):
    """Digest and length of the prompt for each unit: stable part, terms, text before and after cut short, the input as JSON."""
    u = table(spark, d, "translation_units").select("paper_id", "id", "ord", "src_text", "src_plain")
    u = neighbours(u, ["paper_id"], [F.asc("ord"), F.asc("id")], "src_plain", F.floor(F.col("ord") / 1000))
    p = text.prompt("zh", F.col("previous"), F.col("following"), F.col("id"), F.col("src_text"))
    return u.select("id", F.md5(p).alias("prompt_md5"), F.length(p).alias("n"))


def decoded_answers(spark, d):
    """Claims' metadata read back from what a model would answer: fenced, with talk around it."""
    raw = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct(F.col("surface_form").alias("surface"), F.col("claim_type").alias("kind"))), F.lit("\n```\nDone."))
    return claims(spark, d).select("id", text.json_field(raw, "surface").alias("surface"), text.json_field(raw, "kind").alias("kind"))


def decoded_pairs(spark, d):
    """Pairs [id, text] read from a JSON array, ids as figures or strings; others are left out."""
    t = last_passes(spark, d, "tgt_plain").where("tgt_plain is not null")
    raw = F.to_json(F.array(F.array(F.col("unit_id").cast("string"), "tgt_plain"), F.array(F.lit("x1"), F.lit("no"))))
    return t.select("job_id", F.explode(text.id_pairs(raw)).alias("p")).select("job_id", F.col("p.id").alias("unit_id"), F.md5("p.text").alias("text_md5"))


def structured_paragraphs(spark, d):
    """Paragraphs of LaTeX with at least one token that don't begin with a command, before the bibliography."""
    u = table(spark, d, "translation_units").where("src_text is not null").select("id", F.regexp_replace(F.regexp_replace("src_text", r"\{\{PT_Math_(\d+)\}\}", r"\$x_$1\$"), r"\{\{PT_cite_(\d+)\}\}", r"\\cite{c$1}").alias("tex"))
    p = u.select("id", F.posexplode(text.paragraphs(F.col("tex"))).alias("n", "p")).where(text.has_structure(F.col("p")))
    return p.select("id", "n", F.md5("p").alias("p_md5"))


def abstract_units(spark, d):
    """Units whose path leads through an abstract, or that are one by kind."""
    u = table(spark, d, "translation_units")
    return u.where(F.contains(F.lower("xpath"), F.lit("abstract")) | (F.col("kind") == "abstract")).select("id", "paper_id")


def formula_share(spark, d):
    """Share of units with a formula in each paper, null and not full where there is no unit with any token."""
    u = table(spark, d, "translation_units").select("paper_id", F.size(text.placeholders(F.col("src_text"))).alias("n"), F.contains("src_text", F.lit("PT_Math_")).alias("m"))
    g = u.groupBy("paper_id").agg(F.count_if(F.col("n") > 0).alias("with_tokens"), F.count_if("m").alias("with_formula"))
    return g.select("paper_id", "with_tokens", statistics.share(F.col("with_formula"), F.col("with_tokens")).alias("percent"))


def job_times(spark, d):
    """Start as a stamp, and seconds taken."""
    j = table(spark, d, "translation_jobs")
    return j.select("id", F.date_format("start_time", "yyyyMMdd_HHmmss").alias("stamp"), F.round(F.unix_micros(F.col("end_time").cast("timestamp")) / 1e6 - F.unix_micros(F.col("start_time").cast("timestamp")) / 1e6, 3).alias("took_s"), F.to_date(F.date_format("start_time", "yyyy-MM-dd"), "yyyy-MM-dd").cast("string").alias("day"))


def cross_listed(spark, d):
    """Papers of the harvest once each under the first of the fields they came under, the first three a field."""
    m = table(spark, d, "arxiv_en2zh_manifest").select("arxiv_id", "field", F.coalesce("citations", F.lit(0)).alias("citations"))
    return select.cross_listed(m, "arxiv_id", "field", ["math", "stat", "cs", "econ", "q-bio", "eess", "physics"], [F.desc("citations"), F.asc("arxiv_id")], 3)


def capped_selection(spark, d):
    """Ten papers a field for a corpus, at most two a venue, those with most citations first, half of them published ones if there are."""
    m = table(spark, d, "arxiv_en2zh_manifest").select("arxiv_id", "field", F.coalesce("venue", F.lit("")).alias("venue"), F.coalesce("citations", F.lit(0)).alias("citations"), F.coalesce("published", F.lit(False)).alias("published"))
    m = latest(m, ["arxiv_id"], [F.desc("citations"), F.asc("field"), F.asc("venue"), F.desc("published")])
    return select.capped(m, "field", "venue", "published", [F.desc("citations"), F.asc("arxiv_id")], total=10, cap=2, quota=5).select("field", "arxiv_id", "venue")


def baseline_table(spark, d):
    """Ways of translating side by side, a row each: units, letters, tokens kept, letters covered."""
    j = table(spark, d, "translation_jobs").select(F.col("id").alias("job_id"), "variant")
    u = table(spark, d, "translation_units").select(F.col("id").alias("unit_id"), F.length("src_plain").alias("n"), text.placeholders(F.col("src_text")).alias("p"))
    t = last_passes(spark, d, "tgt_text", "tgt_plain").select("job_id", "unit_id", "tgt_text", F.length("tgt_plain").alias("m"))
    kept = F.size(F.filter("p", lambda x: F.contains(F.coalesce("tgt_text", F.lit("")), x)))
    one = t.join(u, "unit_id").groupBy("job_id").agg(F.count("*").alias("units"), F.sum("n").alias("chars"), F.sum(F.when(F.col("m") > 0, F.col("n")).otherwise(0)).alias("covered"), F.sum(F.size("p")).alias("tokens"), F.sum(kept).alias("kept"))
    g = one.join(j, "job_id").groupBy("variant").agg(*[F.sum(c).alias(c) for c in ("units", "chars", "covered", "tokens", "kept")])
    return g.select("variant", "units", statistics.share(F.col("covered"), F.col("chars")).alias("covered_percent"), F.round(F.coalesce(F.try_divide(F.col("kept"), F.col("tokens")), F.lit(1.0)), 6).alias("tokens_kept"))


def audit_sheet(spark, d):
    """A stratified sample with its texts, ready for people to judge."""
    rows = last_passes(spark, d, "tgt_plain", "fps_unit", "xcomet_score").withColumn("is_fallback", F.col("status") == "fallback")
    rows = review.gate(rows)
    pools = rows.groupBy("job_id").agg(F.count("*").alias("size"))
    got = review.draw(rows, "job_id", "unit_id", review.allocation(pools, "job_id", "size", 100), 7)
    u = table(spark, d, "translation_units").select(F.col("id").alias("unit_id"), "src_plain")
    return got.join(u, "unit_id").select("job_id", "unit_id", F.md5("src_plain").alias("src_md5"), F.md5("tgt_plain").alias("tgt_md5"), "flag")


def meta_checks(spark, d):
    """Checks of judges against each other: what was measured, what is asked for, and whether it is met."""
    t = last_passes(spark, d, "comet_score", "xcomet_score", "rcs_unit")
    c = lambda x: F.col(x).cast("double")
    r = t.agg(statistics.pearson(c("comet_score"), c("xcomet_score")).alias("r"), statistics.pearson(c("rcs_unit"), c("xcomet_score")).alias("q"))
    rows = r.select(F.explode(F.array(F.struct(F.lit("scores").alias("check"), F.col("r").alias("value"), F.lit(0.5).alias("asked")), F.struct(F.lit("reading").alias("check"), F.col("q").alias("value"), F.lit(0.4).alias("asked")))).alias("x")).select("x.*")
    return rows.select("check", F.round("value", 6).alias("value"), "asked", F.coalesce(F.col("value") >= F.col("asked"), F.lit(False)).alias("met"))


def comprehension(spark, d):
    """How well each paper's questions can be answered from its translations, by the words of the reference answer found there."""
    q = table(spark, d, "comprehension_qa").where("reference_answer is not null").select(F.col("id").alias("qa_id"), "unit_id", "question_lang", text.content_tokens(F.col("reference_answer"), facts.STOP_WORDS).alias("w"))
    j = table(spark, d, "translation_jobs").select(F.col("id").alias("job_id"), "paper_id", "language")
    t = last_passes(spark, d, "tgt_plain").where("tgt_plain is not null").select("job_id", "unit_id", F.lower("tgt_plain").alias("t")).join(j, "job_id")
    found = F.size(F.filter("w", lambda x: F.contains(F.col("t"), x)))
    a = t.join(q.where(F.size("w") > 0), "unit_id").where("language = question_lang").select("job_id", "qa_id", (found / F.size("w")).alias("s"))
    return a.groupBy("job_id").agg(F.count("*").alias("answers"), F.round(F.avg("s"), 6).alias("rcs"))


def chosen_documents(spark, d):
    """Papers fit for a corpus: enough Han letters in their targets, enough references and formulas in their units."""
    u = table(spark, d, "translation_units").select("paper_id", F.col("id").alias("unit_id"), F.size(F.filter(text.placeholders(F.col("src_text")), lambda x: F.contains(x, F.lit("PT_ref_")) | F.contains(x, F.lit("PT_cite_")))).alias("r"), F.size(F.filter(text.placeholders(F.col("src_text")), lambda x: F.contains(x, F.lit("PT_Math_")))).alias("f"))
    han = last_passes(spark, d, "tgt_plain").select("unit_id", text.han_letters(F.col("tgt_plain")).alias("h")).groupBy("unit_id").agg(F.max("h").alias("h"))
    g = u.join(han, "unit_id", "left").groupBy("paper_id").agg(F.sum("r").alias("references"), F.sum("f").alias("formulas"), F.sum(F.coalesce("h", F.lit(0))).cast("bigint").alias("han"))
    return g.where((F.col("references") >= 5) & (F.col("formulas") >= 5) & (F.col("han") >= 200))


QUERIES = {f.__name__: f for f in (
    chosen_documents, judge_medians, rubric_check, token_split, with_max_pass, newest_job, any_pending, model_bases, plain_ids, language_names, request_numbers, claim_spans, zipped_tokens,
    judged_by_both, refine_candidates, refined_passes, edited_passes, prompts, decoded_answers, decoded_pairs, structured_paragraphs, abstract_units, formula_share,
    job_times, cross_listed, capped_selection, baseline_table, audit_sheet, meta_checks, comprehension,
)}
_PT = r"regexp_extract_all({0}, '\{{\{{PT_[A-Za-z]+_[0-9]+\}}\}}')"
_WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}]+"
_STOPS = "'the','a','an','of','on','in','to','for','by','and','or','with','at','as','is','are','be','its','their','our','this','that','obtained','combined','experiment','dataset','data'"
_GAP = "(select *, list_filter([case when status = 'fallback' then 1 end, case when fps_unit::double < 0.95 then 2 end, case when xcomet_score::double < 0.25 then 3 end], lambda x: x is not null) reasons from " + SQL_LATEST + ")"
_FORM = r"""(coalesce(tgt_plain, '') <> '' and coalesce(case claim_type
 when 'numeric' then case when regexp_matches(surface_form, '[0-9]') then len(list_filter(list_concat(regexp_extract_all(surface_form, '[0-9][0-9,]*([.][0-9]+)?'), list_transform(regexp_extract_all(surface_form, '[0-9][0-9,]*([.][0-9]+)?'), lambda x: replace(x, ',', ''))), lambda a: contains(tgt_plain, a))) > 0 else false end
 when 'citation' then case when regexp_matches(surface_form, '\b(18|19|20)[0-9]{2}\b') then len(list_filter(regexp_extract_all(surface_form, '\b(18|19|20)[0-9]{2}\b'), lambda y: not contains(tgt_plain, y))) = 0 else len(regexp_extract_all(surface_form, '[0-9]+')) > 0 and len(list_filter(regexp_extract_all(surface_form, '[0-9]+'), lambda y: not contains(tgt_plain, y))) = 0 end
 when 'symbol' then contains(regexp_replace(tgt_plain, '""" + _WS + r"""', '', 'g'), regexp_replace(coalesce(nullif(normalized, ''), surface_form), '""" + _WS + r"""', '', 'g'))
 when 'method_name' then length(trim(surface_form)) >= 3 and contains(tgt_plain, trim(surface_form)) else false end, false))"""
_ALLOC = "(with p as (select job_id, count(*) size from " + SQL_LATEST + " group by 1), e as (select *, sum(size) over () total, floor(100.0 * size / sum(size) over ())::bigint f, round(100.0 * size / sum(size) over () - floor(100.0 * size / sum(size) over ()), 9) rest from p), k as (select *, row_number() over (order by rest desc, job_id) r, 100 - sum(f) over () missing from e) select job_id, (case when total <= 100 then size else f + case when r <= missing and f < size then 1 else 0 end end)::bigint allocated from k)"
ORACLES = {
    "chosen_documents": f"""with h as (select unit_id, max(length(regexp_replace(tgt_plain, '[^㐀-鿿]', '', 'g'))) h from {SQL_LATEST} group by 1) select * from (select paper_id, sum(len(list_filter(p, lambda x: contains(x, 'PT_ref_') or contains(x, 'PT_cite_'))))::bigint as "references", sum(len(list_filter(p, lambda x: contains(x, 'PT_Math_'))))::bigint formulas, sum(coalesce(h, 0))::bigint han from (select paper_id, id, {_PT.format('src_text')} p from translation_units) u left join h on h.unit_id = u.id group by 1) where "references" >= 5 and formulas >= 5 and han >= 200""",
    "judge_medians": f"select job_id, unit_id, count(*) runs, round(median(comet_score::double), 6) comet_score, round(median(xcomet_score::double), 6) xcomet_score, round(median(ppa_unit::double), 6) ppa_unit, string_agg(status, '+' order by pass_no, id) states from {SQL_TRANSLATIONS} group by 1, 2",
    "rubric_check": f"select job_id, unit_id, round(0.4 * comet_score::double + 0.3 * xcomet_score::double + 0.2 * ppa_unit::double + 0.1 * rcs_unit::double, 6) total from {SQL_LATEST}",
    "token_split": "select batch_request_id, count(*) items, sum(coalesce(completion_tokens, 0))::bigint tokens, (sum(coalesce(completion_tokens, 0)) // count(*))::bigint as each from (select distinct id, batch_request_id, completion_tokens from translations where batch_request_id is not null) group by 1",
    "with_max_pass": f"select id, pass_no, max(pass_no) over (partition by job_id, unit_id) max_pass from {SQL_TRANSLATIONS}",
    "newest_job": "select id, paper_id, language from translation_jobs where status = 'success' and id = (select max(id) from translation_jobs where status = 'success')",
    "any_pending": "select id job_id, exists (select 1 from translations t where t.job_id = j.id and t.status = 'pending') pending from translation_jobs j",
    "model_bases": f"select model_used as model, count(*) n from {SQL_TRANSLATIONS} group by 1",
    "plain_ids": "select distinct 'arxiv-' || arxiv_id || 'v2' raw, arxiv_id id from arxiv_en2zh_manifest",
    "language_names": "select case language when 'zh' then 'Chinese' when 'en' then 'English' when 'fr' then 'French' when 'es' then 'Spanish' when 'ja' then 'Japanese' when 'de' then 'German' else language end language_name, count(*) jobs from translation_jobs group by 1",
    "request_numbers": "select distinct batch_request_id, try_cast(regexp_extract(batch_request_id, '[^_]*$', 0) as bigint) number from translations",
    "claim_spans": f"select c.id, case when position(surface_form in src_plain) = 0 then null else position(surface_form in src_plain) - 1 end::int found, case when position(surface_form in src_plain) = 0 then null else position(surface_form in src_plain) - 1 end = span_start as_said from {SQL_CLAIMS} c join translation_units u on u.id = c.unit_id",
    "zipped_tokens": f"select job_id, sum(len(list_filter(list_zip(s, t), lambda x: x[1] = x[2])))::bigint same, sum(abs(len(s) - len(t)))::bigint alone from (select l.job_id, {_PT.format('u.src_text')} s, {_PT.format('l.tgt_text')} t from {SQL_LATEST} l join translation_units u on u.id = l.unit_id where l.tgt_text is not null) group by 1",
    "judged_by_both": f"select job_id, unit_id, round(comet_score::double, 6) comet, round(rcs_unit::double, 6) rcs from {SQL_LATEST} where comet_score is not null and rcs_unit is not null",
    "refine_candidates": f"select job_id, unit_id, pass_no from {SQL_LATEST} l where status <> 'fallback' and pass_no < 3 and (xcomet_score::double < 0.25 or fps_unit::double < 0.95 or exists (select 1 from {SQL_CLAIMS} c where c.unit_id = l.unit_id and c.claim_type <> 'comparison' and not {_FORM}))",
    "refined_passes": f"with a as (select job_id, unit_id, pass_no::int pass_no, xcomet_score::double s, 0 r from {SQL_LATEST} where xcomet_score is not null), b as (select job_id, unit_id, pass_no + 1 pass_no, (s + 1) / 2 s, 1 r from a where s < 0.9), c as (select job_id, unit_id, pass_no + 1 pass_no, (s + 1) / 2 s, 2 r from b where s < 0.9) select job_id, unit_id, pass_no, round(s, 6) score, (r = 2 and s < 0.9) is_fallback from (select * from a union all select * from b union all select * from c)",
    "edited_passes": f"select job_id, unit_id, (pass_no + 1)::int pass_no, 'refined' status, md5(t) text_md5 from (select *, regexp_replace(regexp_replace(tgt_plain, '^{_WS}|{_WS}$', '', 'g'), '{_WS}', ' ', 'g') t from {SQL_LATEST} where tgt_plain is not null) where t <> tgt_plain",
    "prompts": """select id, md5(p) prompt_md5, length(p)::int n from (select id, 'Translate into Chinese. Keep every {{...}} token.' || chr(10) || 'Before: ' || coalesce(left(lag(src_plain) over w, 400), '') || chr(10) || 'After: ' || coalesce(left(lead(src_plain) over w, 400), '') || chr(10) || 'Input: [[' || id || ',' || to_json(src_text)::varchar || ']]' p from translation_units window w as (partition by paper_id order by ord, id))""",
    "decoded_answers": f"select id, surface_form surface, claim_type kind from {SQL_CLAIMS}",
    "decoded_pairs": f"select job_id, unit_id::bigint unit_id, md5(tgt_plain) text_md5 from {SQL_LATEST} where tgt_plain is not null",
    "structured_paragraphs": r"select id, 0 n, md5(tex) p_md5 from (select id, trim(regexp_replace(regexp_replace(src_text, '\{\{PT_Math_([0-9]+)\}\}', '$x_\1$', 'g'), '\{\{PT_cite_([0-9]+)\}\}', '\\cite{c\1}', 'g')) tex from translation_units where src_text is not null) where (contains(tex, '\cite{') or contains(tex, '$x_')) and left(tex, 1) <> '\'",
    "abstract_units": "select id, paper_id from translation_units where lower(xpath) like '%abstract%' or kind = 'abstract'",
    "formula_share": f"select paper_id, count_if(n > 0) with_tokens, round(100.0 * count_if(m) / nullif(count_if(n > 0), 0), 2) percent from (select paper_id, len({_PT.format('src_text')}) n, contains(src_text, 'PT_Math_') m from translation_units) group by 1",
    "job_times": "select id, strftime(start_time, '%Y%m%d_%H%M%S') stamp, round((epoch_us(end_time) - epoch_us(start_time)) / 1e6, 3) took_s, strftime(start_time, '%Y-%m-%d') as day from translation_jobs",
    "cross_listed": "with m as (select arxiv_id, field, coalesce(citations, 0) citations, list_position(['math', 'stat', 'cs', 'econ', 'q-bio', 'eess', 'physics'], field) p from arxiv_en2zh_manifest), o as (select *, row_number() over (partition by arxiv_id order by p, citations desc, arxiv_id) r from m where p is not null), k as (select *, row_number() over (partition by field order by citations desc, arxiv_id) n from o where r = 1) select field, arxiv_id from k where n <= 3",
    "baseline_table": f"with x as (select j.variant, length(u.src_plain) n, length(l.tgt_plain) m, {_PT.format('u.src_text')} p, l.tgt_text from {SQL_LATEST} l join translation_units u on u.id = l.unit_id join translation_jobs j on j.id = l.job_id) select variant, count(*) units, round(100.0 * sum(case when m > 0 then n else 0 end) / nullif(sum(n), 0), 2) covered_percent, round(coalesce(sum(len(list_filter(p, lambda y: contains(coalesce(tgt_text, ''), y)))) / nullif(sum(len(p)), 0), 1.0), 6) tokens_kept from x group by 1",
    "audit_sheet": f"select job_id, unit_id, md5(src_plain) src_md5, md5(tgt_plain) tgt_md5, flag from (select g.job_id, g.unit_id, u.src_plain, g.tgt_plain, len(reasons) > 0 flag, a.allocated, row_number() over (partition by g.job_id order by md5('7:' || g.unit_id::varchar), g.unit_id) r from {_GAP} g join translation_units u on u.id = g.unit_id join {_ALLOC} a on a.job_id = g.job_id) where r <= allocated",
    "meta_checks": f"select 'scores' as check, round(corr(comet_score::double, xcomet_score::double), 6) as value, 0.5::double asked, coalesce(corr(comet_score::double, xcomet_score::double) >= 0.5, false) met from {SQL_LATEST} union all select 'reading', round(corr(rcs_unit::double, xcomet_score::double), 6), 0.4, coalesce(corr(rcs_unit::double, xcomet_score::double) >= 0.4, false) from {SQL_LATEST}",
    "comprehension": f"with q as (select id, unit_id, question_lang, list_filter(list_distinct(regexp_split_to_array(trim(lower(replace(reference_answer, '-', ' '))), '{_WS}')), lambda x: x <> '' and not list_contains([{_STOPS}], x)) w from comprehension_qa where reference_answer is not null) select l.job_id, count(*) answers, round(avg(len(list_filter(w, lambda x: contains(lower(l.tgt_plain), x))) / len(w)), 6) rcs from {SQL_LATEST} l join translation_jobs j on j.id = l.job_id join q on q.unit_id = l.unit_id and q.question_lang = j.language where l.tgt_plain is not null and len(w) > 0 group by 1",
}
