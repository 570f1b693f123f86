"""Queries over the verification of claims, over traps, and over terms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.functions import facts, text
from scriptorium.operators import match, verify
from scriptorium.operators.fold import chunked
from scriptorium.operators.order import first_wins
from scriptorium.plans.base import SQL_CLAIMS, SQL_LATEST, claims, last_passes
from scriptorium.session import checkpointed
from scriptorium.sources import table


def _sides(spark, d):
    t = last_passes(spark, d, "tgt_plain").select(F.col("id").alias("translation_id"), "job_id", "unit_id", "tgt_plain")
    c = claims(spark, d).select("unit_id", F.col("id").alias("claim_id"), "claim_type", "surface_form", "normalized")
    return t, c


def claim_verification(spark, d):
    """What became of each claim of a unit in the last pass of each job."""
    t, c = _sides(spark, d)
    return verify.verified(t, c).withColumn("magnitude", F.round("magnitude", 6))


def drift_histogram(spark, d):
    """Fidelity of each job by kind of claim, and its drifts, in wide columns."""
    t, c = _sides(spark, d)
    return verify.histogram(verify.verified(t, c).join(t.select("translation_id", "job_id"), "translation_id"), ["job_id"])


def reverified(spark, d):
    """Claims that a strict comparison failed and their anchors save, by job: fidelity before and after."""
    t, c = _sides(spark, d)
    strict = checkpointed(verify.verified(t, c, lenient=False))
    again = verify.rechecked(strict.where("drift <> 'verified' and claim_type <> 'comparison'"), t, c).where("kept").select("translation_id", "claim_id", F.lit(1).alias("saved"))
    rows = strict.join(again, ["translation_id", "claim_id"], "left").join(t.select("translation_id", "job_id"), "translation_id")
    good = F.col("drift") == "verified"
    return rows.groupBy("job_id").agg(F.count("*").alias("claims"), F.count_if(good).alias("before"), F.count_if(good | F.col("saved").isNotNull()).alias("after"))


def comparison_verdicts(spark, d):
    """Whether each comparison of a source keeps its order in the last pass of each job."""
    t, c = _sides(spark, d)
    c = c.where("claim_type = 'comparison'")
    return c.join(t, "unit_id").select("translation_id", F.col("claim_id").alias("claim_id"), verify.compared(F.col("surface_form"), F.col("tgt_plain")).alias("verdict"))


def fact_traps(spark, d):
    """Each claim's text with a deliberate error, and whether the passes of each job happen to state the false form."""
    t, c = _sides(spark, d)
    false = facts.trapped(F.col("claim_type"), F.col("surface_form"))
    c = c.withColumn("false_form", false).where("false_form <> surface_form")
    return c.select("claim_id", "claim_type", F.md5("false_form").alias("false_md5"))


def trap_rates(spark, d):
    """How often translations state what the source says, and what a trap would have said; overall without comparisons."""
    t, c = _sides(spark, d)
    j = table(spark, d, "translation_jobs").select(F.col("id").alias("job_id"), "variant", "language")
    rows = c.withColumn("false_form", facts.trapped(F.col("claim_type"), F.col("surface_form"))).where("false_form <> surface_form")
    rows = rows.join(t.where("tgt_plain is not null"), "unit_id").join(F.broadcast(j) if j.count() < 100_000 else j, "job_id")
    rows = rows.withColumns({"true_kept": facts.states(F.col("surface_form"), F.col("tgt_plain")), "false_stated": facts.states(F.col("false_form"), F.col("tgt_plain"))})
    rows = rows.groupBy("variant", "language", "claim_type").agg(F.count("*").alias("n"), F.count_if("true_kept").alias("k"), F.count_if("false_stated").alias("f"))
    out = rows.where("claim_type <> 'comparison'").groupBy("variant", "language").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("f").alias("f")).withColumn("claim_type", F.lit("overall"))
    out = out.unionByName(rows)
    return out.select("variant", "language", "claim_type", F.col("n").alias("total"), F.col("k").alias("faithful"), F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.col("f").alias("false_stated"))


def _banks(spark, d):
    """Two banks of terms: names before a colon of harvested titles; names that papers' titles end with."""
    a = table(spark, d, "arxiv_en2zh_manifest").select(F.regexp_extract("title", r"^([\w-]+):", 1).alias("term"), F.col("arxiv_id").alias("at"))
    b = table(spark, d, "papers").select(F.regexp_extract("title", r"with ([\w-]+)$", 1).alias("term"), F.col("arxiv_id").alias("at"))
    return [match.bank(x.where("term <> ''"), "term", "term", [F.asc("at"), F.asc("term")]) for x in (a, b)]


def glossary(spark, d):
    """The methods of each paper as terms, first spelling first, grounded in the banks in order; acronyms never are."""
    u = table(spark, d, "translation_units").select(F.col("id").alias("unit_id"), "paper_id")
    c = claims(spark, d).where("claim_type = 'method_name'").join(u, "unit_id").select("paper_id", "id", text.strip(F.col("surface_form")).alias("term"))
    one = first_wins(c.where("term <> ''"), F.concat_ws("\n", "paper_id", F.lower("term")), [F.asc("id")])
    out = match.grounded(one, "term", _banks(spark, d))
    return out.select("paper_id", "term", "rendering", "grounded_in", (F.col("grounded_in") > 0).alias("locked"), F.when(F.col("grounded_in") > 0, 1.0).otherwise(0.8).alias("confidence"))


def glossary_chunks(spark, d):
    """Units of a paper in chunks of 60,000 letters, 20 at most, for reading terms from."""
    u = table(spark, d, "translation_units").where("src_plain <> ''").select("paper_id", "ord", "id", F.length("src_plain").alias("n"))
    return chunked(u, ["paper_id"], [F.asc("ord"), F.asc("id")], "n", 60_000, 20).groupBy("paper_id", "chunk").agg(F.count("*").alias("units"), F.sum("n").alias("chars"), F.min("ord").alias("first_ord"))


def small_chunks(spark, d):
    """The same fold with chunks of 1,000 letters and no limit to their number."""
    u = table(spark, d, "translation_units").where("src_plain <> ''").select("paper_id", "ord", "id", F.length("src_plain").alias("n"))
    return chunked(u, ["paper_id"], [F.asc("ord"), F.asc("id")], "n", 1000).groupBy("paper_id", "chunk").agg(F.count("*").alias("units"), F.sum("n").alias("chars"), F.min("ord").alias("first_ord"))


def term_consistency_glossary(spark, d):
    """For each job, how consistently its passes spell the terms of its paper's glossary."""
    g = glossary(spark, d).select("paper_id", "term")
    j = table(spark, d, "translation_jobs").select(F.col("id").alias("job_id"), "paper_id")
    t = last_passes(spark, d, "tgt_plain").where("tgt_plain is not null").select("job_id", "unit_id", "tgt_plain").join(j, "job_id")
    said = t.select("job_id", "paper_id", F.explode(F.regexp_extract_all("tgt_plain", F.lit(r"[A-Za-z0-9][A-Za-z0-9-]*"), F.lit(0))).alias("form"))
    n = said.groupBy("job_id", "paper_id", "form").agg(F.count("*").alias("n"))
    f = n.join(g.withColumn("key", F.lower("term")), (n.paper_id == g.paper_id) & (F.lower("form") == F.col("key"))).groupBy("job_id", "key").agg((F.max("n") / F.sum("n")).alias("share"))
    return f.groupBy("job_id").agg(F.count("*").alias("terms"), F.round(F.avg("share"), 6).alias("tcr"))


QUERIES = {f.__name__: f for f in (
    claim_verification, drift_histogram, reverified, comparison_verdicts, fact_traps, trap_rates, glossary, glossary_chunks, small_chunks, term_consistency_glossary,
)}
_ORDER_UP = "优于|高出|超过|胜过|dépasse|surpasse|supérieur|supera|superior|上回|優れ|ดีกว่า|สูงกว่า"
_ORDER_DOWN = "低于|劣于|不如|inférieur|pire|inferior|peor|下回|劣|ต่ำกว่า|แย่กว่า"
_ASSIGNED = r"'(^|[^\w-])[A-Za-zα-ωΑ-Ω][\w]*\s*=\s*-?[0-9]+([.][0-9]+)?', '\1 ', 'g'"


def _way(c: str) -> str:
    """The order that the English comparison which comes first in a text states, then that of a word in another language."""
    first = rf"regexp_extract({c}, '(?i)(?:(?:beat|defeat|exceed|outperform|surpass|equal)(?:e?s)?|(?:better|greater|higher|larger|less|lower|smaller|worse)\s+than|=)\s+[-0-9A-Za-z_]+', 0)"
    return rf"case when {first} <> '' then case when regexp_matches({first}, '^(?i)(less|lower|smaller|worse)') then '<' when regexp_matches({first}, '^(?i)(equal|=)') then '=' else '>' end else case when regexp_matches(regexp_extract(lower({c}), '{_ORDER_UP}|{_ORDER_DOWN}', 0), '{_ORDER_UP}') then '>' when regexp_matches(lower({c}), '{_ORDER_DOWN}') then '<' else '?' end end"


_FALSE = r"""case claim_type when 'numeric' then case when regexp_matches(surface_form, '[0-9]') then regexp_replace(surface_form, '([0-9]+)', '\10') else surface_form end
 when 'citation' then case when regexp_matches(surface_form, '[0-9]{4}') then regexp_replace(surface_form, '[0-9]{4}', (regexp_extract(surface_form, '([0-9]{4})', 1)::int + 1)::varchar) when regexp_matches(surface_form, '[0-9]') then regexp_replace(surface_form, '[0-9]+', (regexp_extract(surface_form, '([0-9]+)', 1)::int + 1)::varchar) else surface_form end
 when 'comparison' then regexp_replace(surface_form, '(?i)outperform', 'underperform') when 'symbol' then regexp_replace(surface_form, '([0-9]+)', '\10') when 'method_name' then surface_form || '2' else surface_form end"""
_CORE = "regexp_replace({0}, '[^0-9.]', '', 'g')"
_STATES = "(contains(tgt_plain, {0}) or (length(" + _CORE + ") > 0 and contains(tgt_plain, " + _CORE + ")))"
_TERMS = r"(select paper_id, term from (select u.paper_id, trim(c.surface_form) term, row_number() over (partition by u.paper_id, lower(trim(c.surface_form)) order by c.id) r from " + SQL_CLAIMS + r" c join translation_units u on u.id = c.unit_id where c.claim_type = 'method_name' and trim(c.surface_form) <> '') where r = 1)"
_BANK = "(select lower(term) k, term from (select term, row_number() over (partition by lower(term) order by arxiv_id, term) r from (select regexp_extract(title, '{1}', 1) term, arxiv_id from {0}) where term <> '') where r = 1)"
_FOLD = "with recursive e as (select paper_id, ord, id, length(src_plain) n, row_number() over (partition by paper_id order by ord, id) i from translation_units where src_plain <> ''), c as (select paper_id, ord, n, i, 0 chunk, n held from e where i = 1 union all select e.paper_id, e.ord, e.n, e.i, case when c.held + e.n > {0} then c.chunk + 1 else c.chunk end, case when c.held + e.n > {0} then e.n else c.held + e.n end from c join e on e.paper_id = c.paper_id and e.i = c.i + 1) select paper_id, chunk, count(*) units, sum(n)::bigint chars, min(ord) first_ord from c where chunk < {1} group by 1, 2"
ORACLES = {
    "comparison_verdicts": f"select translation_id, claim_id, case when not present then 'dropped' when tgt = '?' or src = '?' then 'weakened' when src = tgt then 'preserved' when src in ('<', '>') and tgt in ('<', '>') then 'reversed' else 'weakened' end verdict from (select *, contains(lower(coalesce(tgt_plain, '')), lower(base)) or tgt <> '?' present from (select t.id translation_id, c.id claim_id, t.tgt_plain, {_way('c.surface_form')} src, {_way("regexp_replace(coalesce(t.tgt_plain, ''), " + _ASSIGNED + ")")} tgt, regexp_extract(c.surface_form, '(?i)(?:(?:beat|defeat|exceed|outperform|surpass|equal)(?:e?s)?|than)\\s+([-0-9A-Za-z_]+)', 1) base from {SQL_CLAIMS} c join {SQL_LATEST} t on t.unit_id = c.unit_id where c.claim_type = 'comparison'))",
    "fact_traps": f"select id claim_id, claim_type, md5(f) false_md5 from (select *, {_FALSE} f from {SQL_CLAIMS}) where f <> surface_form",
    "trap_rates": f"""with r as (select j.variant, j.language, claim_type, {_STATES.format('surface_form')} k, {_STATES.format('f')} s from (select *, {_FALSE} f from {SQL_CLAIMS}) c join {SQL_LATEST} t on t.unit_id = c.unit_id join translation_jobs j on j.id = t.job_id where t.tgt_plain is not null and f <> surface_form)
 select variant, language, claim_type, count(*) total, count_if(k)::bigint faithful, round(count_if(k) / count(*), 6) rate, count_if(s)::bigint false_stated from r group by 1, 2, 3 union all select variant, language, 'overall', count(*), count_if(k)::bigint, round(count_if(k) / count(*), 6), count_if(s)::bigint from r where claim_type <> 'comparison' group by 1, 2""",
    "glossary": f"select paper_id, t.term, case when acronym then null else coalesce(a.term, b.term) end rendering, case when acronym then 0 when a.term is not null then 1 when b.term is not null then 2 else 0 end grounded_in, not acronym and coalesce(a.term, b.term) is not null locked, (case when not acronym and coalesce(a.term, b.term) is not null then 1.0 else 0.8 end)::double confidence from (select *, regexp_matches(term, '^[A-Z][A-Z0-9]+$') acronym from {_TERMS}) t left join {_BANK.format('arxiv_en2zh_manifest', '^([A-Za-z0-9_-]+):')} a on a.k = lower(t.term) left join {_BANK.format('papers', 'with ([A-Za-z0-9_-]+)$')} b on b.k = lower(t.term)",
    "glossary_chunks": _FOLD.format(60000, 20),
    "small_chunks": _FOLD.format(1000, 1000000000),
    "term_consistency_glossary": f"with f as (select l.job_id, lower(form) k, form, count(*) n from (select l.job_id, j.paper_id, unnest(regexp_extract_all(l.tgt_plain, '[A-Za-z0-9][A-Za-z0-9-]*')) form from {SQL_LATEST} l join translation_jobs j on j.id = l.job_id) l join {_TERMS} g on g.paper_id = l.paper_id and lower(g.term) = lower(form) group by 1, 2, 3) select job_id, count(*) terms, round(avg(s), 6) tcr from (select job_id, k, max(n) / sum(n) s from f group by 1, 2) group by job_id",
}
