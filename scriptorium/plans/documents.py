"""Queries over documents: extraction, sections, rebuilding by several systems, survival of structure.

The tables hold units and no files, so documents are put together from them first: one document for every PART units of
a paper, so that no document grows with its paper.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.functions import text
from scriptorium.operators import contract
from scriptorium.operators.order import listed
from scriptorium.plans.base import SQL_LATEST, last_passes
from scriptorium.session import checkpointed
from scriptorium.sources import table

PART = 200
PROFILE = "latexml_abstract"


def _key():
    return (F.col("paper_id").cast("bigint") * 1_000_000 + F.floor(F.col("ord") / PART)).alias("doc")


def _escaped(c):
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def _documents(spark, d):
    """(doc, xml): the units of a part in order, each in the element of its kind, inline elements in place."""
    u = table(spark, d, "translation_units").where("src_text is not null")
    inner = F.aggregate(F.map_entries(F.coalesce("placeholders", F.create_map().cast("map<string,string>"))), text.restore(_escaped(F.col("src_text"))), lambda s, e: F.replace(s, e["key"], e["value"]))
    around = {"section_heading": ("</section><section><title>", "</title>"), "title": ("<front><title>", "</title></front>"), "abstract": ("<abstract><p>", "</p></abstract>"), "caption": ("<caption>", "</caption>")}
    piece = F.concat(F.lit("<p>"), inner, F.lit("</p>"))
    for kind, (before, after) in around.items():
        piece = F.when(F.col("kind") == kind, F.concat(F.lit(before), inner, F.lit(after))).otherwise(piece)
    body = F.array_join(listed(piece, F.struct("ord", "id")), "")
    return u.groupBy(_key()).agg(F.concat(F.lit("<document><section>"), body, F.lit("</section></document>")).alias("xml"))


def extracted_units(spark, d):
    return contract.units(_documents(spark, d), "doc", "xml", PROFILE).select("doc", "ord", "kind", F.md5(F.regexp_replace("src_text", r"_[0-9]+\}\}", "}}")).alias("text_md5"), F.md5("src_plain").alias("plain_md5"), F.size("placeholders").alias("tokens"), F.size("special_chars").alias("specials"), "char_count")


def extracted_sections(spark, d):
    return contract.sections(_documents(spark, d), "doc", "xml", PROFILE)


def tag_counts(spark, d):
    return contract.tags(_documents(spark, d), "doc", "xml", PROFILE)


def document_facts(spark, d):
    return contract.facts(_documents(spark, d), "doc", "xml", PROFILE).select("doc", F.md5("title").alias("title_md5"), "han", "references", "formulas")


def rebuilt_identity(spark, d):
    x = checkpointed(_documents(spark, d))
    t = contract.units(x, "doc", "xml", PROFILE).select("doc", "xpath", F.col("src_text").alias("text"))
    back = contract.rebuilt(x, t, "doc", "xml", PROFILE)
    return contract.fidelity(contract.elements(x, "doc", "xml", PROFILE), contract.elements(back, "doc", "xml", PROFILE), x, "doc")


def _translated(spark, d):
    """(doc, xml), (run, doc, xml), (run, xpath, tgt_text, raw): documents, each job's documents, and what its last passes say of their units."""
    u = table(spark, d, "translation_units").where("src_text is not null").select(F.col("id").alias("unit_id"), "ord", _key(), "placeholders", text.placeholders(F.col("src_text")).alias("tokens"), F.expr(r"regexp_replace(src_text, '\\{\\{PT_equation_[0-9]+\\}\\}', '')").alias("left_over"))
    u = u.where(text.strip(F.col("left_over")) != "").withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("ord", "unit_id")))
    x = checkpointed(_documents(spark, d))
    paths = contract.units(x, "doc", "xml", PROFILE).select("doc", F.col("ord").alias("n"), "xpath")
    t = last_passes(spark, d, "tgt_text").where("tgt_text is not null").select("job_id", "unit_id", "tgt_text")
    t = t.join(u.join(paths, ["doc", "n"]), "unit_id").withColumn("run", F.concat_ws("/", "job_id", "doc"))
    raw = F.aggregate(F.map_entries(F.coalesce("placeholders", F.create_map().cast("map<string,string>"))), _escaped(F.col("tgt_text")), lambda s, e: F.replace(s, e["key"], e["value"]))
    # extraction numbers a unit's tokens anew, in their order
    known = F.array_distinct(F.filter("tokens", lambda x: ~F.contains(x, F.lit("PT_equation_"))))
    anew = F.transform(known, lambda x, i: F.struct(x.alias("old"), F.concat(F.lit("{{PT_"), F.upper(F.regexp_extract(x, "PT_([A-Za-z]+)", 1)), F.lit("_"), (i + 1).cast("string"), F.lit("}}")).alias("new")))
    said = F.aggregate(anew, F.col("tgt_text"), lambda s, x: F.replace(s, x["old"], x["new"]))
    t = checkpointed(t.select("run", "job_id", "doc", "xpath", said.alias("tgt_text"), raw.alias("raw")))
    return x, t.select("run", "job_id", "doc").distinct().join(x, "doc"), t


def system_fidelity(spark, d):
    """Structure kept by each way of carrying it through translation, over the last passes of every job."""
    x, docs, t = _translated(spark, d)
    # a document's own elements are found once, whatever the number of jobs
    source = docs.select("run", "doc").join(contract.elements(x, "doc", "xml", PROFILE), "doc")
    ways = {"contract": "tgt_text", "flat": "tgt_text", "raw_xml": "raw", "naive": "tgt_text"}
    back = contract.carried(docs, t, "run", "xml", PROFILE, ways)
    # repeated keys count as often as they occur on both sides
    kinds = ("is_annotation", "is_formula")
    s = source.groupBy("run", "key", *kinds).agg(F.count("*").alias("ns"))
    b = back.groupBy("run", "system", "key").agg(F.count("*").alias("nb"))
    systems = spark.createDataFrame([(w,) for w in ways], "system string")
    both = s.withColumn("system", F.explode(F.array(*map(F.lit, ways)))).join(b, ["run", "system", "key"], "left").withColumn("kept", F.least("ns", F.coalesce("nb", F.lit(0))))
    job = F.substring_index("run", "/", 1).cast("int").alias("job_id")
    sums = [F.sum(F.when(F.col(kind), F.col(n)).otherwise(0)).alias(name) for kind, n, name in (("is_annotation", "ns", "annotations"), ("is_annotation", "kept", "annotations_kept"), ("is_formula", "ns", "formulas"), ("is_formula", "kept", "formulas_kept"))]
    got = both.groupBy(job, "system").agg(*sums)
    every = docs.select(job).distinct().join(F.broadcast(systems), F.lit(True))  # a row a job and system
    return every.join(got, ["job_id", "system"], "left").fillna(0)


def abstract_only(spark, d):
    """Units that a system gives which translates abstracts alone."""
    return contract.units(_documents(spark, d), "doc", "xml", PROFILE, "abstract").groupBy("doc").agg(F.count("*").alias("units"), F.sum("char_count").alias("chars"))


def raw_units(spark, d):
    """Units as raw XML, as a system without tokens gives them."""
    return contract.units(_documents(spark, d), "doc", "xml", PROFILE, "raw_xml").groupBy("doc").agg(F.count("*").alias("units"), F.sum(F.size(F.regexp_extract_all("src_text", F.lit("<(?:Math|ref|cite|equation)"), F.lit(0)))).alias("elements"))


def latex_survival(spark, d):
    """Tokens of LaTeX (citations, references, labels, formulas) that the last passes keep, repeated ones counted."""

    def latex(c):
        for tag, form in (("Math", r"\$x_$1\$"), ("cite", r"\\cite{c$1}"), ("ref", r"\\ref{r$1}"), ("equation", r"\\label{e$1}")):
            c = F.regexp_replace(c, rf"\{{\{{PT_{tag}_(\d+)\}}\}}", form)
        return c

    u = table(spark, d, "translation_units").select(F.col("id").alias("unit_id"), F.explode(text.latex_tokens(latex(F.col("src_text")))).alias("token"))
    s = u.groupBy("unit_id", "token").agg(F.count("*").alias("ns"))
    t = last_passes(spark, d, "tgt_text").select("job_id", "unit_id", "tgt_text")
    n = t.select("job_id", "unit_id", F.explode(text.latex_tokens(latex(F.col("tgt_text")))).alias("token")).groupBy("job_id", "unit_id", "token").agg(F.count("*").alias("nt"))
    both = t.select("job_id", "unit_id").join(s, "unit_id").join(n, ["job_id", "unit_id", "token"], "left")
    kind = F.when(F.startswith("token", F.lit("$")), "formula").otherwise(F.regexp_extract("token", r"^\\([a-z]+)", 1))
    return both.groupBy("job_id", kind.alias("kind")).agg(F.sum("ns").alias("total"), F.sum(F.least("ns", F.coalesce("nt", F.lit(0)))).alias("survived"))


QUERIES = {f.__name__: f for f in (
    extracted_units, extracted_sections, tag_counts, document_facts, rebuilt_identity, system_fidelity, abstract_only, raw_units, latex_survival,
)}

_U = f"(select *, paper_id::bigint * 1000000 + ord // {PART} as doc, row_number() over (partition by paper_id, ord // {PART} order by ord, id) place from translation_units where src_text is not null)"
_CLEAN = r"trim(regexp_replace(src_text, '\{\{PT_equation_[0-9]+\}\}', '', 'g'))"
_HEAD = f"(select doc, coalesce(h, 0) + 1 as n, heading from (select doc, h, heading from (select doc, place, row_number() over (partition by doc order by place) h, {_CLEAN} heading from {_U} where kind = 'section_heading') union all select distinct doc, 0, null from {_U}))"
_OF = "(select id, doc, job_id, tag, token, src_text, tgt_text, kept from (select u.id, u.doc, r.job_id, l.tgt_text, u.src_text, unnest(map_keys(u.placeholders)) token, regexp_extract(token, 'PT_([A-Za-z]+)_', 1) tag, case when l.tgt_text is null then contains(u.src_text, token) or true else contains(l.tgt_text, token) end kept from {u} u join (select distinct l.job_id, u.doc from {l} l join {u} u on u.id = l.unit_id where l.tgt_text is not null and {clean} <> '') r on r.doc = u.doc left join {l} l on l.job_id = r.job_id and l.unit_id = u.id and {clean} <> ''))"
ORACLES = {
    "extracted_units": rf"""select doc, (row_number() over (partition by doc order by place))::int ord, case kind when 'item' then 'paragraph' else kind end kind, md5(regexp_replace(t, '_[0-9]+\}}\}}', '}}}}', 'g')) text_md5, md5(p) plain_md5, len(regexp_extract_all(t, '\{{\{{PT_'))::int tokens, contains(t, '{{{{NL}}}}')::int specials, length(p)::int char_count
 from (select *, replace(replace(replace({_CLEAN}, 'PT_Math_', 'PT_MATH_'), 'PT_ref_', 'PT_REF_'), 'PT_cite_', 'PT_CITE_') t, trim(regexp_replace(replace(regexp_replace({_CLEAN}, '\{{\{{PT_[A-Za-z]+_[0-9]+\}}\}}', '', 'g'), '{{{{NL}}}}', ' '), '[\s\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{0085}}]+', ' ', 'g')) p from {_U}) where t <> ''""",
    "extracted_sections": rf"select doc, case when max(n) over (partition by doc) = 1 then '/document/section' else '/document/section[' || n || ']' end xpath, null::varchar parent_xpath, 0 depth, n::int ord, nullif(regexp_replace(heading, '\{{\{{PT_[A-Za-z]+_[0-9]+\}}\}}', '[…]', 'g'), '') heading from {_HEAD}",
    "tag_counts": f"""with k as (select doc, 'document' tag, 1 n from {_U} group by doc union all select doc, 'section', 1 + count_if(kind = 'section_heading') from {_U} group by doc union all select doc, 'title', count_if(kind in ('section_heading', 'title')) from {_U} group by doc union all select doc, 'front', count_if(kind = 'title') from {_U} group by doc
 union all select doc, 'abstract', count_if(kind = 'abstract') from {_U} group by doc union all select doc, 'caption', count_if(kind = 'caption') from {_U} group by doc union all select doc, 'p', count_if(kind in ('paragraph', 'abstract', 'item')) from {_U} group by doc
 union all select doc, regexp_extract(token, 'PT_([A-Za-z]+)_', 1), count(*) from (select doc, unnest(map_keys(placeholders)) token from {_U}) group by 1, 2) select doc, tag, n::int n from k where n > 0""",
    "document_facts": rf"""select doc, md5(coalesce(first(regexp_replace(t, '\{{\{{PT_[A-Za-z]+_[0-9]+\}}\}}', '', 'g') order by place) filter (where kind in ('title', 'section_heading') and trim(regexp_replace(t, '\{{\{{PT_[A-Za-z]+_[0-9]+\}}\}}', '', 'g')) <> ''), 'Untitled')) title_md5,
 sum(case when kind in ('paragraph', 'abstract', 'item') then length(regexp_replace(split_part(t, '{{{{PT_', 1), '[^㐀-鿿]', '', 'g')) else 0 end)::int han, sum(len(list_filter(map_keys(placeholders), lambda k: contains(k, 'PT_ref_') or contains(k, 'PT_cite_'))))::int "references", sum(len(list_filter(map_keys(placeholders), lambda k: contains(k, 'PT_Math_') or contains(k, 'PT_equation_'))))::int formulas
 from (select *, replace(src_text, '{{{{NL}}}}', chr(10)) t from {_U}) group by doc""",
    "rebuilt_identity": f"select doc, a annotations, a annotations_kept, 100.0::double ppa, (case when a > 0 then 100 else 0 end)::double ppa_ordered, f formulas, f formulas_kept, 100.0::double mfr, (case when f > 0 then 100 else 0 end)::double mfr_ordered from (select doc, sum(cardinality(placeholders))::bigint a, sum(len(list_filter(map_keys(placeholders), lambda k: contains(k, 'PT_Math_') or contains(k, 'PT_equation_'))))::bigint f from {_U} group by doc)",
    "system_fidelity": f"""with o as {_OF.format(u=_U, l=SQL_LATEST, clean=_CLEAN)}, s as (select unnest(['contract', 'flat', 'raw_xml', 'naive']) as system), j as (select distinct l.job_id from {SQL_LATEST} l join {_U} u on u.id = l.unit_id where l.tgt_text is not null and {_CLEAN} <> '')
 select j.job_id, s.system, count(token)::bigint annotations, coalesce(sum(case when (system = 'naive' or system = 'flat' and regexp_matches(tgt_text, '[&<]')) and tgt_text is not null then 0 else kept::int end), 0)::bigint annotations_kept, coalesce(count_if(tag in ('Math', 'equation')), 0)::bigint formulas, coalesce(sum(case when tag not in ('Math', 'equation') or (system = 'naive' or system = 'flat' and regexp_matches(tgt_text, '[&<]')) and tgt_text is not null then 0 else kept::int end), 0)::bigint formulas_kept from j cross join s left join o on o.job_id = j.job_id group by 1, 2""",
    "abstract_only": rf"select doc, count(*) units, sum(length(trim(regexp_replace(replace(regexp_replace({_CLEAN}, '\{{\{{PT_[A-Za-z]+_[0-9]+\}}\}}', '', 'g'), '{{{{NL}}}}', ' '), '[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+', ' ', 'g'))))::bigint chars from {_U} where kind = 'abstract' and {_CLEAN} <> '' group by doc",
    "raw_units": f"select doc, count(*) units, sum(cardinality(placeholders))::bigint elements from {_U} where src_text <> '' group by doc",
    "latex_survival": rf"""with u as (select id unit_id, token, count(*) ns from (select id, unnest(regexp_extract_all(src_text, '\{{\{{PT_[A-Za-z]+_[0-9]+\}}\}}')) token from translation_units) group by 1, 2), l as (select * from {SQL_LATEST}), n as (select job_id, unit_id, token, count(*) nt from (select job_id, unit_id, unnest(regexp_extract_all(tgt_text, '\{{\{{PT_[A-Za-z]+_[0-9]+\}}\}}')) token from l) group by 1, 2, 3)
 select l.job_id, case regexp_extract(u.token, 'PT_([A-Za-z]+)', 1) when 'Math' then 'formula' when 'equation' then 'label' else regexp_extract(u.token, 'PT_([A-Za-z]+)', 1) end kind, sum(ns)::bigint total, sum(least(ns, coalesce(nt, 0)))::bigint survived from l join u on u.unit_id = l.unit_id left join n on n.job_id = l.job_id and n.unit_id = l.unit_id and n.token = u.token group by 1, 2""",
}
