"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import align, content, forms, mix, names, pairs, sentences, tokens
from scriptorium.llm.tables import spread, translated
from scriptorium.session import checkpointed
from scriptorium.sources import table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(side, row_id, text) of src_plain and tgt_plain."""
    src = table(spark, sf_dir, "translation_units").select(
        F.lit("src").alias("side"), F.col("id").cast("bigint").alias("row_id"), F.col("src_plain").alias("text")
    )
    tgt = table(spark, sf_dir, "translations").select(
        F.lit("tgt").alias("side"), F.col("id").alias("row_id"), F.col("tgt_plain").alias("text")
    )
    return spread(src.union(tgt))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sentences of which one translates the other."""
    texts = translated(spark, sf_dir, "src_plain", "tgt_plain")
    return align.aligned(texts.withColumnsRenamed({"src_plain": "src", "tgt_plain": "tgt"}))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every unit and translation."""
    return sentences.sentence_rows(_texts(spark, sf_dir), ["side", "row_id"], "text").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows of one side whose texts differ but read the same."""
    return forms.alike(_texts(spark, sf_dir), F.col("side"), F.col("row_id"), F.col("text"))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every text, with full compatibility mapping and case folding, for comparisons that ignore both."""
    return forms.forms(_texts(spark, sf_dir), ["side", "row_id"], "text", fold_case=True, compatible=True).distinct()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    docs = spread(table(spark, sf_dir, "documents"))
    return tokens.encode(docs, ["doc_id"], "text", f"{tokens.FOLDER}/byte_bpe_50k.tiktoken")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = names.author_names(table(spark, sf_dir, "arxiv_en2zh_manifest"), "authors")
    claims = table(spark, sf_dir, "verifiable_claims").where("claim_type = 'citation'")
    cited = names.cited_names(claims, "surface_form")
    return authors.withColumn("cited", F.lit(False)).union(cited.withColumn("cited", F.lit(True)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings that mean the same person or organisation."""
    return names.variants(_names(spark, sf_dir))


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with a key of its person or organisation."""
    return names.entities(_names(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defective pair of source and translation, or of question and answer."""
    t = translated(spark, sf_dir, "src_text", "src_plain", "tgt_text")
    # a unit that holds only placeholders has nothing to translate
    t = t.where(F.length(F.trim("src_plain")) > 0)
    t = t.select(F.lit("translation").alias("pair_kind"), "row_id", F.col("src_text").alias("prompt"), F.col("tgt_text").alias("response"), "lang")
    q = table(spark, sf_dir, "comprehension_qa").select(
        F.lit("qa").alias("pair_kind"),
        F.col("id").cast("bigint").alias("row_id"),
        F.col("question").alias("prompt"),
        F.col("reference_answer").alias("response"),
        F.col("question_lang").alias("lang"),
    )
    return pairs.defects(t.union(q))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, tokens) of every document, written once as it is read several times."""
    docs = spread(table(spark, sf_dir, "documents"))
    return checkpointed(tokens.count_tokens(docs, ["doc_id", "source", "lang"], "text", f"{tokens.FOLDER}/byte_bpe_50k.tiktoken"))


#: Domains of the sources of these tables, by domain.
DOMAINS = {
    "papers": "abstracts fulltext_sections proceedings theses legacy_scans", "talk": "review_forum preprint_comments reading_club mailing_list qa_board",
    "media": "captions talk_transcripts", "aids": "translator_notes glossary_notes code_readme",
}


def _domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, d) for d, sources in DOMAINS.items() for s in sources.split()], "source string, domain string")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source, with what was there and how often it was used."""
    return mix.report(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"), domains=_domains(spark))


def p7_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each used document is used."""
    return mix.uses(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"), domains=_domains(spark))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document."""
    return content.scores(spread(table(spark, sf_dir, "documents")), ["doc_id"], "text", table(spark, sf_dir, "content_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents to be reviewed."""
    return p8_scores(spark, sf_dir).where(F.col("score") >= content.THRESHOLD).select("doc_id").distinct()


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each source are to be reviewed."""
    return content.rates(content.scores(spread(table(spark, sf_dir, "documents")), ["doc_id", "source"], "text", table(spark, sf_dir, "content_labels")))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_entities": p3_entities,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_forms": p5_forms,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_uses": p7_uses,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
}
ORACLES: dict[str, str] = {}
