"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.order import latest
from scriptorium.sources import table

#: One row of a translation, as repeated rows are equal.
SQL_TRANSLATIONS = "(select distinct id, job_id, unit_id, status, pass_no, model_used, tgt_text, tgt_plain, comet_score, xcomet_score, ppa_unit, fps_unit, rcs_unit, cached_prompt_tokens, fresh_prompt_tokens, completion_tokens, elapsed_ms from translations)"
#: The last pass of each unit in each job that isn't pending.
SQL_LATEST = f"(select * from (select *, row_number() over (partition by job_id, unit_id order by pass_no desc, id desc) r from {SQL_TRANSLATIONS} t where status <> 'pending') where r = 1)"
SQL_CLAIMS = "(select distinct id, unit_id, claim_type, span_start, span_end, surface_form, normalized, metadata, confidence from verifiable_claims)"


def translations(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Translations without repeated rows; only the columns asked for are read and compared."""
    need = dict.fromkeys(("id", *columns))
    return table(spark, d, "translations").select(*need).distinct()


def last_passes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The last pass of each unit in each job that isn't pending."""
    # repeated rows are equal and share job, unit, pass and id, so the first row of a unit is enough
    need = dict.fromkeys(("id", "job_id", "unit_id", "pass_no", "status", *columns))
    t = table(spark, d, "translations").select(*need).where("status <> 'pending'")
    return latest(t, ["job_id", "unit_id"], [F.desc("pass_no"), F.desc("id")])


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims without repeated rows."""
    return table(spark, d, "verifiable_claims").select("id", "unit_id", "claim_type", "span_start", "span_end", "surface_form", "normalized", "metadata", "confidence").distinct()
