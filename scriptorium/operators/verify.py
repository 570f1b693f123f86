"""Verification of claims: which of a source's facts its translation still states.

A source claim meets the claim of its translation that `match.greedy_match` gives it. Comparisons are judged by the order
the translation states. A claim without a counterpart, or with one that drifted, still counts as verified if its anchor
stands word for word in the translation (`lenient`). A translation without text misses everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import facts
from scriptorium.operators import match

#: What a verdict on a comparison means as a drift, and how grave it is.
VERDICTS = {"preserved": ("verified", 0.0), "reversed": ("comparison_flip", 1.0), "dropped": ("missing", 1.0), "weakened": ("partial", 0.5)}
DRIFTS = ("verified", "missing", "partial", "numeric_drift", "citation_swap", "comparison_flip", "method_drift", "symbol_drift")


def compared(surface: Column, target: Column) -> Column:
    """The verdict on a source comparison, by the baseline and the order that the target states."""
    c, text = facts.comparison(surface), F.coalesce(target, F.lit(""))
    order = facts.stated_order(text)
    present = F.coalesce(F.contains(F.lower(text), F.lower(c["baseline"])), F.lit(False)) | (order != "?")
    side = lambda base, way: F.struct(F.lit("").alias("entity_a"), base.alias("entity_b"), F.coalesce(way, F.lit("?")).alias("direction"))
    return facts.verdict(side(c["baseline"], c["direction"]), side(c["baseline"], order), present, F.lit(False))


def verified(translations: DataFrame, claims: DataFrame, lenient: bool = True) -> DataFrame:
    """(translation_id, claim_id, claim_type, drift, magnitude): a row for each claim of the unit of each translation.

    Reads translation_id, unit_id, tgt_plain; and unit_id, claim_id, claim_type, surface_form, normalized. Claims must be
    distinct. Units without claims give no row.
    """
    t = translations.select("translation_id", "unit_id", "tgt_plain")
    c = claims.select("unit_id", F.col("claim_id").cast("bigint").alias("claim_id"), "claim_type", "surface_form", "normalized")
    # the facts of either side are worked out before they meet, each once
    surface = F.col("surface_form")
    known = c.where("claim_type <> 'comparison' or claim_type is null").withColumns({"_n": facts.numeric(surface), "_y": facts.citation(surface)["year"]})
    pairs = known.join(t, "unit_id")
    found = t.select("translation_id", F.posexplode(facts.found_claims(F.col("tgt_plain"))).alias("claim_id", "c")).select("translation_id", F.col("claim_id").cast("bigint").alias("claim_id"), "c.*")
    found = found.withColumns({"form": F.col("normalized"), "unit": facts.unit_of(F.col("surface")), "year": facts.citation(F.col("surface"))["year"]})
    source = pairs.select("translation_id", "claim_id", F.col("claim_type").alias("kind"), "normalized", F.col("_n.precision").alias("precision"))
    got = match.greedy_match(source, found, "translation_id", "claim_id", ("form", "unit", "year"))
    got = got.select("translation_id", F.col("source_id").alias("claim_id"), "target_id", F.col("form").alias("_form"), F.struct(F.col("form").alias("value"), "unit").alias("_m"), F.col("year").cast("int").alias("_z"))
    rows = pairs.join(got, ["translation_id", "claim_id"], "left")
    kind = F.col("claim_type")

    def side(form: str, figure: str, year: str) -> Column:
        value = F.when(kind == "numeric", F.col(f"{figure}.value")).otherwise(F.col(form))
        return F.struct(value.alias("normalized"), F.col(f"{figure}.unit").alias("unit"), F.col(year).alias("year"), F.lit(None).cast("string").alias("direction"))

    rows = rows.withColumn("_d", facts.drift(kind, side("normalized", "_n", "_y"), side("_form", "_m", "_z")))
    rows = rows.withColumns({"drift": F.when(F.col("target_id").isNull(), "missing").otherwise(F.col("_d.drift")), "magnitude": F.when(F.col("target_id").isNull(), 1.0).otherwise(F.col("_d.magnitude"))})
    if lenient:
        rows = rows.withColumn("_kept", facts.anchor_kept(kind, surface, F.col("normalized"), F.col("tgt_plain")))
        rows = rows.withColumns({"drift": F.when(F.col("_kept"), "verified").otherwise(F.col("drift")), "magnitude": F.when(F.col("_kept"), 0.0).otherwise(F.col("magnitude"))})
    blank = F.coalesce("tgt_plain", F.lit("")) == ""
    columns = ("translation_id", "claim_id", "claim_type", "drift", "magnitude")
    rows = rows.withColumns({"drift": F.when(blank, "missing").otherwise(F.col("drift")), "magnitude": F.when(blank, 1.0).otherwise(F.col("magnitude"))}).select(*columns)
    judged = c.where("claim_type = 'comparison'").join(t, "unit_id").withColumn("_v", F.when(blank, "dropped").otherwise(compared(surface, F.col("tgt_plain"))))
    to = lambda k: F.create_map(*[F.lit(x) for v, what in VERDICTS.items() for x in (v, what[k])])[F.col("_v")]
    return rows.unionByName(judged.withColumns({"drift": to(0), "magnitude": to(1)}).select(*columns))


def rechecked(failed: DataFrame, translations: DataFrame, claims: DataFrame) -> DataFrame:
    """`failed` (translation_id, claim_id) with kept: whether the claim's anchor stands in the translation after all, without a glossary."""
    c = claims.select(F.col("claim_id").cast("bigint").alias("claim_id"), "claim_type", "surface_form", "normalized")
    kept = facts.anchor_kept(F.col("claim_type"), F.col("surface_form"), F.col("normalized"), F.col("tgt_plain"))
    return failed.select("translation_id", "claim_id").join(c, "claim_id").join(translations.select("translation_id", "tgt_plain"), "translation_id").select("translation_id", "claim_id", "claim_type", kept.alias("kept"))


def histogram(checked: DataFrame, keys: list[str]) -> DataFrame:
    """For each key: claims, their verified share, the share of each kind (null without any), and how many of each drift (0 without any)."""
    good = F.col("drift") == "verified"
    kinds = [F.round(F.try_divide(F.count_if(good & (F.col("claim_type") == k)).cast("double"), F.count_if(F.col("claim_type") == k).cast("double")), 6).alias(f"fps_{k}") for k in facts.KINDS]
    drifts = [F.count_if(F.col("drift") == x).alias(f"n_{x}") for x in DRIFTS]
    return checked.groupBy(*keys).agg(F.count("*").alias("claims"), F.round(F.count_if(good) / F.count("*"), 6).alias("fps"), *kinds, *drifts)
