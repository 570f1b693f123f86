"""Mixing sources to target weights by hierarchical budgeting.

The documents' tokens are summed by leaf, a source in one language within a domain. The total budget is handed
down a tree of domains, languages and sources by weight. What a leaf can't take (its tokens times the
source's max_repeats) goes to its siblings first, then to the siblings of its parent, and so on. Each leaf
takes whole epochs of its documents and, for the rest, a prefix of one more epoch in seeded order.

The prefix needs no sort of a leaf: tokens are summed by leaf and by slice of the order; the running sum of
the slices finds the one where the budget ends, and only its documents are ordered one by one.

Defined results: documents of unlisted or null sources aren't used; null and empty texts have no tokens and no
use; a source without tokens has share 0 and `met` false; an empty table gives every source with zeros; a
document id that occurs twice counts as two documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICES = 4096
#: The targets table has a row for each source; more than this isn't sent to the driver.
MOST_SOURCES = 100_000
#: By default the total is the largest at which every source with tokens meets its target, but not less than
#: this share of the tokens there are, so that one tiny source can't shrink the mixture.
LEAST_OF_ALL = 0.5


@dataclass
class Node:
    """A node of the tree: weight, capacity and, once handed down, budget in tokens."""

    weight: float = 0.0
    capacity: float = 0.0
    budget: float = 0.0
    below: dict[str, Node] = field(default_factory=dict)


def hand_down(node: Node, budget: float) -> float:
    """Gives `budget` to a node and its children; returns what they can't take.

    Children get shares by weight; what one can't take is shared among its siblings that still can, again by
    weight, and only what all of them can't take goes back to the parent.
    """
    node.budget = min(budget, node.capacity)
    if not node.below:
        return budget - node.budget
    open_to = {k: c for k, c in node.below.items() if c.capacity > 0 and c.weight > 0}
    given = dict.fromkeys(node.below, 0.0)
    left = node.budget
    while open_to and left > 1e-9:
        total = sum(c.weight for c in open_to.values())
        full = [k for k, c in open_to.items() if given[k] + left * c.weight / total >= c.capacity]
        if not full:
            for k, c in open_to.items():
                given[k] += left * c.weight / total
            left = 0.0
            break
        for k in full:
            left -= open_to[k].capacity - given[k]
            given[k] = open_to.pop(k).capacity
    for k, c in node.below.items():
        hand_down(c, given[k])
    node.budget -= left
    return budget - node.budget


def tree(leaves: list[tuple[str, str, float, float, float]], domains: dict[str, str]) -> Node:
    """The tree of (source, language, tokens, target share, max repeats); a source without a domain is one of its own."""
    of_source: dict[str, float] = {}
    for source, _, tokens, _, _ in leaves:
        of_source[source] = of_source.get(source, 0.0) + tokens
    root = Node()
    for source, lang, tokens, share, repeats in leaves:
        weight = share * tokens / of_source[source] if of_source[source] else 0.0
        node = root
        for key in (domains.get(source, source), lang, source):
            node.weight += weight
            node.capacity += tokens * repeats
            node = node.below.setdefault(key, Node())
        node.weight += weight
        node.capacity += tokens * repeats
    return root


def budgets(leaves: list[tuple[str, str, float, float, float]], total: float | None = None, domains: dict[str, str] | None = None) -> dict[tuple[str, str], float]:
    """Tokens for each (source, language)."""
    root = tree(leaves, domains or {})
    if total is None:
        capacity: dict[str, list[float]] = {}
        for source, _, tokens, share, repeats in leaves:
            c = capacity.setdefault(source, [0.0, share])
            c[0] += tokens * repeats
        feasible = [c / share for c, share in capacity.values() if share > 0 and c > 0]
        total = max(min(feasible, default=0.0), LEAST_OF_ALL * sum(x[2] for x in leaves))
    hand_down(root, total)
    return {
        (source, lang): node.budget
        for domain in root.below.values()
        for lang, sources in domain.below.items()
        for source, node in sources.below.items()
    }


def _targets(targets: DataFrame) -> list:
    rows = targets.where("source is not null").select("source", "target_share", "max_repeats").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return rows


def _domains(domains: DataFrame | None) -> dict[str, str]:
    rows = [] if domains is None else domains.where("source is not null and domain is not null").groupBy("source").agg(F.min("domain").alias("domain")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return {r.source: r.domain for r in rows}


def uses(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42, domains: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, lang, tokens, uses) of all documents of `sizes` (doc_id, source, lang, tokens) that are used.

    `domains` (source, domain) makes the upper level of the tree. What reaches the driver is a row a source and language.
    """
    spark = sizes.sparkSession
    wanted = {r.source: r for r in _targets(targets)}
    docs = sizes.where(F.col("source").isin(list(wanted)) & (F.col("tokens") > 0)).withColumn("lang", F.coalesce("lang", F.lit("")))
    sums = docs.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens")).collect()
    leaves = [(r.source, r.lang, float(r.tokens), float(wanted[r.source].target_share), float(wanted[r.source].max_repeats)) for r in sums]
    plan = []
    for (source, lang), budget in budgets(leaves, total, _domains(domains)).items():
        tokens = next(x[2] for x in leaves if x[:2] == (source, lang))
        epochs = min(int(budget // tokens), int(wanted[source].max_repeats))
        rest = budget - epochs * tokens if epochs < wanted[source].max_repeats else 0.0
        plan.append((source, lang, epochs, float(rest)))
    leaf = spark.createDataFrame(plan, "source string, lang string, epochs int, rest double")
    docs = docs.join(F.broadcast(leaf), ["source", "lang"])  # a row a source and language
    place = F.xxhash64(F.lit(seed), "epochs", "doc_id")
    docs = docs.withColumns({"place": place, "slice": F.shiftrightunsigned(place, 52).cast("int")})
    by_slice = docs.groupBy("source", "lang", "slice").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    running = Window.partitionBy("source", "lang").orderBy("slice")
    by_slice = by_slice.withColumn("upto", F.sum("t").over(running))
    # the slice where the rest of the budget ends, and what is left for it
    last = by_slice.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("t") <= F.col("rest"))).select(
        "source", "lang", F.col("slice").alias("last"), (F.col("rest") - F.col("upto") + F.col("t")).alias("left")
    )
    docs = docs.join(F.broadcast(last), ["source", "lang"], "left")  # at most a row a source and language
    whole = F.coalesce(F.col("slice") < F.col("last"), F.col("rest") > 0)
    order = Window.partitionBy("source", "lang").orderBy("place", "doc_id")
    edge = docs.where(F.col("slice") == F.col("last")).withColumn("upto", F.sum("tokens").over(order))
    # the document that crosses the end is taken if that comes closer to the budget
    edge = edge.withColumn("extra", (F.col("upto") - F.col("tokens") / 2 <= F.col("left")).cast("int")).drop("upto")
    rest = docs.where(F.col("last").isNull() | (F.col("slice") != F.col("last"))).withColumn("extra", whole.cast("int"))
    return (
        rest.unionByName(edge)
        .withColumn("uses", F.col("epochs") + F.col("extra"))
        .where("uses > 0")
        .select("doc_id", "source", F.nullif("lang", F.lit("")).alias("lang"), "tokens", "uses")
    )


def report(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42, domains: DataFrame | None = None) -> DataFrame:
    """For each source of `targets`, what there is, what is used and the share reached."""
    used = uses(sizes, targets, total, seed, domains).groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.sum("uses").cast("bigint").alias("uses"), F.max("uses").alias("most_uses"), F.count("*").alias("documents_used")
    )
    there = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available_tokens"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("documents", "available_tokens", "documents_used", "used_tokens", "uses", "most_uses")}
    out = targets.select("source", "target_share", "max_repeats").join(there, "source", "left").join(used, "source", "left").withColumns(zero)
    everything = Window.partitionBy()  # a row a source
    out = out.withColumn("share", F.coalesce(F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(everything)), F.lit(0.0)))
    return out.withColumn("met", (F.col("used_tokens") > 0) & (F.abs(F.col("share") - F.col("target_share")) <= 0.01 * F.col("target_share") + 0.001))
