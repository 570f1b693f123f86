"""Joins beyond equality: longest prefix, words in text, greedy one-to-one."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.order import first_wins
from scriptorium.session import checkpointed


def path_prefixes(path: Column) -> Column:
    """All ancestors of "/a/b[2]/c" and itself: "/a", "/a/b[2]", "/a/b[2]/c"."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def longest_prefix(units: DataFrame, sections: DataFrame, keys: list[str], unit_path: str, section_path: str, section_id: str) -> DataFrame:
    """`units` with the id of the deepest section whose path is theirs or an ancestor's; null where there is none.

    A unit's ancestors are listed, so the join is an equality and not a comparison of all pairs.
    """
    ids = [*keys, unit_path]
    probe = units.where(F.size(F.split(unit_path, "/")) > 1).select(*ids, F.explode(path_prefixes(F.col(unit_path))).alias("_p")).distinct()
    s = sections.select(*keys, F.col(section_path).alias("_p"), F.col(section_id).alias("_id"))
    best = probe.join(s, [*keys, "_p"]).groupBy(*ids).agg(F.max_by("_id", F.length("_p")).alias("matched_section"))
    return units.join(best, ids, "left")


#: Terms that are sent to all executors at most; beyond it they are joined.
SENT_TERMS = 200_000
ACRONYM = "^[A-Z][A-Z0-9]+$"


def _key(c: Column) -> Column:
    """A term or text as words of letters and figures with single spaces, lower case."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w]+|_", " "))


class _Trie(dict):
    """Terms by their words, then by None."""

    def put(self, words: list[str], term: str) -> None:
        at = self
        for w in words:
            at = at.setdefault(w, {})
        at.setdefault(None, []).append(term)

    def found(self, words: list[str]) -> set[str]:
        out: set[str] = set()
        for i, w in enumerate(words):
            at, k = self.get(w), i + 1
            while at is not None:
                out.update(at.get(None, ()))
                at, k = (at.get(words[k]), k + 1) if k < len(words) else (None, k)
        return out


def words_in_text(texts: DataFrame, text_id: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """(text_id, term): terms of one or more words that occur in a text as whole words, each once a text.

    Case doesn't count, save for acronyms; letters of all scripts do. Where a script has no spaces a term may stand
    anywhere. Up to SENT_TERMS terms (as a count shows) are looked for by a tree of words in each text; more are joined with
    the texts' runs of words.
    """
    t = terms.select(F.col(term).alias("term"), _key(F.col(term)).alias("_key")).where("_key <> ''").distinct()
    slim = texts.where(F.col(text).isNotNull()).select(text_id, F.col(text).alias("_text"))
    few = t.limit(SENT_TERMS + 1).collect()  # bounded
    if len(few) <= SENT_TERMS:
        return _by_tree(slim, text_id, [(r.term, r._key) for r in few])
    runs = slim.select(text_id, "_text", F.split(_key(F.col("_text")), " ").alias("_w"))
    longest = t.agg(F.max(F.size(F.split("_key", " ")))).first()[0]

    def runs_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("_w") - n + 1)
        return F.when(F.size("_w") >= n, F.transform(starts, lambda i: F.array_join(F.slice("_w", i, n), " "))).otherwise(F.array().cast("array<string>"))

    grams = runs.select(text_id, "_text", F.explode(F.array_distinct(F.concat(*map(runs_of, range(1, longest + 1))))).alias("_key"))
    exact = ~F.col("term").rlike(ACRONYM) | F.rlike(F.col("_text"), F.concat(F.lit(r"(?U)(?<!\w)"), F.col("term"), F.lit(r"(?!\w)")))
    return grams.join(t, "_key").where(exact).select(text_id, "term").distinct()


def _by_tree(slim: DataFrame, text_id: str, terms: list[tuple[str, str]]) -> DataFrame:
    word, wide, acronym = re.compile(r"[^\W_]+"), re.compile("[㐀-鿿ぁ-ヿก-๛]"), re.compile(ACRONYM)
    spaced, anywhere, exact = _Trie(), [], _Trie()
    for term, key in terms:
        if wide.search(key):
            anywhere.append((key.replace(" ", ""), term))
        else:
            (exact.put(word.findall(term), term) if acronym.match(term) else spaced.put(key.split(" "), term))
    sent = slim.sparkSession.sparkContext.broadcast((spaced, exact, anywhere))  # SENT_TERMS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaced, exact, anywhere = sent.value
        for batch in batches:
            at, said = [], []
            for i, x in enumerate(batch.column("_text").to_pylist()):
                words = word.findall(x)
                got = spaced.found([w.lower() for w in words]) | (exact.found(words) if exact else set())
                if anywhere:
                    bare = "".join(words).lower()
                    got |= {term for key, term in anywhere if key in bare}
                at += [i] * len(got)
                said += sorted(got)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(said, pa.string())], names=[text_id, "term"])

    return slim.mapInArrow(run, f"`{text_id}` {dict(slim.dtypes)[text_id]}, term string")


def overlapping(df: DataFrame, row_id: str, words: str, least: int) -> DataFrame:
    """(id_a, id_b, words_a, words_b): pairs of rows, id_a < id_b, whose sets of words share `least` at least.

    Of a row's words the most frequent least - 1 can't be all that two rows share, so only the others, the rarest, are looked
    up: a word that a third of all rows have is hardly ever among them.
    """
    rows = df.select(F.col(row_id).alias("_id"), F.array_distinct(words).alias("_w")).where(F.size("_w") >= least)
    each = rows.select("_id", F.size("_w").alias("_n"), F.explode("_w").alias("_k"))
    often = each.groupBy("_k").agg(F.count("*").alias("_often"))
    rank = F.row_number().over(Window.partitionBy("_id").orderBy("_often", "_k"))
    rare = each.join(often, "_k").withColumn("_r", rank).where(F.col("_r") <= F.col("_n") - least + 1).select("_id", "_k")
    a, b = rare.withColumnRenamed("_id", "id_a"), rare.withColumnRenamed("_id", "id_b")
    pairs = a.join(b, "_k").where("id_a < id_b").select("id_a", "id_b").distinct()
    side = lambda x: rows.select(F.col("_id").alias(f"id_{x}"), F.col("_w").alias(f"words_{x}"))
    out = pairs.join(side("a"), "id_a").join(side("b"), "id_b")
    return out.where(F.size(F.array_intersect("words_a", "words_b")) >= least).select("id_a", "id_b", "words_a", "words_b")


def tree(nodes: DataFrame, node: str, parent: str, order: str) -> DataFrame:
    """`nodes` with level and path, the orders from the root on with points between; nodes that no root leads to are left out.

    One join a level, until a level is empty; each level is kept, so the plan doesn't grow.
    """
    now = nodes.where(F.col(parent).isNull()).withColumns({"level": F.lit(0), "path": F.col(order).cast("string")})
    out, level = now, 0
    while level < 10_000:
        level += 1
        up = now.select(F.col(node).alias("_up"), F.col("path").alias("_path"))
        now = checkpointed(nodes.join(up, F.col(parent) == F.col("_up")).withColumns({"level": F.lit(level), "path": F.concat_ws(".", "_path", F.col(order).cast("string"))}).drop("_up", "_path"))
        if now.limit(1).count() == 0:
            return out
        out = out.unionByName(now)
    raise ValueError("the parents of some nodes go round in a circle")


def greedy_match(source: DataFrame, target: DataFrame, key: str, claim_id: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, source_id, target_id, columns of `carry` of the target as strings): each source claim takes a target claim of its kind that none before took.

    Sources come in order of id. The target with the same normal form is preferred, then, for figures, one of
    the same precision, then the first left. A source without a target gets null. Both frames need kind,
    normalized and precision beside key and id; what is taken depends on what was, so a key is one task's work.
    """
    fields = (F.col(claim_id).cast("bigint").alias("id"), F.col("kind"), F.col("normalized"), F.col("precision").cast("int").alias("precision"))
    one = F.struct(*fields)
    more = F.struct(*fields, *[F.col(c).cast("string").alias(f"_{c}") for c in carry])
    lists = source.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("s"))
    lists = lists.join(target.groupBy(key).agg(F.array_sort(F.collect_list(more)).alias("t")), key, "left")
    schema = f"{key} {dict(source.dtypes)[key]}, source_id bigint, target_id bigint" + "".join(f", `{c}` string" for c in carry)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sources, targets, carried = [], [], [], [[] for _ in carry]
            for i, (s, t) in enumerate(zip(batch.column("s").to_pylist(), batch.column("t").to_pylist(), strict=True)):
                left = list(t or ())
                for claim in s:
                    free = [x for x in left if x["kind"] == claim["kind"]]
                    hit = next((x for x in free if x["normalized"] == claim["normalized"]), None)
                    if hit is None and claim["kind"] == "numeric":
                        hit = next((x for x in free if x["precision"] == claim["precision"]), None)
                    hit = hit or (free[0] if free else None)
                    if hit is not None:
                        left.remove(hit)
                    keys.append(i)
                    sources.append(claim["id"])
                    targets.append(hit["id"] if hit else None)
                    for c, out in zip(carry, carried, strict=True):
                        out.append(hit[f"_{c}"] if hit else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keys, pa.int32())), pa.array(sources, pa.int64()), pa.array(targets, pa.int64()), *(pa.array(x, pa.string()) for x in carried)],
                names=[key, "source_id", "target_id", *carry],
            )

    return lists.mapInArrow(matched, schema)


def absent(candidates: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `candidates` whose keys `present` lacks; null keys are never present."""
    return candidates.join(present.select(*keys).distinct(), keys, "left_anti")


def bank(entries: DataFrame, term: str, rendering: str, order: list[Column]) -> DataFrame:
    """(key, rendering) of a bank of terms: the first entry of each term, whatever its case."""
    return first_wins(entries.where(F.col(term).isNotNull()), F.lower(F.col(term)), order).select(F.lower(F.col(term)).alias("key"), F.col(rendering).alias("rendering"))


def grounded(terms: DataFrame, term: str, banks: list[DataFrame]) -> DataFrame:
    """`terms` with rendering and grounded_in: the first bank, from 1, that has the term; 0 and null if none has or it is an acronym."""
    out = terms.withColumn("_key", F.when(~F.col(term).rlike("^[A-Z][A-Z0-9]+$"), F.lower(F.col(term))))
    for n, b in enumerate(banks, 1):
        out = out.join(b.select(F.col("key").alias("_key"), F.col("rendering").alias(f"_r{n}")), "_key", "left")
    found = F.coalesce(*(F.col(f"_r{n}") for n in range(1, len(banks) + 1)))
    which = F.coalesce(*(F.when(F.col(f"_r{n}").isNotNull(), n) for n in range(1, len(banks) + 1)), F.lit(0))
    return out.withColumns({"rendering": found, "grounded_in": which}).drop("_key", *(f"_r{n}" for n in range(1, len(banks) + 1)))
