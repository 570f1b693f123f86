"""Variant spellings of the names of people and organisations, linked by a pigeonhole segment join.

Each string is taken apart into family name, given name, initials and year, or into the kind and the telling
word of an organisation. Misspelt words are found by cutting each word into k + 1 segments, k being the edits a word
of its length may have (`edits`): k edits leave one segment alone at least, so substrings of a word at the places
it may have shifted to are looked up in an inverted index of segments, for the lengths k edits can give, and the
candidates are verified by banded edit distance (a swap of neighbours counts as one edit). A misspelling goes to its
most frequent neighbour, unless it is a name in its own right: one that people with three different initials bear,
or whose bearers share no initial with the neighbour's. Nicknames, initials and bare family names are then joined
to the one person of the family they fit; where several fit, the year of a citation decides or nothing.

All steps are joins and aggregations of distinct strings; nothing but the result pairs within an entity.

Defined results: null and empty names, "et al." and bracketed numbers are no names; strings that differ only
in where they occur count once; an initial or bare family name that fits several people is linked only to
strings that are as unclear in the same way.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.session import checkpointed

# Short names and the full ones they stand for.
NICKNAMES = """
bob robert|bobby robert|rob robert|bert robert albert|kathy katherine kathleen|kate katherine|kat katherine|katie katherine
tommy thomas|tom thomas|fred frederick alfred|freddy frederick|freddie frederick|nick nicholas|nicky nicholas|nico nicholas
bill william|billy william|will william|liam william|liz elizabeth|beth elizabeth|lizzy elizabeth|eliza elizabeth|betty elizabeth
chris christopher christine|topher christopher|kit christopher|larry lawrence|laurie lawrence|joe joseph|joey joseph|jo joseph joanna
sam samantha samuel|sammy samantha samuel|pat patricia patrick|patty patricia|trish patricia|tricia patricia|ned edward|ed edward edwin
eddie edward|ted edward theodore|teddy edward theodore|jen jennifer|jenny jennifer|jenn jennifer|drew andrew|andy andrew|greg gregory|gregg gregory
dan daniel|danny daniel|mike michael|mick michael|mickey michael|debbie deborah|deb deborah|debby deborah|sue susan|susie susan|suzy susan
vicky victoria|vicki victoria|tori victoria|vic victoria victor|alex alexander alexandra|sasha alexander alexandra|lex alexander|xander alexander|sandy alexander sandra
maggie margaret|meg margaret|peggy margaret|peg margaret|marge margaret|rita margaret|rick richard|rich richard|dick richard|ricky richard|pepe jose|pepito jose
matt matthew|steve stephen steven|jim james|jimmy james|jack john|johnny john|dave david|tony anthony|ben benjamin|becky rebecca|cathy catherine
charlie charles|chuck charles|harry henry|hank henry|ron ronald|don donald|ken kenneth|ray raymond|nate nathaniel|abby abigail|mandy amanda|ellie eleanor
nell eleanor helen|lena helene|ingie ingrid|inga ingrid|olu olumide|ana ananya|farry farid|wm william|robt robert|thos thomas|jos joseph|chas charles
"""
NICK = {w[0]: w[1:] for w in (line.split() for line in re.split(r"[|\n]", NICKNAMES)) if len(w) > 1}
# Words of the names of organisations, and short forms of them.
ORG_WORDS = (
    "research laboratory group working collaboration consortium institute technology university center network "
    "project team society department initiative alliance foundation academy college school observatory agency "
    "council association program division committee"
).split()
ORG_SHORT = {
    "lab": "laboratory", "labs": "laboratory", "laboratories": "laboratory", "grp": "group", "gp": "group", "collab": "collaboration",
    "coll": "collaboration", "cons": "consortium", "consort": "consortium", "inst": "institute", "tech": "technology", "technol": "technology",
    "univ": "university", "uni": "university", "centre": "center", "ctr": "center", "dept": "department", "res": "research", "wg": "working",
    "wkg": "working", "found": "foundation", "acad": "academy", "assoc": "association", "soc": "society", "obs": "observatory",
}
SMALL = frozenset("of for the and de la di del du des von van der zu at in".split())
TITLES = frozenset("dr prof professor mr mrs ms miss sir phd md jr sr ii iii".split())

YEAR = re.compile(r"[(\[]\s*(\d{4})[a-z]?\s*[)\]]")
CITED = re.compile(r"\s+(?:et\s+al\b|and\s+colleagues\b|&|and\b|und\b|et\b|y\b)|\s*[(\[]\s*\d{4}|,\s*\d{4}\b|\s+\d{4}\b")


def fold(s: str) -> str:
    """Lower case without accents or invisible characters."""
    s = unicodedata.normalize("NFKD", s)
    return "".join(c for c in s if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").casefold()


def near(a: str, b: str) -> bool:
    """Whether one edit (or swap of neighbours) at most lies between two words."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return False
    i = 0
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(n, m) - i and a[n - 1 - j] == b[m - 1 - j]:
        j += 1
    x, y = a[i : n - j], b[i : m - j]
    return len(x) <= 1 and len(y) <= 1 or len(x) == 2 and x == y[::-1]


def org_word(w: str) -> str | None:
    """The word of an organisation's name that `w` is, perhaps misspelt or short."""
    if w in ORG_SHORT:
        return ORG_SHORT[w]
    if w in ORG_WORDS:
        return w
    if len(w) >= 5:
        for x in ORG_WORDS:
            if near(w, x):
                return x
    return None


def parse(name: str, cited: bool) -> tuple[str, str, str, str, str, str | None] | None:
    """(form, family, given, initials, kind of organisation, year) of one string; None if it names nobody.

    `form` is org, family, init or full; for "two", family and given are the last and first word and may be
    the other way round.
    """
    year = None
    if cited:
        m = YEAR.search(name) or re.search(r"\b(\d{4})\b", name)
        year = m[1] if m else None
        name = CITED.split(name, maxsplit=1)[0]
    if not re.search(r"[^\W\d_]", name):
        return None
    mixed = name.upper() != name
    head, comma, tail = name.partition(",")
    words: list[tuple[str, bool, bool]] = []
    for part in (head, tail) if comma and not cited else (name.replace(",", " "),):
        for raw in re.findall(r"[^\s.,;]+\.?", part):
            bare = raw.rstrip(".")
            w = re.sub(r"[^\w'-]", "", fold(bare))
            if not w or w in TITLES and not (bare.isupper() and mixed and not raw.endswith(".")):
                continue
            caps = bare.isupper() and mixed
            initial = len(w) == 1 or (len(w) <= 3 and caps and len(bare) <= 3) or bool(re.fullmatch(r"(\w-)+\w", w))
            words.append((w, initial, caps and not initial))
        if part is head and comma and not cited:
            cut = len(words)
    if not words:
        return None
    kinds = [org_word(w) for w, _, _ in words]
    if any(kinds) and len(words) > 1:
        own = [w for (w, _, _), k in zip(words, kinds, strict=True) if not k and w not in SMALL]
        if own or sum(map(bool, kinds)) > 1:
            return ("org", " ".join(sorted(own)), "", "", " ".join(sorted(k for k in kinds if k)), year)
    if comma and not cited and 0 < cut < len(words):
        family = " ".join(w for w, _, _ in words[:cut])
        rest = words[cut:]
    else:
        full = [i for i, w in enumerate(words) if not w[1]]
        if not full:
            return None
        loud = [i for i in full if words[i][2]]
        if len(full) == 1:
            at = full[0]
        elif len(loud) == 1:
            at = loud[0]
        elif any(words[i][1] for i in range(full[0] + 1, full[-1])):
            at = full[-1]
        else:
            given = words[full[0]][0]
            rest = "".join(w[0] for w, i, _ in words if i)
            return ("two", words[full[-1]][0], given, rest, "", year)
        family = words[at][0]
        rest = words[:at] + words[at + 1 :]
    given = next((w for w, i, _ in rest if not i), "")
    initials = "".join(w.replace("-", "") for w, i, _ in rest if i)
    if given:
        return ("full", family, given, initials, "", year)
    return ("init" if initials else "family", family, "", initials, "", year)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = ("form", "family", "given", "initials", "kind", "year")
    for batch in batches:
        take, out = [], []
        pairs = zip(batch.column("name").to_pylist(), batch.column("cited").to_pylist(), strict=True)
        for i, (name, cited) in enumerate(pairs):
            p = parse(name, cited)
            if p:
                take.append(i)
                out.append(p)
        kept = batch.take(pa.array(take, pa.int32()))
        cols = [pa.array([p[k] for p in out], pa.string()) for k in range(len(fields))]
        yield pa.RecordBatch.from_arrays([*kept.columns, *cols], names=[*kept.schema.names, *fields])


def author_names(lists: DataFrame, column: str) -> DataFrame:
    """The names of author lists, cut at semicolons if there are any, else at commas and the last "and"."""
    c = F.col(column)
    by_comma = F.split(c, r"(?U),\s*(?:and|&)\s+|,|\s+(?:and|&)\s+")
    pieces = F.when(c.contains(";"), F.split(c, ";")).otherwise(by_comma)
    name = F.regexp_replace("piece", r"(?U)^\s+|\s+$", "").alias("name")
    return lists.where(c.isNotNull()).select(F.explode(pieces).alias("piece")).select(name).where("name <> '' and not name rlike '(?i)^et al[.]?$'")


def cited_names(claims: DataFrame, column: str) -> DataFrame:
    """The citations that name an author, whole and trimmed."""
    name = F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "").alias("name")
    return claims.where(F.col(column).isNotNull()).select(name).where(r"name rlike '\\p{L}'")


def edits(n: int) -> int:
    """How many edits lie between two spellings of a word at most, by the letters of the shorter one."""
    return 2 if n >= 12 else 1


def _segments(n: int, k: int) -> list[tuple[int, int]]:
    """Where the k + 1 segments of a word of n letters begin and end, as even as can be."""
    return [(i * n // (k + 1), (i + 1) * n // (k + 1)) for i in range(k + 1)]


def _index_keys(w: str) -> set[str]:
    """Each segment of a word, with the word's length and the segment's number; and the whole word."""
    n = len(w)
    return {f"{n} {i} {w[x:y]}" for k in {edits(n), edits(n - 1), edits(n - 2)} for i, (x, y) in enumerate(_segments(n, k), 3 * k)} | {f"{n} = {w}"}


def _probe_keys(w: str) -> set[str]:
    """The keys under which words within `edits` of a word are in the index.

    With d letters more in the other word, segment i of it can't have shifted by more than the edits before it, nor by
    more than those after it leave. A swap across the border of two segments spoils both; it is looked up as a whole.
    """
    n, out = len(w), set()
    for size in range(max(1, n - 2), n + 3):
        k = edits(min(n, size))
        if abs(n - size) > k:
            continue
        for i, (x, y) in enumerate(_segments(size, k)):
            d = n - size
            first, last = max(x - i, x + d - (k - i), 0), min(x + i, x + d + (k - i), n - (y - x))
            out |= {f"{size} {3 * k + i} {w[p : p + y - x]}" for p in range(first, last + 1)}
        if size == n:
            for x, _ in _segments(n, k)[1:]:
                if 0 < x < n and w[x - 1] != w[x]:
                    out.add(f"{n} = {w[: x - 1]}{w[x]}{w[x - 1]}{w[x + 1 :]}")
    return out


def _keyed(keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [sorted(keys(w)) for w in batch.column("word").to_pylist()]
            kept = batch.take(pa.array([i for i, x in enumerate(each) for _ in x], pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([k for x in each for k in x], pa.string())], names=[*kept.schema.names, "key"])

    return run


def _swapped(a: Column, b: Column) -> Column:
    """Whether swapping two neighbouring letters of `a` gives `b`."""
    return F.exists(
        F.sequence(F.lit(1), F.length(a) - 1),
        lambda i: F.concat(
            F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))
        )
        == b,
    )


def similar(words: DataFrame, most: int = 2) -> DataFrame:
    """(a, n_a, b, n_b, d): pairs of different words of `words` (word, n) within `edits`, or `most` if that is less, by the segment join.

    d is how many edits lie between them.
    """
    slim = words.select("word", "n")
    schema = "word string, n bigint, key string"
    index = slim.mapInArrow(_keyed(_index_keys), schema).select(F.col("word").alias("b"), F.col("n").alias("n_b"), "key")
    probe = slim.mapInArrow(_keyed(_probe_keys), schema).select(F.col("word").alias("a"), F.col("n").alias("n_a"), "key")
    a, b = F.col("a"), F.col("b")
    # candidates once each, before they are verified
    found = probe.join(index, "key").where(a != b).groupBy("a", "n_a", "b", "n_b").agg(F.lit(1).alias("_one")).drop("_one")
    k = F.when(F.least(F.length(a), F.length(b)) >= 12, most).otherwise(1)
    close = F.levenshtein(a, b, 2)
    swap = (F.length(a) == F.length(b)) & (close == 2) & _swapped(a, b)
    return found.where((close >= 1) & ((close <= k) | swap)).withColumn("d", F.when(swap, 1).otherwise(close))


def canonical(words: DataFrame, ratio: float = 1.0, least: int = 1, most: int = 2) -> DataFrame:
    """(word, canon) of the words of `words` (word, n) whose most frequent neighbour is more frequent.

    Words of fewer than `least` letters stay as they are, and those whose neighbour isn't `ratio` times as frequent.
    Of equally frequent words the first in order counts as the more frequent. If `words` has letters, the initials
    of those who bear a word, a word that three different initials go with stays as it is, and so does one that shares
    no initial with its neighbour, if both have any; words of four letters or fewer, or two edits away, must share one, and
    be much rarer. Nearer neighbours come before more frequent ones.
    Chains of neighbours are followed to their end.
    """
    near_by = similar(words.where(F.length("word") >= least), most).where(F.col("n_b") >= ratio * F.col("n_a"))
    better = near_by.where((F.col("n_b") > F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a"))))
    if "letters" in words.columns:
        of = words.select("word", "letters")
        better = better.join(of.withColumnsRenamed({"word": "a", "letters": "la"}), "a").join(of.withColumnsRenamed({"word": "b", "letters": "lb"}), "b")
        share = F.arrays_overlap("la", "lb")
        short = (F.least(F.length("a"), F.length("b")) <= 4) | (F.col("d") > 1)
        loose = share | (F.size("la") == 0) | (F.size("lb") == 0)
        better = better.where((F.size("la") < 3) & F.when(short, share & (F.col("n_b") >= 3 * F.col("n_a"))).otherwise(loose))
    top = better.groupBy("a").agg(F.max(F.struct(-F.col("d"), "n_b", "b")).alias("top"))
    links = checkpointed(top.select(F.col("a").alias("word"), F.col("top.b").alias("canon")))
    while True:  # each round halves what is left of a chain, and links lead to ever more frequent words
        on = links.select(F.col("word").alias("canon"), F.col("canon").alias("further"))
        further = links.join(on, "canon", "left")
        if further.where("further is not null").limit(1).count() == 0:
            return links
        links = checkpointed(further.select("word", F.coalesce("further", "canon").alias("canon")))


def _replaced(df: DataFrame, column: str, canon: DataFrame) -> DataFrame:
    c = canon.select(F.col("word").alias(column), F.col("canon").alias("_canon"))
    return df.join(c, column, "left").withColumn(column, F.coalesce("_canon", column)).drop("_canon")


def entities(names: DataFrame) -> DataFrame:
    """(name, entity): the distinct strings of `names` (name, cited) and a key of whom each means."""
    counted = names.groupBy("name", "cited").agg(F.count("*").alias("n"))
    schema = "name string, cited boolean, n bigint, form string, family string, given string, initials string, kind string, year string"
    s = checkpointed(counted.mapInArrow(_parsed, schema))

    # which of two words is the family name: how often each word is seen as one or the other
    sure = s.where("form in ('full', 'init', 'family')")
    two = s.where("form = 'two'")
    roles = (
        sure.select(F.col("family").alias("word"), F.col("n").cast("double").alias("fam"), F.lit(0.0).alias("giv"))
        .union(sure.where("given <> ''").select("given", F.lit(0.0), F.col("n").cast("double")))
        .union(two.select("family", F.col("n") * 0.5, F.lit(0.0)))
        .union(two.select("given", F.lit(0.0), F.col("n") * 0.5))
        .groupBy("word")
        .agg(F.log((F.sum("fam") + 1) / (F.sum("giv") + 1)).alias("lean"))
    )
    two = two.join(roles.select(F.col("word").alias("family"), F.col("lean").alias("l")), "family").join(
        roles.select(F.col("word").alias("given"), F.col("lean").alias("g")), "given"
    )
    turned = F.col("g") > F.col("l")
    two = two.withColumns({"form": F.lit("full"), "family": F.when(turned, F.col("given")).otherwise(F.col("family")), "given": F.when(turned, F.col("family")).otherwise(F.col("given"))})
    s = s.where("form <> 'two'").unionByName(two.drop("l", "g"))

    # misspelt family names and telling words of organisations
    letter = F.left(F.concat("given", "initials"), F.lit(1))
    words = s.where("family <> ''").groupBy(F.col("family").alias("word")).agg(F.sum("n").alias("n"), F.collect_set(F.nullif(letter, F.lit(""))).alias("letters"))
    s = _replaced(s, "family", canonical(words))

    # misspelt given names: against the given names of all, then within a family
    given = s.where("given <> ''").groupBy(F.col("given").alias("word")).agg(F.sum("n").alias("n"))
    s = _replaced(s, "given", canonical(given, ratio=20.0, least=5))
    nick = F.create_map(*[F.lit(x) for k, v in NICK.items() for x in (k, " ".join(v))])
    s = s.withColumn("formal", F.when(F.col("given") != "", nick[F.col("given")]))
    s = checkpointed(s)
    whole = F.concat_ws(" ", "family", "given")
    full = s.where("form = 'full' and formal is null").select("name", "cited", "family", "given", whole.alias("whole"), "n")
    people = full.groupBy(F.col("whole").alias("word")).agg(F.sum("n").alias("n"))
    # a given name about as frequent as the neighbour's is another name
    first = lambda c: F.substring_index(c, " ", -1)
    often = checkpointed(full.groupBy("given").agg(F.sum("n").alias("often")))
    fixed = canonical(people, most=1).withColumns({"ga": first(F.col("word")), "gb": first(F.col("canon"))})
    fixed = fixed.join(often.withColumnsRenamed({"given": "ga", "often": "oa"}), "ga", "left").join(often.withColumnsRenamed({"given": "gb", "often": "ob"}), "gb", "left")
    fixed = fixed.where((F.col("ga") == F.col("gb")) | (F.coalesce("oa", F.lit(0)) * 20 <= F.coalesce("ob", F.lit(0))) | (F.coalesce("oa", F.lit(0)) <= 2))
    full = _replaced(full, "whole", fixed.select("word", "canon"))
    persons = checkpointed(
        full.groupBy("whole").agg(F.sum("n").alias("n")).select("whole", "n", F.expr("substring_index(whole, ' ', -1)").alias("given"), F.expr("left(whole, length(whole) - length(substring_index(whole, ' ', -1)) - 1)").alias("family"))
    )
    done_full = full.select("name", "cited", F.concat(F.lit("p "), "whole").alias("entity"))

    # nicknames: the person of the family with one of the full names
    nicked = s.where("formal is not null").select("name", "cited", "family", "given", F.split("formal", " ").alias("formals"))
    asked = nicked.select("name", "cited", "family", F.explode("formals").alias("full_given"))
    found = asked.join(persons.select("family", F.col("given").alias("full_given"), "whole", "n"), ["family", "full_given"])
    found = found.groupBy("name", "cited").agg(F.max(F.struct("n", "whole")).alias("top"))
    # a nickname nobody else's full name fits may be somebody's name as it stands
    done_nick = nicked.join(found, ["name", "cited"], "left").select(
        "name", "cited", F.concat(F.lit("p "), F.coalesce("top.whole", F.concat_ws(" ", "family", F.element_at("formals", 1)))).alias("entity"), "family", F.coalesce(F.expr("substring_index(top.whole, ' ', -1)"), F.element_at("formals", 1)).alias("given")
    )
    everybody = persons.select("family", "given").union(done_nick.select("family", "given")).distinct()

    # initials: the only person of the family with that first letter
    letters = everybody.groupBy("family", F.left("given", F.lit(1)).alias("letter")).agg(F.count("*").alias("k"), F.min("given").alias("only"))
    inits = s.where("form = 'init'").select("name", "cited", "family", F.left("initials", F.lit(1)).alias("letter"))
    inits = inits.join(letters, ["family", "letter"], "left")
    alone = F.concat(F.lit("i "), F.concat_ws(" ", "family", "letter"))
    done_init = inits.select(
        "name", "cited", F.when(F.col("k") == 1, F.concat(F.lit("p "), F.concat_ws(" ", "family", "only"))).otherwise(alone).alias("entity"), "family", F.when(F.col("k").isNull(), F.col("letter")).alias("letter")
    )

    # organisations
    orgs = s.where("form = 'org'").select("name", "cited", "family", F.concat(F.lit("o "), F.concat_ws(" ", "kind", F.lit("/"), "family")).alias("entity"))

    # bare family names: the only bearer, or the one of that year
    bearers = (
        everybody.select("family", F.concat(F.lit("p "), F.concat_ws(" ", "family", "given")).alias("entity"))
        .union(done_init.where("letter is not null").select("family", "entity"))
        .union(orgs.select("family", "entity"))
        .distinct()
    )
    bearers = bearers.groupBy("family").agg(F.count("*").alias("k"), F.min("entity").alias("only"))
    bare = s.where("form = 'family'").select("name", "cited", "family", "year")
    known = done_full.union(done_nick.select("name", "cited", "entity")).union(done_init.select("name", "cited", "entity")).union(orgs.select("name", "cited", "entity"))
    dated = s.where("year is not null and form <> 'family'").select("name", "cited", "family", "year").join(known, ["name", "cited"])
    dated = dated.groupBy("family", "year").agg(F.countDistinct("entity").alias("ky"), F.min("entity").alias("in_year"))
    bare = bare.join(bearers, "family", "left").join(dated, ["family", "year"], "left")
    done_bare = bare.select(
        "name", "cited",
        F.when(F.col("k") == 1, F.col("only")).when(F.col("ky") == 1, F.col("in_year")).otherwise(F.concat(F.lit("f "), F.concat_ws(" ", "family", F.when(F.col("k") > 1, F.coalesce("year", F.lit(""))))) ).alias("entity"),
    )
    return known.union(done_bare).select("name", "entity").distinct()


def variants(names: DataFrame) -> DataFrame:
    """(name_a, name_b): all pairs of different strings of one entity, name_a before name_b in code points."""
    e = checkpointed(entities(names))
    a, b = e.select(F.col("name").alias("name_a"), "entity"), e.select(F.col("name").alias("name_b"), "entity")
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()


