"""Text functions as columns. All of them give null for null, and stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that travel as tokens, and their tokens.
SPECIAL = (("\n", "{{NL}}"), ("\t", "{{TAB}}"), ("\r", "{{RE}}"))
PLACEHOLDER = r"\{\{PT_[A-Za-z]+_\d+\}\}"
ANY_TOKEN = r"\{\{[^{}]+?\}\}"
CJK = r"[㐀-鿿]"


def strip(c: Column) -> Column:
    """White space of any script taken from both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space made one space, none at the ends."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def protect(c: Column) -> Column:
    """Line breaks, tabs and returns written as tokens."""
    for raw, token in SPECIAL:
        c = F.replace(c, F.lit(raw), F.lit(token))
    return c


def restore(c: Column) -> Column:
    """Tokens of line breaks, tabs and returns written as these."""
    for raw, token in SPECIAL:
        c = F.replace(c, F.lit(token), F.lit(raw))
    return c


def protected(c: Column) -> Column:
    """The map of those tokens that a protected text needs, to what they stand for."""
    table = F.create_map(*[F.lit(x) for raw, token in SPECIAL for x in (token, raw)])
    return F.map_filter(table, lambda _, raw: F.contains(c, raw))


def without_tokens(c: Column) -> Column:
    """The text without placeholder tokens, its white space collapsed."""
    return collapse(F.regexp_replace(c, ANY_TOKEN, ""))


def without_placeholders(c: Column, placeholders: Column) -> Column:
    """The text without the tokens that are keys of a map; other tokens stay."""
    keys = F.coalesce(F.map_keys(placeholders), F.array().cast("array<string>"))
    return collapse(F.aggregate(keys, c, lambda text, key: F.replace(text, key, F.lit(""))))


def placeholders(c: Column) -> Column:
    """The placeholder tokens in order, repeated ones repeated."""
    return F.regexp_extract_all(c, F.lit(PLACEHOLDER), F.lit(0))


def is_prose(c: Column) -> Column:
    """Whether a text is worth translating: it has Han letters, or a word of three letters and more letters than digits."""
    letters = F.length(F.regexp_replace(c, r"(?U)\P{Alpha}", ""))
    digits = F.length(F.regexp_replace(c, r"(?U)\D", ""))
    return c.rlike(CJK) | (c.rlike(r"(?U)[^\W\d_]{3,}") & (letters > digits))


def han_letters(c: Column) -> Column:
    """How many Han letters a text has."""
    return F.length(F.regexp_replace(c, r"[^㐀-鿿]", ""))


def token_estimate(c: Column) -> Column:
    """A rough number of model tokens, half the letters and at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) * 0.5).cast("int"))


def chunks(c: Column, size: int) -> Column:
    """The text cut into pieces of `size` letters; an empty text has none."""
    pieces = F.ceil(F.length(c) / size).cast("int")
    return F.when(pieces < 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))
    )


def content_tokens(c: Column, stop_words: list[str]) -> Column:
    """The distinct words of a phrase in lower case, hyphens taken as spaces, without `stop_words`."""
    words = F.split(strip(F.lower(F.replace(c, F.lit("-"), F.lit(" ")))), r"(?U)\s+")
    return F.array_remove(F.array_except(F.array_distinct(words), F.array(*map(F.lit, stop_words))), "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements of two arrays as a share of all of theirs; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def bucket_of(reason: Column) -> Column:
    """The coarse part of a reason such as "fps<0.95 (0.80)" or "fact_drift:missing"."""
    return F.substring_index(F.substring_index(F.substring_index(reason, ":", 1), "<", 1), " ", 1)


def fenced(c: Column) -> Column:
    """A model's answer without the fence of three backticks around it."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")


def latex_tokens(c: Column) -> Column:
    """Citations, references, labels and formulas of LaTeX text, in this order of kinds."""
    kinds = (r"\\cite[a-z]*\*?(?:\[[^\]]*\])*\{[^}]*\}", r"\\(?:eq|c|auto|page)?ref\{[^}]*\}", r"\\label\{[^}]*\}", r"(?<!\\)\$[^$]+\$")
    return F.concat(*[F.regexp_extract_all(c, F.lit(k), F.lit(0)) for k in kinds])


#: Names of languages by their code.
LANGUAGE_NAMES = {"zh": "Chinese", "en": "English", "fr": "French", "es": "Spanish", "ja": "Japanese", "de": "German"}


def language_name(code: Column) -> Column:
    """A language's name; a code without one stands for itself."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])[code], code)


def base_name(model: Column) -> Column:
    """A model's name without the date at its end."""
    return F.regexp_replace(model, r"-[0-9]{4}-[0-9]{2}-[0-9]{2}$", "")


def plain_id(c: Column) -> Column:
    """An identifier without the archive's name before it or a version after it."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"(?i)^arxiv[-:]", ""), r"v[0-9]+$", "")


def place_of(c: Column, surface: Column) -> Column:
    """Where a string first stands in a text, from 0; null where it doesn't."""
    return F.nullif(F.instr(c, surface), F.lit(0)) - 1


def json_object(answer: Column) -> Column:
    """The object in a model's answer: from the first brace to the last; null without any."""
    return F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))


def json_field(answer: Column, name: str) -> Column:
    """A field of the object in a model's answer; null if it can't be read."""
    return F.get_json_object(json_object(answer), f"$.{name}")


def id_pairs(answer: Column) -> Column:
    """array<struct(id, text)> of an answer [[id, text], ...]; ids may be strings of digits, others are left out, so are short entries."""
    rows = F.coalesce(F.from_json(fenced(answer), "array<array<string>>"), F.array().cast("array<array<string>>"))
    pairs = F.transform(F.filter(rows, lambda x: F.size(x) >= 2), lambda x: F.struct(x[0].try_cast("bigint").alias("id"), x[1].alias("text")))
    return F.filter(pairs, lambda x: x["id"].isNotNull())


def paragraphs(tex: Column) -> Column:
    """The paragraphs of a LaTeX text between its beginning and its bibliography, trimmed, without blank ones."""
    body = F.regexp_replace(tex, r"(?s)^.*\\begin\{document\}", "")
    body = F.regexp_replace(body, r"(?s)\\(?:bibliography\{|begin\{thebibliography\}|end\{document\}).*$", "")
    return F.filter(F.transform(F.split(body, r"\n\s*\n"), strip), lambda p: p != "")


def has_structure(paragraph: Column) -> Column:
    """Whether a paragraph of LaTeX has a token of structure and begins with text."""
    return (F.size(latex_tokens(paragraph)) > 0) & ~F.startswith(paragraph, F.lit("\\"))


def prompt(language: str, before: Column, after: Column, row_id: Column, source: Column, most: int = 400) -> Column:
    """What a model is asked: the part that stays the same first, so that it can be cached, then the neighbours cut short, then the input."""
    stable = F.lit(f"Translate into {LANGUAGE_NAMES.get(language, language)}. Keep every {{{{...}}}} token.")
    near = lambda c: F.coalesce(F.substring(c, 1, most), F.lit(""))
    text = F.regexp_extract(F.to_json(F.struct(source.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.concat(stable, F.lit("\nBefore: "), near(before), F.lit("\nAfter: "), near(after), F.lit("\nInput: [["), row_id.cast("string"), F.lit(","), text, F.lit("]]"))
