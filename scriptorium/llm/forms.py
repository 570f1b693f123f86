"""One consistent form for texts that look the same, and the pairs of rows that agree only in it.

The form: compatibility mappings of width, no-break and ligature characters, composed accents, look-alike
letters of other scripts made Latin (with accents too, composed or not), white space mapped to the space,
default-ignorable characters removed, and (if asked for) full compatibility mapping and full case folding, after which
letters are composed again. Otherwise raised figures stay; line breaks, runs of spaces and accents always do. Each
distinct value of a batch is formed once.

Defined results: a null text has a null form and no pair; blank texts have no pair; rows repeated in the input
count once; equal code points make no pair.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.session import checkpointed

#: Ranges of default-ignorable code points (Unicode, DerivedCoreProperties).
IGNORABLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
#: Cyrillic, Greek and other letters and the Latin letters they look like, one for one.
LOOK_ALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХԌԚԜаеѕіјорсухԁһԛԝӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳϹıɑɡ",
        "ABESIJKMHOPCTYXGQWaesijopcyxdhqwlABEZHIKMNOPTYXovcjCiag",
        strict=True,
    )
)


def _table() -> dict[int, str]:
    out: dict[int, str] = {}
    for o in range(0x80, sys.maxunicode + 1):
        c = chr(o)
        kind = unicodedata.decomposition(c).partition(" ")[0]
        if kind in ("<wide>", "<narrow>", "<noBreak>") or 0xFB00 <= o <= 0xFB06 or 0xFB13 <= o <= 0xFB17:
            out[o] = unicodedata.normalize("NFKC", c)
        if unicodedata.category(c) == "Zs":
            out[o] = " "
    out.update({ord(k): v for k, v in LOOK_ALIKE.items()})
    # look-alikes with accents, composed: the letter is mapped as if it were decomposed
    for o in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", chr(o))
        if marks and base in LOOK_ALIKE:
            out[o] = LOOK_ALIKE[base] + "".join(marks)
    for first, last in IGNORABLE:
        out.update(dict.fromkeys(range(first, last + 1), ""))
    out[0x2011] = "-"  # no-break hyphen
    return out


TABLE = _table()


def _class(points: list[int]) -> str:
    """A character class of code points, as ranges."""
    out, first = [], None
    for i, o in enumerate(points):
        first = o if first is None else first
        if i + 1 == len(points) or points[i + 1] != o + 1:
            out.append(f"\\U{first:08x}-\\U{o:08x}")
            first = None
    return "[" + "".join(out) + "]"


MAPPED = re.compile(_class(sorted(TABLE)))


def mapped(text: str) -> str:
    """The text with all that TABLE maps; looking for these first is much quicker than mapping every letter."""
    return MAPPED.sub(lambda m: TABLE[ord(m[0])], text)


def form(text: str | None, fold_case: bool = False, compatible: bool = False) -> str | None:
    """The consistent form of one text; with `compatible`, raised figures, circled letters, units and the like are made plain too."""
    if text is None:
        return None
    if not text.isascii():
        if compatible:
            text = unicodedata.normalize("NFKC", text)
        text = unicodedata.normalize("NFC", mapped(text))
    if not fold_case:
        return text
    # folding may decompose, and give letters that look like others
    text = text.casefold()
    return text if text.isascii() else unicodedata.normalize("NFC", mapped(text))


def _former(fold_case: bool, compatible: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(batch.num_columns - 1).dictionary_encode()
            formed = pa.array([form(t, fold_case, compatible) for t in coded.dictionary.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], formed.take(coded.indices)], names=[*batch.schema.names[:-1], "form"]
            )

    return run


def forms(df: DataFrame, keys: list[str], text: str, fold_case: bool = False, compatible: bool = False) -> DataFrame:
    """The keys and the consistent form of each row's text."""
    slim = df.select(*keys, F.col(text).alias("form"))
    return slim.mapInArrow(_former(fold_case, compatible), slim.schema)


def _digests(fold_case: bool):
    def digest(t: str) -> bytes:
        return hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            raw, key = [], []
            for t in coded.dictionary.to_pylist():
                f = form(t, fold_case)
                blank = not f or not f.strip()
                raw.append(None if blank else digest(t))
                key.append(raw[-1] if blank or f == t else digest(f))
            raw, key = (pa.array(x, pa.binary()).take(coded.indices) for x in (raw, key))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), key, raw], names=["side", "id", "key", "raw"])

    return run


def alike(df: DataFrame, side: Column, row_id: Column, text: Column, fold_case: bool = False, rows_a_salt: int = 20_000) -> DataFrame:
    """(side, id_a, id_b) of the rows of one side whose texts differ but have the same form.

    Only digests are shuffled. Spellings are paired first, then their rows are joined to them, the rarer
    spelling before the more frequent one; the rows of a frequent spelling on either side are spread over salts by their
    count, so that a heading that every paper has doesn't fall to one task.
    """
    slim = df.where(text.isNotNull()).select(side.alias("side"), row_id.cast("bigint").alias("id"), text.alias("text"))
    rows = slim.mapInArrow(_digests(fold_case), "side string, id bigint, key binary, raw binary").where("raw is not null")
    rows = checkpointed(rows.distinct())  # it is read three times
    spellings = rows.groupBy("side", "key", "raw").agg(F.count("*").alias("n"))
    several = spellings.groupBy("side", "key").agg(F.count("*").alias("spellings")).where("spellings > 1").select("side", "key")
    spellings = checkpointed(spellings.join(several, ["side", "key"]))  # those with a partner only, a small part of all
    a = spellings.select("side", "key", F.col("raw").alias("raw_a"), F.col("n").alias("n_a"))
    b = spellings.select("side", "key", F.col("raw").alias("raw_b"), F.col("n").alias("n_b"))
    # each pair of spellings once, the rarer one first
    rarer = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("raw_a") < F.col("raw_b")))
    two = a.join(b, ["side", "key"]).where(rarer & (F.col("raw_a") != F.col("raw_b")))
    parts = lambda n: F.ceil(F.col(n) / rows_a_salt).cast("int")
    salts = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    two = two.select("side", "raw_a", "raw_b", "n_b", salts("n_a").alias("salt_a"))
    held = rows.join(spellings.select("side", "raw", "n"), ["side", "raw"]).select("side", "raw", "id", F.pmod(F.xxhash64("id"), parts("n")).cast("int").alias("salt"))
    few = held.select("side", F.col("raw").alias("raw_a"), F.col("salt").alias("salt_a"), F.col("id").alias("id_few"))
    many = held.select("side", F.col("raw").alias("raw_b"), F.col("salt").alias("salt_b"), F.col("id").alias("id_many"))
    left = two.join(few, ["side", "raw_a", "salt_a"]).select("side", "raw_b", "id_few", salts("n_b").alias("salt_b"))
    return left.join(many, ["side", "raw_b", "salt_b"]).select(
        "side", F.least("id_few", "id_many").alias("id_a"), F.greatest("id_few", "id_many").alias("id_b")
    ).where("id_a < id_b").distinct()
