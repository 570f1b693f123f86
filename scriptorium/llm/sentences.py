"""Sentence boundaries by semi-Markov dynamic programming over whole spans.

A text is first reduced to the places where a sentence could end (final marks with their closing quotes and
brackets, line breaks, and in Thai every space). The dynamic program then chooses the spans. A span's score
joins four parts: its length, the words it opens with, the words it closes with, and whether its quotation
marks and brackets balance. Offsets are code points of the raw text.

Defined results: null, empty and blank texts have no span; a text without any final mark is one span; the
spans of a text cover all of it but white space, and never overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations that a full stop follows without ending a sentence.
NEVER_LAST = frozenset(
    "e.g i.e vs cf sec sect fig figs eq eqs tab tabl tbl col no nos dr prof pr st app approx al p pp vol ch "
    "ex ej aprox env ap ann ec éq n c.-à-d m mr mrs ms mme mlle sr sra ed eds resp incl ca viz ee ref refs "
    "thm lem def prop rem dept univ inc ltd jr a p.ej p.ex núm pág".split()
)
# Abbreviations that may also close a sentence, so that what follows decides.
MAYBE_LAST = frozenset("etc u.s u.k e.u uu é.-u a.m p.m a. p. h co corp".split())
# Openings of a sentence that don't begin with a capital letter.
LOW_OPENING = re.compile(r"[a-z]-[a-z]+s?\b|[σταβηλκμ]\b")

CLOSERS = "\"'”’»)\\]」』】）］〉》"
SOFT = {c: " " for c in "    　"}
WIDE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF10, 0xFF5B) if chr(c - 0xFEE0).isalnum()} | {"．": "."}
# Cyrillic and Greek letters that look like Latin ones, one for one.
ALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТХУаеѕіјорсухԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧον",
        "ABESIJKMHOPCTXYaesijopcyxdhqwABEZHIKMNOPTYXov",
    )
)
ONE_FOR_ONE = {**SOFT, **WIDE, **ALIKE}
MAPPED = re.compile("[" + "".join(ONE_FOR_ONE) + "]")


def plain(text: str) -> str:
    """The text with spaces, width forms and look-alikes made plain, each code point in its place."""
    return text if text.isascii() else MAPPED.sub(lambda m: ONE_FOR_ONE[m[0]], text)


#: A final mark, the closing marks after it (French ones stand after a space), and where the text goes on.
MARK = re.compile(
    # a full stop before a figure or a small letter ends nothing, save before openings like "p-values"
    r"(?P<mark>(?:\.(?!\d|[a-z](?!-))|[!?…])+|[。！？．｡]+)(?P<close>(?: ?»|[" + CLOSERS + r"])*)(?P<gap>\s*)|(?P<line>\s*\n\s*)"
)
#: The same for texts of one line: as it begins with a set of letters, all others are passed over at once.
_MORE = r"(?:\.(?!\d|[a-z](?!-))|[!?…])*"
MARK_IN_LINE = re.compile(
    r"(?P<mark>[.!?…。！？．｡](?:(?<=[。！？．｡])[。！？．｡]*|(?<=[!?…])" + _MORE + r"|(?<=\.)(?!\d|[a-z](?!-))" + _MORE + r"))"
    r"(?P<close>(?: ?»|[" + CLOSERS + r"])*)(?P<gap>\s*)(?P<line>\n)?"
)
QUOTE = re.compile(r"[\"“”«»「」『』()\[\]（）［］【】]")
OPENING, CLOSING = set("“«「『([（［【"), set("”»」』)]）］】")
LAST_WORD = re.compile(r"\n?([^\s()（\[\]«»“”\"/'’!?⺀-鿿＀-￯]*)")  # of a text read backwards


UNSEEN = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")


def last_word(text: str, end: int) -> str:
    """The Latin word that ends at `end`, in lower case; longer words than 24 letters don't matter here."""
    near = text[max(0, end - 24) : end]
    if not near.isascii():
        near = UNSEEN.sub("", near)
    word = LAST_WORD.match(near[::-1])[1][::-1].lower().lstrip(".")
    if "." not in word:
        return word
    head, _, tail = word.rpartition(".")
    return tail if len(head) > 3 and tail.isalpha() else word  # "twice.No": the space is missing


THAI = re.compile(r"[ก-๛]")

# How Thai sentences open, go on and break, as the script has no final mark.
THAI_LINKS = (
    "อย่างไรก็ตาม ในทางปฏิบัติ น่าแปลกที่ ด้วยเหตุนี้ นอกจากนี้ ในทางกลับกัน ในระดับที่ใหญ่ขึ้น "
    "จากประสบการณ์ของเรา แสดง เช่น และ แต่ ว่า ตาม ค่า ดัง จาก ใน บน ของ ด้วย ศ. ดร. รูปที่ ตารางที่ คอลัมน์ ข้อ รุ่น ละเลย "
    "ขออภัย ซึ่ง & and ผู้อ่าน กว่า ราว ทั้ง ตั้ง ต่ำกว่า เหลือ เหลือเพียง ฝึก"
).split()
THAI_GOES_ON = re.compile(
    "[^\\s]+\\s+ฯลฯ|ศ\\.|ดร\\.|แสดง|ด้วย(?!เหตุนี้)|และ|แต่|แล้ว|เช่น|ซึ่ง|ขณะที่|โดย|เนื่องจาก|เพราะ|คอลัมน์|ฯลฯ|น\\.|ชม\\.|คะแนนลด|เทียบกับ|จุดบน|เหลือ|บน|ด้วยตัว|ของ|"
    "สองครั้ง|พบได้|เพิ่ม(?!เติม)|เผยแพร่|เป็น|แสดงให้เห็น|ถูก|ได้|ดีกว่า|ต้องใช้|ล้มเหลว|มี|ละเลย|บ่งชี้|อยู่|รายการจาก|รายการ(?=\\s)|แห่ง|ขั้น|ส่วน"
    "|ข้อมูลเข้า|จุด|เท่า|ในทุกการ|ว่า|ที่|ต่อ|กับ|ใน(?!ทางปฏิบัติ|ทางกลับ|ระดับ)|จาก(?!ประสบการณ์)|เมื่อเทียบ|ต่างประเทศ|คือ|ลดลง|ทำให้|แคบลง|จำกัด|ลู่เข้า|ขึ้นอยู่|ขั้นเมื่อ|รุ่น|ผู้อ่าน|สำหรับ|เมื่อกำหนด"
)
THAI_LINK_AHEAD = re.compile(
    "อย่างไรก็ตาม|ในทางปฏิบัติ|น่าแปลกที่|ด้วยเหตุนี้|นอกจากนี้|ในทางกลับกัน|ในระดับที่ใหญ่|จากประสบการณ์ของเรา|น่าเสียดาย|เหตุใด"
)
THAI_SUBJECT = re.compile(
    r"[A-Z][\w\-​-‍⁠﻿­]*(?: (?:et al\.?|&|and|v?[\d.]+)[^฀-๿]*)?\s*(?:ถูก|ได้ความ|ได้|ดีกว่า|ต้องใช้|ล้มเหลว|มี|รุ่น|แสดงให้เห็น)"
    r"|[A-Z][^฀-๿]{0,60}\(\d{4}\) ?แสดง|[A-Z][^฀-๿]{0,60}\[\d{4}\] ?แสดง"
)

LONG, SHORT = 1200, 3


def _length(n: int) -> float:
    """Score of a span of n code points: very short and very long spans are unlikely."""
    return -3.0 if n < SHORT else -0.002 * (n - LONG) if n > LONG else 0.0


def _depths(text: str) -> tuple[list[int], list[int]]:
    """Where quotation marks and brackets stand and the depth after each; straight quotes open and close in turn."""
    at, depth, now, straight = [], [], 0, False
    for m in QUOTE.finditer(text):
        c = m[0]
        if c == '"':
            now += -1 if straight else 1
            straight = not straight
        elif c in OPENING:
            now += 1
        elif now:
            now -= 1
        at.append(m.start())
        depth.append(now)
    return at, depth


def _score(text: str, m: re.Match, n: int) -> float | None:
    """How well a sentence closes before and another opens after the mark; None where it can't."""
    end = m.end()
    mark, close, gap, line = m.groups()
    if line is not None:
        before = text[m.start() - 1] if m.start() else ""
        return 4.0 if before in ".!?…。！？:：；;" + CLOSERS.replace("\\", "") else 2.0
    nxt = text[end] if end < n else ""
    if not nxt:
        return None
    if nxt > "\x7f" and UNSEEN.match(nxt):  # look behind characters that show nothing
        seen = UNSEEN.sub("", text[end : end + 12]).lstrip() or " "
        gap, nxt = gap or " " * (text[end : end + 12].lstrip("\u200b\u200c\u200d\u2060\ufeff\u00ad")[:1].isspace()), seen[0]
    if '"' in close and not gap and text.count('"', 0, m.end("mark") + close.index('"')) % 2 == 0:
        # a straight quote that opens the next sentence, with the space before it missing
        nxt, close = '"', close[: close.index('"')]
    first = mark[0]
    if first in "。！？｡":
        if close:
            return -6.0 if nxt in "，、；：,;と" or text.startswith("という", end) or text.startswith("との", end) else 5.0
        return 5.0 if nxt not in "，、；：,;)）」』”" else -6.0
    if "\n" in gap:
        return 5.0
    opens = nxt.isupper() or nxt in "\"“«¿¡([「『（【［" or nxt > "⹿"
    if mark in ("...", "…", "……") or first == "…":
        return 2.0 if opens and gap and nxt <= "⹿" else -6.0
    flat = nxt.islower() and text == text.lower()  # typed without capitals: any letter may open
    opens = opens or flat
    if first in "!?":
        if not gap and not close and nxt.isalnum() and nxt <= "⹿" and not nxt.isupper():
            return -6.0
        return 4.0 if opens or nxt.isdigit() or LOW_OPENING.match(text, end) else -4.0
    word = last_word(text, m.start())
    if word and word[0] in "¿¡'-":
        word = word.lstrip("¿¡'-")
    if not close:
        if word in NEVER_LAST or len(word) == 1 and word.isalpha() and text[m.start() - 1].isupper():
            return None
        if not gap:
            # "inputs.The": a missing space, but neither "U.S" nor "Sec.19" nor a decimal
            if word in MAYBE_LAST or len(word) > 2 or word[-1:].isdigit() or word[-1:] in "%)]":
                if nxt.isupper() and not (len(word) < 3 and word.isalpha()) and text[end : end + 2] not in ("S.", "U."):
                    return 3.0
                if nxt in "\"“«¿¡(" or nxt > "⹿" and word not in MAYBE_LAST:
                    return 3.0
                if nxt.islower() and LOW_OPENING.match(text, end):
                    return 3.0
            return None
    if word in MAYBE_LAST:
        if flat or text[m.start() - 1].isupper() and text == text.upper():
            # without case only the next word tells; these go on after "U.S." and "a.m."
            if word != "etc" and re.match(r"(?i)(and|on|y|del|et|or|in)\b", text[end : end + 4]):
                return -5.0
        return 3.0 if opens or LOW_OPENING.match(text, end) else -5.0
    if flat and close and re.match(r"(?:and|y|et)\b", text[end : end + 4]):
        return -5.0
    if opens or LOW_OPENING.match(text, end):
        return 4.0
    if nxt.isdigit():
        return 1.0 if gap else None
    return -4.0 if close or nxt.islower() or nxt in ",;:)]" else 0.5


def _thai_score(text: str, start: int, at: int, end: int) -> float:
    """The same for a space of a Thai text; `start` is where the last likely sentence began."""
    left = text[start:at]
    right = text[end : end + 90]
    if "\n" in text[at:end]:
        return 5.0
    for link in THAI_LINKS:
        if left.endswith(link):
            return -6.0
    c, d = left[-1:], right[:1]
    if c in ":,;：":
        return -6.0
    if THAI_LINK_AHEAD.match(right):
        return 5.0
    if d == '"':
        return 3.0 if right.startswith('"วัด') else -4.0
    if d == "(":
        return 3.0 if right.startswith("(บทพิสูจน์") else -4.0
    if d in "[［":
        return 4.0
    if "A" <= d <= "Z":
        if not THAI.search(left):
            return -6.0  # the name goes on
        if c == "." and left[-3:-2] in ("", " ", "\n") and left[-2:-1].isupper():
            return -6.0  # an initial
        return 3.0 if THAI_SUBJECT.match(right) and not left.endswith(("เช่น", "ของ", "และ")) else -4.0
    if not "฀" < d < "๿":
        return -6.0
    if left.startswith("ตาม") and right.startswith("เรารายงาน"):
        return -6.0
    if THAI_GOES_ON.match(right):
        return -6.0
    return 3.0 if "฀" < c < "๿" or c in ')"]' else 2.5


def _candidates(text: str) -> list[tuple[int, int, float]]:
    """(end of a sentence, start of the next, score) of every place worth a decision."""
    n, out = len(text), []
    if THAI.search(text):
        start = len(text) - len(text.lstrip())
        for m in re.finditer(r"\s+", text):
            if m.start() > start and m.end() < n:
                s = _thai_score(text, start, m.start(), m.end())
                if s > -5:
                    out.append((m.start(), m.end(), s))
                if s > 0:
                    start = m.end()
        return out
    for m in (MARK if "\n" in text else MARK_IN_LINE).finditer(text):
        s = _score(text, m, n)
        if s is not None and s > -5:
            _, close, gap, line = m.groups()
            end, following = (m.start(), m.end()) if line is not None else (m.end("close"), m.end())
            q = close.find('"') if line is None and close and not gap else -1
            if q >= 0 and text.count('"', 0, m.end("mark") + q) % 2 == 0:
                end = following = m.end("mark") + q
            out.append((end, following, s))
    return out


def spans(raw: str | None) -> list[tuple[int, int]]:
    """The sentences of one text as (start, end), by the best choice of whole spans."""
    if raw is None:
        return []
    text = plain(raw)
    n = len(text.rstrip())
    first = len(text) - len(text.lstrip())
    if first >= n:
        return []
    places = [p for p in _candidates(text) if first < p[0] < n and p[1] < n]
    if not places:
        return [(first, n)]
    at, depth = _depths(text)
    starts = [first, *(p[1] for p in places)]
    ends = [*(p[0] for p in places), n]
    # depth of quotation before each end, by one walk
    inside, k, now = [], 0, 0
    for e in ends:
        while k < len(at) and at[k] < e:
            now = depth[k]
            k += 1
        inside.append(now)
    if n - first < LONG and not any(inside) and all(p[2] >= 2.0 for p in places):
        # nothing is quoted across an end and every place is one: the dynamic program would take them all
        if all(e - b >= SHORT for b, e in zip(starts, ends, strict=True)):
            return list(zip(starts, ends, strict=True))
    gain = [*(p[2] for p in places), 0.0]
    best, back, highest = [0.0], [0], [0.0]
    for j, e in enumerate(ends):
        top, who, own, now = -1e9, 0, gain[j], inside[j]
        for i in range(j, -1, -1):
            before = inside[i - 1] if i else 0
            size = e - starts[i]
            s = best[i] + own
            if size > LONG or size < SHORT:
                s += _length(size)
            if now != before:
                s -= 7.0
            if before:
                s -= 7.0
            if s > top:
                top, who = s, i
            # longer spans only lose by their length, so none of those that begin before can win any more
            if size > LONG and i and highest[i - 1] + own + _length(e - starts[i - 1]) <= top:
                break
        best.append(top)
        highest.append(max(highest[-1], top))
        back.append(who)
    out, j = [], len(ends)
    while j:
        i = back[j]
        out.append((starts[i], ends[j - 1]))
        j = i
    out.reverse()
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column of each batch cut into sentences; the other columns repeated for each."""
    for batch in batches:
        take, start, end = [], [], []
        known: dict[str, list[tuple[int, int]]] = {}
        for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            if not t:
                continue
            s = known.get(t)
            if s is None:
                s = known[t] = spans(t)
            for a, b in s:
                take.append(i)
                start.append(a)
                end.append(b)
        kept = batch.select(list(range(batch.num_columns - 1))).take(pa.array(take, pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(start, pa.int32()), pa.array(end, pa.int32())],
            names=[*kept.schema.names, "start_pos", "end_pos"],
        )


def sentence_rows(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per sentence: the keys and start_pos, end_pos (code points of `text`, the end exclusive).

    Other columns of `df` are left out. Rows that are repeated in `df` give repeated sentences.
    """
    slim = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"))
    schema = T.StructType(
        [*slim.select(*keys).schema, T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())]
    )
    return slim.mapInArrow(_rows, schema)
