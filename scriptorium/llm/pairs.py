"""Broken prompt and response pairs: empty, truncated, refusing, copying and wrong-language answers.

A response is run through the suffix automaton of its prompt, which gives how much of it is copied; refusals
are found by an automaton of phrases, truncation by final marks and a stack of delimiters, the language by
votes of frequent words. Each pair has at most one defect, the first of empty, copy, refusal, wrong_language
and truncated that holds.

Defined results: a null response is empty; a null or blank prompt gives no case for translations, and for
questions leaves only the tests that need no prompt; texts that are rightly the same in both languages (names,
symbols, shared words) are no copies; repeated rows give one case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.lang import detect
from scriptorium.llm.sentences import NEVER_LAST, THAI, last_word, plain

PLACEHOLDER = re.compile(r"\{\{[^{}]*\}\}")
INVISIBLE = re.compile("[​‌‍⁠﻿­‎‏]")
# What stands for nothing.
NOTHING = frozenset(
    "- – — -- --- . .. ... … …… / \\ _ * ? n/a na n.a. n.a none null nil nan undefined empty tbd todo xxx "
    "无 無 なし 空 不适用 暂无 ไม่มี néant ninguno ninguna vide vacío aucun aucune s/o (empty) [empty] <empty> "
    "(none) [none] (blank) [blank] blank (null) [null] <null> （空） （无） (空) (无)".split()
)
# Words that are the same in English and in another language, as headings have them.
SHARED = {"fr": frozenset("introduction conclusion discussion conclusions discussions".split())}
# Phrases by which a model declines. A phrase counts where it opens a sentence of the response, whichever.
REFUSALS = """
i'm sorry, but i|i am sorry, but i|my apologies, |i must decline|i have to decline|i won't be able to|i will not be able to
i can't comply|i cannot comply|i can't help with|i cannot help with|i can't assist|i cannot assist|i'm not able to|i am not able to
i'm unable to|i am unable to|as a language model|as an ai|this request has been blocked|this content falls outside
sorry, this content|sorry, i |sorry, but i|unfortunately i am not permitted|unfortunately, i am not permitted|unfortunately i can|unfortunately, i can
i am not permitted|i'm not permitted|i refuse to|i decline to|i cannot provide|i can't provide|i can't translate|i cannot translate
i cannot answer|i can't answer|i cannot fulfil|i can't fulfil|this request cannot be|your request cannot be|that is not something i
je dois refuser|je suis désolé|je suis désolée|désolé, |désolée, |je regrette, |en tant que modèle de langu|en tant qu'ia|je ne peux pas traiter|je ne peux pas répondre
je ne peux pas vous aider|je ne peux pas traduire|je ne suis pas en mesure|je ne suis pas autorisé|cette demande a été|ce contenu dépasse|malheureusement, je ne
malheureusement je ne|je refuse de|il m'est impossible de répondre|toutes mes excuses|mes excuses
lo siento, |debo rechazar|como modelo de lenguaje|no puedo ayudar|no me es posible|no puedo procesar|no puedo responder|no puedo traducir
esta solicitud ha sido|este contenido queda|disculpe, |disculpa, |mis disculpas|lamentablemente no puedo|lamentablemente, no puedo|no estoy autorizad|me niego a
como ia|no puedo cumplir|tengo que rechazar
抱歉|对不起|很抱歉|非常抱歉|很遗憾，我|作为语言模型|作为一个语言模型|作为人工智能|作为一名|作为ai|该请求不符合|该请求已被|此请求|我无法处理|我不能处理|我无法回答|我不能回答
我无法协助|我必须拒绝|我拒绝|我无法提供|我不能提供|我不便回答|无法完成该请求|此内容超出|该内容超出|不好意思|恕我|请恕|我不能翻译|我无法翻译
申し訳ありません|申し訳ございません|すみません|恐れ入りますが|言語モデルとして|aiとして|この依頼は|このリクエストは|この要求は|お答えできません|対応できません|お手伝いできません|お断り|残念ですが、この|残念ながら、この内容|この内容には|ご要望には
ขออภัย|ฉันจำเป็นต้องปฏิเสธ|ฉันไม่สามารถ|ในฐานะโมเดลภาษา|ในฐานะแบบจำลองภาษา|ผมไม่สามารถ|คำขอนี้|เสียใจด้วย|ต้องขออภัย|ดิฉันไม่สามารถ|เนื้อหานี้
"""


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in filter(None, (p.strip("\n") for p in re.split(r"[|\n]", REFUSALS))):
        a.add_word(phrase, len(phrase))
    a.make_automaton()
    return a


PHRASES = _automaton()
# What may stand before the response proper.
LABEL = re.compile(r"(?i)^\s*(?:(?:q|a|question|answer|source|input|output|translation|text|translated text|response|réponse|respuesta)\s*[:：]|>|译文[:：]|翻译[:：]|输出[:：]|答[:：]|问[:：]|「)\s*")
INSIDE = frozenset("お答えできません 対応できません お手伝いできません お断り 我无法回答 我不便回答 无法完成该请求".split())


def drop_invisible(text: str) -> str:
    """The text without characters that show nothing."""
    return text if text.isascii() else INVISIBLE.sub("", text)


def fold(text: str) -> str:
    """For comparing only: look-alikes replaced, invisible characters dropped, lower case, single spaces."""
    if not text.isascii():
        text = drop_invisible(plain(text)).replace("’", "'")
    return " ".join(text.lower().split())


#: What ends a sentence before a phrase: a final mark, perhaps closed and opened again, or the line.
OPENED = re.compile(r"(?:^|[.!?。！？｡…\n])[\"'“”’‘«»「」『』()（）\s]*$")
# What after a phrase says that the authors speak and not the one who answers.
PLURAL = ("们", "們")


def refuses(response: str | None) -> bool:
    """Whether the response declines: a phrase of refusal opens it or any of its sentences, however long it is."""
    if not response:
        return False
    t = response if response.isascii() else drop_invisible(plain(response)).replace("’", "'")
    t = LABEL.sub("", t.lower()).lstrip("\"'“”«» 「『(（")
    spaced = SPACES.sub(lambda m: "\n" if "\n" in m[0] else " ", t)
    for end, size in PHRASES.iter(spaced):
        at = end + 1 - size
        if spaced[at : end + 1] in INSIDE:
            return True
        if OPENED.search(spaced, max(0, at - 8), at) and (at == 0 or not spaced.startswith(PLURAL, end + 1)):
            return True
    return False


SPACES = re.compile(r"[^\S ]\s*| \s+")  # any but a single space


class SuffixAutomaton:
    """All substrings of one text, for walking another along it."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for c in text:
            now = len(self.next)
            self.next.append({})
            self.size.append(self.size[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.size[p] + 1 == self.size[q]:
                    self.link[now] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.size.append(self.size[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[now] = twin
            last = now

    def covered(self, text: str, least: int) -> int:
        """How many characters of `text` lie in matches of at least `least` characters."""
        state = size = total = reach = 0
        for i, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if c in self.next[state]:
                state = self.next[state][c]
                size += 1
            else:
                size = 0
            if size >= least:
                total += min(size, i + 1 - reach)
                reach = i + 1
        return total


#: Letters from which on a verbatim part of the prompt is a copy, if little else is said.
PART = 40


def copied(prompt: str, response: str) -> bool:
    """Whether the response gives back the prompt, by how much of it lies in long matches.

    It does if nearly all of it is copied, and with it most of the prompt or at least PART letters; or if nearly all of the
    prompt stands in it, whatever follows. Matches are looked for at every length of either.
    """
    a, b = fold(prompt), LABEL.sub("", fold(response))
    if not a or not b:
        return False
    if a == b:
        return True
    least = max(3, min(16, len(a) // 3))
    got = SuffixAutomaton(a).covered(b, least)
    return got >= 0.9 * len(b) and got >= min(0.6 * len(a), PART) or got >= 0.93 * len(a) and (len(b) <= 3 * len(a) + 20 or a in b)


SYMBOLS = re.compile(r"[A-Z][\w]*(?:[-–]\w+)*|v?\d[\d.]*|[^\w\s]|\s")


def same_in_both(src: str, tgt: str, lang: str | None) -> bool:
    """Whether an identical text may be a translation: only names, figures and words both languages share."""
    a, b = fold(src), fold(tgt)
    if a != b:
        return False
    words = re.findall(r"[^\W\d_]+", a)
    if words and all(w in SHARED.get(lang or "", ()) for w in words):
        return True
    # names have capitals inside or figures; "Related Work" has none
    parts = re.findall(r"\S+", re.sub(r"[–/()]", " ", drop_invisible(plain(src))))
    named = [x for x in parts if re.search(r"[A-Z]", x[1:]) or re.search(r"\d", x) or not re.search(r"\w", x)]
    loose = [x for x in parts if x not in named]
    return bool(named) and all(re.fullmatch(r"[A-Z][a-z]+", x) for x in loose) and len(loose) <= len(named)


OPEN, SHUT = "([{«“「『【", ")]}»”」』】"
NARROW = str.maketrans("（）［］｛｝", "()[]{}")
FINAL = re.compile(r"[.!?。！？｡．]['\"”’»)\]」』】）］\s]*$")
FINAL_PROMPT = re.compile(r"[.!?。！？｡．…]['\"”’»)\]」』】）］\s]*$")
# Thai words after which a sentence can't end.
THAI_OPEN = re.compile(r"(?:ของ|ใน|(?<!คง)ที่|และ|บน|จาก|ด้วย|สำหรับ|เป็น|ว่า|เช่น|ซึ่ง|เพราะ|เมื่อ|ไม่|แต่|แล้ว|ระหว่าง|กับ|คือ|ถูก|ราว|ตาม|ต่ำกว่า|เหลือ|ทั้ง|เพิ่ม|ละเลย|การ|ความ|เรา|อยู่|ได้)$")


def unclosed(text: str) -> bool:
    """Whether a bracket or quotation mark stays open."""
    stack = []
    for c in text.translate(NARROW):
        k = OPEN.find(c)
        if k >= 0:
            stack.append(k)
        elif (k := SHUT.find(c)) >= 0 and stack and stack[-1] == k:
            stack.pop()
    return bool(stack) or text.count('"') % 2 == 1


def truncated_translation(src: str, tgt: str) -> bool:
    """Whether the translation breaks off within a sentence that the source completes."""
    t = tgt.rstrip()
    if t.endswith(("…", "...")):
        return not src.rstrip().endswith(("…", "..."))
    a = src.rstrip()
    if THAI.search(t):
        t2 = plain(t)
        if unclosed(t2) and not unclosed(plain(a)):
            return True
        if THAI_OPEN.search(t2):
            return True
        return _cut_name(a, t2)
    if FINAL_PROMPT.search(a):
        if not FINAL.search(t):
            return True
        if t[-1] == ".":
            word = last_word(t, len(t) - 1)
            if word in NEVER_LAST or len(word) == 1 and word.isalpha():
                return True
            if word[-1:].isdigit() and _cut_figure(a, word):
                return True
        return unclosed(t) and not unclosed(a)
    return _cut_name(a, t) or unclosed(t) and not unclosed(a)


def _cut_name(src: str, tgt: str) -> bool:
    """Whether the target ends with the first half of a name of the source."""
    m = re.search(r"[A-Za-z][\w-]*$", tgt)
    if not m or len(m[0]) < 2:
        return False
    names = re.findall(r"[A-Z][A-Za-z0-9_-]*", drop_invisible(plain(src)))
    return m[0] not in names and any(n.startswith(m[0]) and len(n) > len(m[0]) for n in names)


def _cut_figure(src: str, word: str) -> bool:
    """Whether a closing figure is the first half of a decimal of the source, as in "28." for "28.8"."""
    n = re.search(r"\d+$", word)[0]
    whole = re.findall(r"\d+(?:[.,]\d+)*", src)
    return n not in whole and not any(re.split("[.,]", w)[-1] == n for w in whole) and any(
        re.split("[.,]", w)[0] == n for w in whole
    )


def truncated_answer(answer: str, lang: str | None) -> bool:
    """Whether an answer breaks off; figures and terms are complete without a final mark."""
    t = answer.rstrip()
    if t.endswith(("…", "...")):
        return True
    if THAI.search(t):
        return unclosed(t) or bool(THAI_OPEN.search(t))
    if FINAL.search(t):
        if t[-1] == ".":
            word = last_word(t, len(t) - 1)
            if word in NEVER_LAST or len(word) == 1 and word.isalpha():
                return True
        return unclosed(t)
    if re.fullmatch(r"[±~≈<>≤≥]?\s*\d[\d.,\s  ]*\s*[%％‰]?\s*[A-Za-zµμ°]{0,3}[²³]?", t):
        return False
    if unclosed(t):
        return True
    if re.search(r"[㐀-鿿ぁ-んァ-ヺ]", t):
        return len(t) > 8 or bool(re.search(r"[，、；,]", t))
    words = t.split()
    if len(words) > 1 and t[0].isupper():
        return True
    return len(words) > 5 or bool(re.search(r"\d", t)) and len(words) > 2


def defect(kind: str, prompt: str | None, response: str | None, lang: str | None) -> str | None:
    """The defect of one pair, or None. `lang` is the language the response should be in."""
    if kind == "translation" and (not prompt or not prompt.strip()):
        return None
    bare = "" if response is None else drop_invisible(PLACEHOLDER.sub(" ", response)).strip()
    if not bare or bare.lower() in NOTHING or not re.search(r"\w", bare):
        if prompt and kind == "translation" and bare and fold(prompt) == fold(bare):
            return None
        return "empty"
    is_in = detect(bare)
    if kind == "translation":
        source = PLACEHOLDER.sub(" ", prompt).strip()
        if fold(source) == fold(bare):
            if detect(source) == lang and lang is not None or same_in_both(source, bare, lang):
                return None
            return "copy"
        if is_in != lang and copied(source, bare):
            return "copy"
    elif prompt and copied(prompt, bare):
        return "copy"
    if refuses(bare):
        return "refusal"
    if is_in is not None and lang is not None and is_in != lang:
        return "wrong_language"
    if kind == "translation":
        return "truncated" if truncated_translation(source, bare) else None
    return "truncated" if truncated_answer(bare, lang) else None


def _defects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, found = [], []
        columns = (batch.column(c).to_pylist() for c in ("pair_kind", "prompt", "response", "lang"))
        for i, row in enumerate(zip(*columns, strict=True)):
            d = defect(*row)
            if d:
                keep.append(i)
                found.append(d)
        kept = batch.select(["pair_kind", "row_id"]).take(pa.array(keep, pa.int32()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.string())], names=["pair_kind", "row_id", "defect"])


def defects(pairs: DataFrame) -> DataFrame:
    """(pair_kind, row_id, defect) of `pairs` (pair_kind, row_id, prompt, response, lang)."""
    slim = pairs.select("pair_kind", F.col("row_id").cast("bigint").alias("row_id"), "prompt", "response", "lang")
    return slim.mapInArrow(_defects, "pair_kind string, row_id bigint, defect string").distinct()
