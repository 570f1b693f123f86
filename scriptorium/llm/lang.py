"""Which of the six languages a text is in: script first, then votes of frequent words."""

from __future__ import annotations

import re

# Frequent words that tell three languages in Latin script apart.
VOTES = {
    "en": "the of and is are was were in to for on with that we our it this not how what which by from as at an "
    "be or than more after study role training rethinking related work limitations introduction conclusion "
    "discussion does did why has have been one".split(),
    "fr": "le les des du une et est sont dans pour sur avec qui nous notre ce cette au aux par pas ne plus à étude "
    "rôle entraîner repenser travaux connexes limites introduction conclusion discussion pourquoi comment ont été "
    "il elle selon d'après rien mais puis dès quand".split(),
    "es": "el los las del una y es son para por con se lo nuestro nuestra este esta no al su sus más como papel "
    "entrenamiento repensar trabajos relacionados limitaciones introducción conclusión discusión qué cómo fue "
    "fueron muy cuando según ablación entrenar además sin luego nada pero".split(),
}
# Headings in Han characters alone that are Japanese.
JAPANESE_HEADINGS = frozenset("関連研究 限界 結論 考察 序論 議論 手法 実験 結果 謝辞".split())
SETS = {k: frozenset(v) for k, v in VOTES.items()}
WORD = re.compile(r"[^\W\d_]+")
THAI = re.compile(r"[ก-๛]")
KANA = re.compile(r"[ぁ-んァ-ヺー]")
HAN = re.compile(r"[㐀-鿿]")
LATIN = re.compile(r"[^\W\d_]")
SPANISH = re.compile(r"[¿¡ñ]|ción\b|\b[nN]\.º")
FRENCH = re.compile(r"[çèêœûîâëùÀÈÊÇ]|[a-zà-ÿ] [?!:;»]|n°|\b[LldDnNcCsSjJ]['’][a-zà-ÿ]|Ablation de |[ae]mment\\b")
SPANISH_ENDING = re.compile(r"\b[a-záéíóúñ]{3,}[oa]s?\b")


LATIN_LANGS = ("en", "fr", "es")
#: for each word, which of the three languages it votes for, as bits
BITS = {w: sum(1 << i for i, k in enumerate(LATIN_LANGS) if w in SETS[k]) for s in SETS.values() for w in s}
#: for each language, the bits of words that vote for it
HOLDS = [[b for b in range(1, 8) if b >> i & 1] for i in range(3)]


def votes(text: str) -> list[int]:
    """Votes for en, fr and es."""
    bits = list(filter(None, map(BITS.get, WORD.findall(text.lower()))))
    out = [sum(map(bits.count, holds)) for holds in HOLDS]
    top = max(out)
    if top >= 4 and sum(2 * n > top for n in out) == 1:
        return out
    if SPANISH.search(text):
        out[2] += 2
    out[2] += len(SPANISH_ENDING.findall(text)) // 2
    if FRENCH.search(text):
        out[1] += 2
    return out


def detect(text: str | None) -> str | None:
    """The language of a text; None where nothing tells (blank texts, names, symbols, figures)."""
    if not text:
        return None
    if not text.isascii():
        th, ja, zh = len(THAI.findall(text)), len(KANA.findall(text)), len(HAN.findall(text))
        if th + ja + zh:
            wide = th + 2 * (ja + zh)
            if wide > 40 or wide * 4 >= len(LATIN.findall(text)):
                if th >= ja + zh:
                    return "th"
                return "ja" if ja * 8 >= max(zh, 1) or text.strip() in JAPANESE_HEADINGS else "zh"
    v = votes(text)
    top = max(v)
    if not top or v.count(top) > 1:
        return None
    return LATIN_LANGS[v.index(top)]
