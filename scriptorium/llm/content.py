"""Abusive, hateful and sexual content by weak supervision.

Voters (lexicons and patterns in six languages, some for and some against) look at each sentence, after widths,
look-alikes, stars, spaced or doubled letters and figures for letters are undone. How often each combination of
votes occurs over all documents is counted; from these counts a generative label model with one kind of good and
four kinds of bad sentences (KINDS) estimates every voter's accuracy in each kind, and which voters go together in
it (a tree of correlations), by expectation-maximisation. Raters' judgements of documents, where there are any,
are one more voter with an accuracy of its own. A linear classifier on words and votes is trained on the posterior
labels of a bounded sample of sentences (TRAINING of each sort, by hash). A document's score is that of its worst
sentence.

Nothing bounds a voter's weight and no sentence is taken as good beforehand: START only says where the estimate
begins, with the weight of PSEUDO sentences.

Defined results: null, empty and blank texts score 0; every document has one score; documents without source
are reported under a null source; an empty table gives no rows; judgements of unknown documents, ties of raters and
null judgements say nothing.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from heapq import nsmallest

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.forms import form
from scriptorium.session import checkpointed

#: Sentences with votes, and sentences without, that the classifier is trained on at most.
TRAINING = 15_000
#: Documents whose raters' judgements are read at most, by hash of their id.
RATED = 20_000
#: Sentences that the beginning of the estimate weighs as much as, in every kind.
PSEUDO = 100
DIMENSIONS = 1 << 15
THRESHOLD = 0.5

# Insulting nouns for persons.
NOUNS = (
    "idiot idiots moron morons imbecile imbeciles cretin cretins scumbag scumbags dumbass asshole assholes bastard bastards bitch bitches "
    "whore whores slut sluts retard retards dipshit jackass dickhead motherfucker cunt twat wanker prick douchebag halfwit dimwit simpleton "
    "loser losers clown clowns pig pigs scum filth imbécile imbéciles abruti abrutie abrutis crétin crétins connard connards connasse salope "
    "salaud enculé ordure bouffon débile idiote cabrón cabrona cabrones gilipollas imbécil imbéciles idiota idiotas cretino cretina "
    "payaso payasa pendejo pendeja puta puto hijoputa zorra estúpido estúpida subnormal"
).split()
# Several words that insult together, and insults in scripts without spaces.
PHRASES = (
    r"brainless (?:fool|idiot)|worthless (?:clown|\w+ ?pig)|disgusting pig|lying scumbag|pathetic liar|dumb cow|stupid cow|piece of (?:garbage|trash|shit)|useless \w+etin"
    r"|(?:gros|quel|pauvre|espèce de|petit) cons?\b|sale (?:con|crétin|imbécile|abruti|type)|fils de pute|hijo de puta|de mierda|pedazo de (?:basura|mierda)"
    r"|白痴|蠢货|混蛋|废物|傻逼|傻瓜|贱人|王八蛋|狗东西|脑残|蠢猪|狗屎|你(?:这个|就是)?垃圾|哪个垃圾|是个垃圾|臭嘴"
    r"|馬鹿だ|馬鹿で|バカだ|阿呆|アホ|間抜け|クズ|ゴミだ|役立たず|カス|クソ"
    r"|ไอ้|อีโง่|ควาย|โง่เง่า|สารเลว|ชาติหมา|เหี้ย|สัตว์นรก|งี่เง่า"
)
ADJECTIVES = r"stupid|dumb|worthless|disgusting|pathetic|brainless|useless|useless|bête|bêtes|débiles?|tont[oa]s?|inútil(?:es)?|estúpid[oa]s?|inútiles|太蠢|愚蠢|馬鹿|愚か|โง่"
# Words that are undone when they are hidden.
HIDEABLE = sorted(
    set(NOUNS)
    | set(
        "cretino stupid naked nude nudes breasts horny porn hardcore sex hell vermin inferior garbage fool liar cow worthless brainless disgusting pathetic "
        "useless merde gueule foutre vermine nue nues basura mierda desnuda desnudo follarte infierno plaga tontas bêtes étrangers shit fuck fucking kill die lick cages".split()
    )
)
DIRECTED = (
    r"\byou(?:'re| are)? (?:an? |all |such an? |people are |\w+ )?(?:too )?(?:stupid|dumb|idiot|moron|imbecile|\w*cretin|clown|fool|pig|liar|cow|scumbag|piece|disgusting|worthless|brainless|pathetic|useless|lying)"
    r"|\bwhoever wrote this|what kind of [\w ]+ (?:reports|writes|would)|shut up|shut your|nobody asked|so is everybody|you people are|the author is|in[, ]+you \w+|you \w+ \w+[!.]?$"
    r"|\btu n'es qu|\bt'es (?:qu'un|un)|ferme ta gueule|ta gueule|l'auteur est (?:un|une)|quel (?:\w+ )?\w+ a écrit ça|qui a écrit cette"
    r"|\beres un|cállate|el autor es un|qué (?:\w+ )?\w+ escribió esto"
    r"|你这个|你他妈|闭上你|闭嘴|写这篇文章的人是|哪个\w{2}会这样|你们这些"
    r"|お前|黙れ|この著者は|貴様|てめえ|หุบปาก|มึง"
)
THREAT = (
    r"(?:i|we)(?:'ll| will)? (?:will )?(?:find|kill|hurt|beat|break|hunt|destroy) you|break your (?:fingers|legs|neck|arms|bones|face)|should be (?:slapped|beaten|shot|hanged|punched)|jump off a (?:bridge|cliff|roof)"
    r"|go to hell|burn in hell|\bgo die\b|hope you (?:die|lose|get|rot|suffer)|kill yourself|drop dead|go and die"
    r"|casser la (?:figure|gueule)|va te faire|va au diable|va crever|va mourir|crève|je vais te (?:tuer|frapper|casser|buter)|casse-toi"
    r"|romper la cara|vete al infierno|vete a la mierda|te voy a (?:matar|romper|partir)|muérete|ojalá te mueras|que te jodan"
    r"|去死|打断你|杀了你|揍你|弄死你|滚蛋|死ね|殺すぞ|殺してやる|ぶっ殺|地獄に落ち|消えろ|ไปตาย|ฆ่าแก|กูจะฆ่า|ตบแก"
)
DEGRADE = (
    r"\bvermin\b|belong in cages|driven out|too (?:inferior|stupid|dumb|primitive)|inferior to|cleaner without|better off without|no place for|born stupid|ruin everything|subhuman|\bparasites?\b|should be (?:deported|exterminated|banned from)|never let [\w ]+ near|like animals|are animals"
    r"|de la vermine|qu'on les chasse|trop (?:bêtes|stupides|connes?|cons) pour|dehors|race inférieure|parasites"
    r"|son una plaga|que los echen|demasiado (?:tont|estúpid)[oa]s|raza inferior|parásitos|fuera de aquí"
    r"|害虫|滚出去|太蠢|劣等|低等|下等|寄生虫|看不懂|出て行け|追い出せ|劣って|恥さらし|ขยะสังคม|ไล่ออกไป|ชั้นต่ำ"
)
GROUPS = (
    r"immigrants?|foreigners?|refugees?|\bwomen\b|old people|the disabled|people of that faith|people from the|villagers?|muslims?|jews|gays?|blacks|migrants?|peasants"
    r"|étrangers|immigrés|femmes|réfugiés|handicapés|vieux|musulmans|juifs|migrants"
    r"|inmigrantes|extranjeros|mujeres|refugiados|discapacitados|viejos|musulmanes|judíos"
    r"|外地人|女人|外国人|移民|难民|老人|残疾人|乡下人|農民|女は|女性|難民|障害者|田舎者|老人|ผู้หญิง|ต่างด้าว|ผู้ลี้ภัย|คนพิการ|คนแก่"
)
SEXUAL = (
    r"\bnude (?:pictures|photos|pics)|\bnudes\b|naked (?:body|girls|women|photos|pictures|against)|(?:lick|kiss|taste|touch) you (?:all over|everywhere|down there)|\bhorny\b|\bporn\b|hardcore|had sex|sex for hours|sex with (?:you|me)|(?:grabbed|touched|squeezed|sucked|her|his|your) (?:\w+ )?breasts|undressed (?:her|him)|she moaned|he moaned|blowjob|orgasm|want to (?:fuck|screw|bang)|\bcum\b"
    r"|photos? (?:de toi )?nues?\b|envie de toi|te baiser|baise-moi|coucher avec toi|seins nus|sucer|à poil"
    r"|fotos? desnud|follarte|follar|quiero cogerte|tetas|chúpa|desnúdate"
    r"|裸照|上床|做爱|裸体照|操你|性交视频|色情|裸の写真|お前とやりたい|やりたい|セックスし|エロ|おっぱい|ภาพเปลือย|รูปเปลือย|นอนกับเธอ|เอากัน|เย็ด"
)
PROFANE = (
    r"\bfuck\w*|\bshit\w*|\bbullshit|\bcrap\b|goddamn|\bmerde\b|putain|bordel|\bfoutre\b|\bgueule\b|\bmierda\b|\bcoño\b|joder|basura\b|狗屎|他妈|妈的|操|屁|ゴミだ|くそ|クソ|เชี่ย|แม่ง"
)
STUDY = (
    r"the corpus|hate speech|labels hate|offensive language|content moderation|toxicity|we study|under-sampled|interviewed|consent\b|surveyed|filters? can"
    r"|nous étudions|détection des|corpus annoté|estudiamos|detección de|corpus anotado|语料|标注了|仇恨言论|过滤器|コーパス|印を付け|憎悪表現|คลังข้อมูล|ถ้อยคำเกลียดชัง"
)
QUOTED = r"the term [\"“']|the word [\"“']|the phrase [\"“']|is quoted|quoted as|court records|historical source|named after|a village|so-called|le (?:mot|terme) «|se cita|la palabra «|一词|词语“|という語|という言葉|引用|คำว่า"
TECHNICAL = (
    r"child process|kill rates?|cancer|screening|reproduction|singularity|predator|penetration depth|membrane|anatomy|clinical|patients?"
    r"|dépistage|cancer du sein|reproducción|cáncer|biopsia|有性生殖|癌|筛查|生殖|がん検診|มะเร็ง|สืบพันธุ์"
)
THING = r"question|baseline|\bhack\b|\bplots?\b|this proof|\bresult is|nonsense|\bidea\b|\bbug\b|pregunta|问题|質問|คำถาม|résultat|resultado"
FOR = {
    "noun": "", "phrase": PHRASES, "adjective": ADJECTIVES, "directed": DIRECTED, "threat": THREAT, "degrade": DEGRADE,
    "group": GROUPS, "sexual": SEXUAL, "profane": PROFANE, "hidden": "",
}
AGAINST = {"study": STUDY, "quoted": QUOTED, "technical": TECHNICAL, "thing": THING}
VOTERS = [*FOR, *AGAINST]
#: Where expectation-maximisation begins: how often a voter speaks in sentences of each kind; RARELY where nothing is said.
RARELY = 0.002
KINDS = {
    "good": {
        "noun": 2e-3, "phrase": 5e-4, "adjective": 5e-3, "directed": 2e-3, "threat": 5e-5, "degrade": 1e-3, "group": 5e-3, "sexual": 1e-4, "profane": 5e-4,
        "hidden": 1e-3, "study": 0.05, "quoted": 0.02, "technical": 0.03, "thing": 0.04, "judged": 0.03,
    },
    "insult": {"noun": 0.4, "phrase": 0.4, "adjective": 0.25, "directed": 0.6, "profane": 0.2, "hidden": 0.15, "judged": 0.9},
    "threat": {"threat": 0.9, "noun": 0.2, "phrase": 0.2, "adjective": 0.1, "directed": 0.1, "profane": 0.2, "hidden": 0.1, "judged": 0.9},
    "hate": {"degrade": 0.8, "group": 0.8, "adjective": 0.2, "hidden": 0.1, "judged": 0.9},
    "sexual": {"sexual": 0.9, "directed": 0.05, "profane": 0.05, "hidden": 0.2, "judged": 0.9},
}

HIDDEN = VOTERS.index("hidden")
COMPILED = {k: re.compile(v) for k, v in (FOR | AGAINST).items() if v}
NOUN_SET = frozenset(NOUNS)
WORD = re.compile(r"[^\W\d_]+")
#: What a hidden word looks like, and a quick look for places where one may be.
SUSPECT = re.compile(
    r"[*#]|[^\W\d_][013457!|@$]+[^\W\d_]|(?<!\w)[013457@$][^\W\d_]{2}|[^\W\d_]{2}[013457](?!\w)|([^\W\d_])\1\1|(?<!\w)[^\W\d_]([ .\-_])[^\W\d_]\2[^\W\d_](?!\w{4})"
)
MARKED = re.compile(r"[*#@$]|[013457!|](?=[^\W\d_])|(?<=[^\W\d_])[013457]|[ .\-_][^\W\d_][ .\-_][^\W\d_][ .\-_]")
#: A sentence, roughly: up to a final mark and what closes after it; decimals and marks inside words don't end one.
SENTENCE = re.compile(r"[^.!?。！？\n]+(?:[.!?]+(?=[a-zà-ÿ\d])[^.!?。！？\n]+)*[.!?。！？]*[\"'”’»)\]」』]*")
SPACED = re.compile(r"(?<!\w)[^\W\d_]([ .\-_])(?:[^\W\d_]\1){2,}[^\W\d_]{1,3}(?!\w)")
TOKEN = re.compile(r"[\w*@$!|#]+")
LEET = str.maketrans("013457@$!|", "oieastasil")
LETTERS = re.compile(r"(\w)\1+")
WIDE = re.compile(r"[㐀-鿿ぁ-んァ-ヺー]+|[ก-๛]+")
TEN_RUN = re.compile(r"(\w)\1\1+")



def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern at its top level."""
    out, depth, last, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "|" and not depth:
            out.append(pattern[last:i])
            last = i + 1
        i += 1
    return [*out, pattern[last:]]


def _literal(alternative: str) -> str:
    """The longest string that every match of an alternative has outside of its groups and classes; "" if there is none."""
    best, run, depth, i = "", "", 0, 0
    while i < len(alternative):
        c, after = alternative[i], alternative[i + 1 : i + 2]
        plain = c not in "\\()[]{}.?*+^$" and not depth
        if plain and after not in ("?", "*", "{"):
            run += c
        else:
            best, run = max(best, run, key=len), ""
            depth += (c in "([") - (c in ")]")
            i += c == "\\"
        i += 1
    return max(best, run, key=len)


#: The bit of strings that say a word may be hidden.
ODD = 1 << 30


def _triggers() -> tuple[ahocorasick.Automaton, int]:
    """An automaton of strings that a voter needs, with the voters as bits, and the voters that need none."""
    held: dict[str, int] = dict.fromkeys((c * 3 for c in "abcdefghijklmnopqrstuvwxyzàâçéèêëîïôûùüœñáíóú"), ODD)
    always = 0
    for i, v in enumerate(VOTERS):
        if v == "hidden":
            continue
        found = set(NOUNS) if v == "noun" else {_literal(x) for x in _alternatives(COMPILED[v].pattern)}
        if "" in found:
            always |= 1 << i
        for w in found - {""}:
            held[w] = held.get(w, 0) | 1 << i
    a = ahocorasick.Automaton()
    for w, bits in held.items():
        a.add_word(w, bits)
    a.make_automaton()
    return a, always


TRIGGERS, ALWAYS = _triggers()


def _squeeze(w: str) -> str:
    return LETTERS.sub(r"\1", w)


SQUEEZED: dict[str, str] = {}
for _w in HIDEABLE:
    SQUEEZED.setdefault(_squeeze(_w), _w)
HIDEABLE_SET = frozenset(HIDEABLE)
BY_SIZE: dict[tuple[str, int], list[str]] = {}
for _w in HIDEABLE:
    BY_SIZE.setdefault((_w[0], len(_w)), []).append(_w)


def _shown(token: str) -> str | None:
    """The word of HIDEABLE that a token hides, if it hides one."""
    if "*" in token or "#" in token:
        core = token.strip("*#") or ""
        if not core or len(token) < 3:
            return None
        token = token.translate(LEET)
        rx = re.compile("".join("." if c in "*#" else re.escape(c) for c in token))
        return next((w for w in BY_SIZE.get((token[0], len(token)), ()) if rx.fullmatch(w)), None)
    if re.search(r"[013457@$!|]", token) and re.search(r"[^\W\d_]", token):
        plain = token.rstrip("!|").translate(LEET)
        if plain in HIDEABLE_SET:
            return plain
        return SQUEEZED.get(_squeeze(plain)) if TEN_RUN.search(plain) else None
    if TEN_RUN.search(token):
        return SQUEEZED.get(_squeeze(token))
    return None


def consistent(text: str) -> str:
    """The text in one form and lower case."""
    return form(text, fold_case=True).replace("’", "'")


def undo(t: str) -> tuple[str, bool]:
    """A text of `consistent` with hidden words shown, and whether there were any."""
    if not SUSPECT.search(t):
        return t, False
    hidden = False

    def joined(m: re.Match) -> str:
        nonlocal hidden
        parts = m[0].split(m[1])
        # "a i d i o t to": neither the article nor the next word is part of the word
        for first, last in ((0, len(parts)), (1, len(parts)), (0, len(parts) - 1), (1, len(parts) - 1)):
            w = "".join(parts[first:last])
            found = w if w in HIDEABLE_SET else SQUEEZED.get(_squeeze(w))
            if found:
                hidden = True
                return " ".join([*parts[:first], found, *parts[last:]])
        return m[0]

    def token(m: re.Match) -> str:
        nonlocal hidden
        w = _shown(m[0])
        hidden |= w is not None
        return w or m[0]

    return TOKEN.sub(token, SPACED.sub(joined, t)), hidden


def _bits(t: str) -> tuple[int, str]:
    """The voters that speak on a sentence of `consistent`, as bits, and the text they looked at."""
    t, hidden = undo(t)
    bits, ask = (1 << HIDDEN if hidden else 0), ALWAYS
    for _, voters in TRIGGERS.iter(t):
        ask |= voters
    for i, v in enumerate(VOTERS):
        if ask >> i & 1 and (any(w in NOUN_SET for w in WORD.findall(t)) if v == "noun" else COMPILED[v].search(t)):
            bits |= 1 << i
    return bits, t


def votes(text: str) -> tuple[int, str]:
    """The voters that speak on a sentence, as bits, and the text they looked at."""
    return _bits(consistent(text))


def judged(text: str) -> list[tuple[int, str]]:
    """Votes and text of each sentence of a document. A quick look shows which sentences need a closer one."""
    out = []
    for x in SENTENCE.findall(consistent(text)):
        if ALWAYS or next(TRIGGERS.iter(x), None) or MARKED.search(f" {x}"):
            out.append(_bits(x))
        elif not x.isspace():
            out.append((0, x))
    return out


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[w] = zlib.crc32(w.encode("utf-8", "replace")) & (DIMENSIONS - 1)
        return h


HASH = _Hashes()


def _words(t: str) -> set[str]:
    """Words of a sentence as the classifier sees them: doubled letters are one, scripts without spaces give pairs of letters."""
    if not WIDE.search(t):
        return set(WORD.findall(t))
    return {y for x in WORD.findall(t) for y in ([x[i : i + 2] for i in range(max(1, len(x) - 1))] if WIDE.search(x) else (x,))}


def _vote_features(bits: int) -> list[int]:
    on = [i for i in range(len(VOTERS)) if bits >> i & 1]
    n = len(VOTERS)
    return [*(DIMENSIONS + i for i in on), *(DIMENSIONS + n + i * n + j for i in on for j in on if i < j)]


def features(bits: int, t: str) -> list[int]:
    """Hashed words of a sentence, then its votes and pairs of votes."""
    return [*{HASH[w] for w in _words(t)}, *_vote_features(bits)]


SIZE = DIMENSIONS + len(VOTERS) * (len(VOTERS) + 1)


def _tally(rated):
    """Rows of two sorts: how often each combination of votes and judgement occurs (`sentence` null), and the TRAINING
    sentences with votes and without that have the least hashes in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = rated.value
        n: dict[tuple[int, int], int] = {}
        kept: tuple[dict[int, tuple[str, int]], ...] = ({}, {})
        least = [1 << 63, 1 << 63]
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                says = said.get(key, -1) if said else -1
                for bits, t in judged(text):
                    # a judgement is of the document, so it is about sentences that some voter speaks against
                    k = (bits, says if bits & ACCUSING else -1)
                    n[k] = n.get(k, 0) + 1
                    h, sort = xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) >> 1, bits != 0
                    if h < least[sort]:
                        kept[sort][h] = (t, bits)
                        if len(kept[sort]) >= 2 * TRAINING:
                            few = nsmallest(TRAINING, kept[sort])
                            held = [(x, kept[sort][x]) for x in few]
                            kept[sort].clear()
                            kept[sort].update(held)
                            least[sort] = few[-1]
        rows = [(b, r, m, None, None) for (b, r), m in n.items()]
        rows += [(x[1], -1, 0, h, x[0]) for held in kept for h, x in ((h, held[h]) for h in nsmallest(TRAINING, held))]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bits", "says", "n", "h", "sentence"])

    return run


ACCUSING = (1 << len(FOR)) - 1


def _tree(joint: np.ndarray, p: np.ndarray) -> list[int]:
    """For each voter the one it goes with most (-1 for the root): the tree of most mutual information."""
    k = len(p)
    info = np.zeros((k, k))
    for x, px in ((1, p), (0, 1 - p)):
        for y, py in ((1, p), (0, 1 - p)):
            both = joint if x and y else p[:, None] - joint if x else p[None, :] - joint if y else 1 - p[:, None] - p[None, :] + joint
            both = np.maximum(both, 1e-12)
            info += both * np.log(both / (px[:, None] * py[None, :]))
    parent, best, near, left = [-1] * k, info[0].copy(), np.zeros(k, int), set(range(1, k))
    while left:
        j = max(left, key=lambda x: best[x])
        left.remove(j)
        parent[j] = int(near[j])
        closer = info[j] > best
        near[closer], best = j, np.maximum(best, info[j])
    return parent


def _likelihood(fires: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Log likelihood of each combination under the voters' rates and their tree, both estimated from weighted combinations."""
    total = weight.sum() + PSEUDO
    p = np.clip((weight @ fires + PSEUDO * start) / total, 1e-7, 1 - 1e-7)
    joint = ((fires * weight[:, None]).T @ fires + PSEUDO * np.outer(start, start)) / total
    np.fill_diagonal(joint, p)
    out = np.zeros(len(fires))
    for j, up in enumerate(_tree(joint, p)):
        if up < 0:
            chance = np.full(len(fires), p[j])
        else:
            on, off = joint[j, up] / p[up], (p[j] - joint[j, up]) / (1 - p[up])
            chance = np.clip(np.where(fires[:, up] > 0, on, off), 1e-7, 1 - 1e-7)
        out += np.log(np.where(fires[:, j] > 0, chance, 1 - chance))
    return out


def label_model(bits: np.ndarray, n: np.ndarray, says: np.ndarray | None = None, rounds: int = 60) -> np.ndarray:
    """Posterior of being bad of each combination of votes, from how often each occurs.

    `says` is the judgement of the document: 1 bad, 0 good, -1 none.
    """
    says = np.full(len(bits), -1) if says is None else says
    fires = (bits[:, None] >> np.arange(len(VOTERS))[None, :] & 1).astype(float)
    starts = [np.array([k.get(v, RARELY) for v in VOTERS]) for k in KINDS.values()]
    by_rater = np.array([k["judged"] for k in KINDS.values()])
    prior = np.array([0.99] + [0.01 / (len(KINDS) - 1)] * (len(KINDS) - 1))
    told, accused = says >= 0, says == 1
    post = np.zeros((len(bits), len(KINDS)))
    for r in range(rounds + 1):
        if r:
            w = n[:, None] * post
            prior = (w.sum(0) + PSEUDO) / (n.sum() + PSEUDO * len(KINDS))
            by_rater = np.clip((w[accused].sum(0) + PSEUDO * by_rater) / (w[told].sum(0) + PSEUDO), 1e-3, 1 - 1e-3)
            likely = np.stack([_likelihood(fires, w[:, c], s) for c, s in enumerate(starts)], 1)
        else:
            likely = np.stack([fires @ np.log(s) + (1 - fires) @ np.log1p(-s) for s in starts], 1)
        likely[accused] += np.log(by_rater)
        likely[told & ~accused] += np.log1p(-by_rater)
        z = np.log(prior) + likely
        post = np.exp(z - z.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
    return 1 - post[:, 0]


def train(rows: list[tuple[list[int], float]], epochs: int = 40, size: int = 512, rate: float = 0.3, decay: float = 1e-6, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier on sparse binary features and soft labels, by AdaGrad over small batches."""
    w, g = np.zeros(SIZE), np.full(SIZE, 1e-3)
    bias, gb = -3.0, 1e-3
    if not rows:
        return w.astype(np.float32), -10.0
    order = np.random.default_rng(seed)
    lengths = np.array([len(f) for f, _ in rows])
    flat, at = np.concatenate([np.array(f, np.int64) for f, _ in rows]), np.concatenate([[0], lengths.cumsum()])
    labels = np.array([y for _, y in rows])
    for _ in range(epochs):
        turn = order.permutation(len(rows))
        for x in range(0, len(turn), size):
            who = turn[x : x + size]
            m = lengths[who]
            ends = m.cumsum()
            ids = flat[np.arange(ends[-1]) - np.repeat(ends - m - at[who], m)]
            row = np.repeat(np.arange(len(who)), m)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[ids], len(who)) + bias, -30, 30)))
            e = p - labels[who]
            d = np.bincount(ids, e[row], SIZE) / len(who) + decay * w
            g += d * d
            w -= rate * d / np.sqrt(g)
            b = e.mean()
            gb += b * b
            bias -= rate * b / np.sqrt(gb)
    return w.astype(np.float32), float(bias)


def fit(docs: DataFrame, text: str, key: str | None = None, ratings: DataFrame | None = None) -> tuple[np.ndarray, float]:
    """The classifier, from the votes of all documents and a bounded sample of their sentences.

    `ratings` holds `key` and objectionable (0 or 1); at most RATED documents' judgements are read.
    """
    spark, said = docs.sparkSession, {}
    if ratings is not None and key is not None:
        one = ratings.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg("objectionable").alias("m")).where("m <> 0.5")
        said = {r[0]: int(r[1] > 0.5) for r in one.orderBy(F.xxhash64(key), key).limit(RATED).collect()}
    rated = spark.sparkContext.broadcast(said)  # RATED judgements at most
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key) if key else F.lit(None).cast("int").alias("key"), F.col(text).alias("text"))
    seen = checkpointed(texts.mapInArrow(_tally(rated), "bits int, says int, n bigint, h bigint, sentence string"))
    # at most 3 rows for each of 2 to the number of voters combinations
    counts = seen.where("sentence is null").groupBy("bits", "says").agg(F.sum("n").alias("n")).orderBy("bits", "says").collect()
    if not counts:
        return np.zeros(SIZE, np.float32), -10.0
    bits, says, n = (np.array([r[i] for r in counts]) for i in range(3))
    posterior = label_model(bits, n.astype(float), says)
    # a sentence's label is that of its votes, over documents with judgements and without
    weight, bad = {}, {}
    for b, m, p in zip(bits.tolist(), n.tolist(), posterior.tolist(), strict=True):
        weight[b], bad[b] = weight.get(b, 0) + m, bad.get(b, 0.0) + m * p
    sample = seen.where("sentence is not null").select("h", "sentence", "bits").dropDuplicates(["h", "bits"])
    voted, silent = (sample.where(c).orderBy("h", "sentence").limit(TRAINING) for c in ("bits <> 0", "bits = 0"))
    return train([(features(r.bits, r.sentence), bad[r.bits] / weight[r.bits]) for r in voted.union(silent).toLocalIterator()])


class _Weights(dict):
    """The classifier's weight of a word, worked out when it is first met."""

    def __init__(self, w: np.ndarray) -> None:
        super().__init__()
        self.w = w

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        x = self[word] = float(self.w[HASH[word]])
        return x


def _scorer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = sent.value
        of_word, of_votes = _Weights(w), {}
        known: dict[tuple[int, str], float] = {}
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                top = None
                for x in judged(text) if text else ():
                    z = known.get(x)
                    if z is None:
                        if len(known) > 50_000:
                            known.clear()
                        bits, t = x
                        if bits not in of_votes:
                            of_votes[bits] = float(w[_vote_features(bits)].sum()) if bits else 0.0
                        words = _words(t)
                        # words of one hash count once, as in training
                        places = {HASH[y] for y in words} if len(words) > 1 else words
                        z = sum(map(of_word.__getitem__, words)) if len(places) == len(words) else float(w[[*places]].sum())
                        z = known[x] = z + of_votes[bits] + bias
                    top = z if top is None or z > top else top
                out.append(0.0 if top is None else round(1 / (1 + math.exp(-max(-30.0, min(30.0, top)))), 6))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def scores(docs: DataFrame, keys: list[str], text: str, ratings: DataFrame | None = None) -> DataFrame:
    """The keys of every document and its score between 0 and 1; `ratings` are by the first key."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, text, keys[0], ratings))  # SIZE floats
    slim = docs.select(*keys, F.col(text).alias("_text"))
    schema = ", ".join(f"`{k}` {t}" for k, t in slim.dtypes[:-1]) + ", score double"
    return slim.mapInArrow(_scorer(sent), schema)


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each source, its documents, how many are to be reviewed, and the rate."""
    out = scored.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= threshold).alias("flagged"), F.avg("score").alias("mean_score"))
    return out.withColumn("rate", F.col("flagged") / F.col("documents"))
