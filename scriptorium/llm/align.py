"""Sentence alignment of translated texts by a hidden Markov model.

Each target sentence is emitted by a state: one source sentence, a span of two neighbouring ones (a merge), or null
(an added sentence), which keeps the place reached so far. What a state emits is the likeness of its source to the
target sentence, in steps: a bilingual lexicon and anchors (figures and names that stand in both texts) give it. The
probabilities of likenesses, jumps, spans and null are estimated from all texts by expectation-maximisation
(forward and backward sums, `ROUNDS` times), and the best path of every text is decoded (Viterbi). Texts of one
shape, that is with as many sentences, are worked on together.

The lexicon is a corpus statistic: Dice's coefficient of words (Han and kana: pairs of characters, Thai:
triples) over all text pairs, whatever their length and numbers of sentences; `counterparts` says which sentences
count as one another's. Every feature counts: cells of the DENSE most frequent ones are read from a table, those of
rarer ones from a sorted list. A pair of texts that occurs several times is cut and compared once and counted as
often as it occurs.

Defined results: null and blank texts, refusals and targets in the source's own language give no pair, save
texts that are rightly the same in both languages; repeated rows of a translation give their pairs once; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.lang import detect
from scriptorium.llm.pairs import INVISIBLE, refuses, same_in_both
from scriptorium.llm.sentences import plain, spans
from scriptorium.session import checkpointed

SPACE = 1 << 16  # hashed features
DENSE = 2048  # the most frequent features a language and side, whose cells stand in a table; those of the rest are listed
CELLS = 2_000_000  # counts a task holds for a pair of languages before they are added up
LEAST_DICE = 0.03  # a weaker association is none
LETTERS = 2_000_000  # of sentences whose words are kept for when they come again
BLOCK = 4_000_000  # features against features compared at once
ROUNDS = 4  # of expectation-maximisation
PSEUDO = 50.0  # target sentences that the beginning of the estimate weighs as much as
#: Steps of likeness, and of what a span's second sentence adds to it; the last likeness is that of sentences nothing is known about.
LIKE = np.array([0.03, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.96])
#: Weights of all features of a target sentence that part short, middling and long ones, as likeness says more of long ones.
SIZES = np.array([15.0, 40.0])
ADDED = np.array([0.05, 0.1, 0.15, 0.2, 0.3])
UNIFORM = 0.15  # share of jumps that go anywhere, whatever was counted
DOUBT = 0.01  # share of the beginning that likenesses keep
UNKNOWN = (len(LIKE) + 1) * (len(SIZES) + 1)
ANCHOR = 2.0  # weight of an anchor against a lexical feature

#: A figure with its separators, a name, a word of small letters, or a run of Han, kana or Thai letters.
TOKEN = re.compile(
    r"\d{1,3}(?:[ \u00a0\u202f]\d{3})+(?!\d)|\d+(?:[.,]\d+)*|[A-Z]\w*(?:-\w+)*|(?<![\w-])[a-zß-öø-ÿœ]+(?!\w)"
    r"|[㐀-鿿ぁ-んァ-ヺー]+|[ก-๛]+"
)
LATIN_NAME = re.compile(r"[A-Z][A-Za-z0-9_]*(?:-[A-Za-z0-9_]+)*")


def _hash(w: str) -> int:
    return zlib.crc32(w.encode()) & (SPACE - 1)


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[w] = _hash(w)
        return h


HASH = _Hashes()


def parts_of(text: str) -> tuple[list[str], set[str]]:
    """Words (or runs of letters) of one sentence, and its anchors: figures without their separators, and names."""
    words: list[str] = []
    anchors: set[str] = set()
    for w in TOKEN.findall(text):
        c = w[0]
        if "a" <= c <= "ʯ":
            words.append(w)
        elif "A" <= c <= "Z":
            if w.isascii():
                anchors.add(w)
                continue
            # in scripts without spaces the text goes on right after a name
            anchors.add(LATIN_NAME.match(w)[0])
            for run in WIDE.findall(w):
                words += map(add, run, run[1:]) if len(run) > 1 else [run]
        elif c.isdigit():
            anchors.add(w if w.isdigit() else "".join([x for x in w if x.isdigit()]))
        elif "ก" <= c <= "๛":
            words += map("".join, zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else [w]
        else:
            words += map(add, w, w[1:]) if len(w) > 1 else [w]
    if not words:  # a heading whose words all have capitals
        words = [x.lower() for x in anchors if x.isalpha() and x[1:].islower()]
    return list(dict.fromkeys(words)), anchors


WIDE = re.compile(r"[㐀-鿿ぁ-んァ-ヺー]+|[ก-๛]+")


class _Known(dict):
    """Hashed words and anchors of the last sentences, as passes of a translation have most of theirs in common."""

    letters = 0

    def __missing__(self, sentence: str) -> tuple[bytes, set[str]]:
        self.letters += len(sentence)
        if self.letters > LETTERS:
            self.clear()
            self.letters = len(sentence)
        words, anchors = parts_of(sentence)
        got = self[sentence] = array("H", list(map(HASH.__getitem__, words))).tobytes(), anchors
        return got


KNOWN = _Known()


class Index(dict):
    """From a word to its place in a table, by its hash; words met once are looked up at once from then on."""

    def __init__(self, hashes: list[int]) -> None:
        super().__init__()
        self.place = {h: i for i, h in enumerate(hashes)}
        self.none = len(hashes)
        self.of = np.full(SPACE + 1, self.none)  # by hash; the last is for a sentence without features
        self.of[np.array(hashes, int)] = np.arange(self.none)

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        i = self[w] = self.place.get(_hash(w), self.none)
        return i

    def __reduce__(self):
        return Index, (list(self.place),)


class Side:
    """One text cut into sentences, with what alignment compares; kept for the next pair with the same text."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.lang = detect(text)
        self.spans = spans(text)
        self._parts: tuple | None = None
        self._where: dict[str, list[int]] | None = None

    @property
    def parts(self) -> tuple[list[bytes], list[set[str]]]:
        """Hashed words and anchors of each sentence."""
        if self._parts is None:
            text = plain(self.text)
            cut = [text[x:y] for x, y in self.spans]
            if not text.isascii() and INVISIBLE.search(text):
                cut = [INVISIBLE.sub("", x) for x in cut]
            both = [KNOWN[x] for x in cut]
            self._parts = ([x for x, _ in both], [x for _, x in both])
        return self._parts

    @property
    def hashed(self) -> tuple[bytes, bytes]:
        """Hashes of the words, sentence after sentence, and how many each sentence has."""
        words = self.parts[0]
        return b"".join(words), array("i", [len(x) // 2 for x in words]).tobytes()

    @property
    def where(self) -> dict[str, list[int]]:
        """The sentences that have each anchor."""
        if self._where is None:
            self._where = {}
            for i, own in enumerate(self.parts[1]):
                for x in own:
                    self._where.setdefault(x, []).append(i)
        return self._where


class Cells:
    """Dice of every source and target feature by their places, which go from the most frequent on.

    Cells of the most frequent features on both sides lie in a dense table, rows end to end, as one lookup by
    position is the quickest; all others are found by bisection, so no feature is left out.
    """

    def __init__(self, s: np.ndarray, t: np.ndarray, dice: np.ndarray, n_s: int, n_t: int) -> None:
        self.width, self.top_s, self.top_t = n_t + 1, min(n_s, DENSE), min(n_t, DENSE)
        self.n_s, self.n_t = n_s, n_t
        inside = (s < self.top_s) & (t < self.top_t)
        # the row and column after the last are for what the table lacks
        self.dense = np.zeros((self.top_s + 1) * (self.top_t + 1), np.float32)
        self.dense[s[inside] * (self.top_t + 1) + t[inside]] = dice[inside]
        keys = s[~inside].astype(np.int64) * self.width + t[~inside]
        order = keys.argsort()
        self.keys, self.rest = np.append(keys[order], np.iinfo(np.int64).max), np.append(dice[~inside][order], np.float32(0))

    def rows(self, ids: np.ndarray) -> np.ndarray:
        return (np.minimum(ids, self.top_s) * (self.top_t + 1))[:, None]

    def cols(self, ids: np.ndarray) -> np.ndarray:
        return np.minimum(ids, self.top_t)

    def _listed(self, keys: np.ndarray) -> np.ndarray:
        at = self.keys.searchsorted(keys)
        return np.where(self.keys[at] == keys, self.rest[at], np.float32(0))

    def of(self, rows: np.ndarray, s: np.ndarray, cols: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Dice of the features at `s` (`rows` of the table) with those at `t` (`cols` of it)."""
        got = self.dense.take(rows + cols)
        if len(self.keys) > 1:
            i, j = np.flatnonzero((s >= self.top_s) & (s < self.n_s)), np.flatnonzero((t >= self.top_t) & (t < self.n_t))
            if len(i):
                got[i] = self._listed(s[i][:, None].astype(np.int64) * self.width + t)
            if len(j):
                got[:, j] = self._listed(s[:, None].astype(np.int64) * self.width + t[j])
        return got


class _Sides(dict):
    """Sides of the last few hundred source texts, as a unit's translations stand near one another."""

    def __missing__(self, text: str) -> Side:
        if len(self) > 256:
            self.clear()
        s = self[text] = Side(text)
        return s


def _runs(items: list[int], bounds: list[int]) -> list[list[int]]:
    """`items`, ascending, cut at `bounds`: as many runs as there are bounds and one more, maybe empty."""
    out, k = [], 0
    for b in bounds:
        at = k
        while k < len(items) and items[k] < b:
            k += 1
        out.append(items[at:k])
    return [*out, items[k:]]


def _met(a: Side, b: Side) -> list[tuple[int, list[int]]]:
    """For each anchor of each target sentence that the source has: that sentence, and the source sentences that have it."""
    where = a.where
    return [(j, held) for j, own in enumerate(b.parts[1]) for x in own if (held := where.get(x))]


def counterparts(a: Side, b: Side, met: list[tuple[int, list[int]]] | None = None) -> list[tuple[list[int], list[int]]]:
    """Groups of source and target sentences that the lexicon counts together; every sentence is in one at least.

    Sentences that share anchors with one another more than with any other are fixed pairs, moved ones too. The
    rest lies between fixed pairs that go in order: as many on either side are taken in order, else in runs in
    proportion; where one side has none, the sentences join the fixed pairs around them (splits and merges).
    """
    m, n = len(a.spans), len(b.spans)
    if not m or not n:
        return []
    if m == 1 or n == 1:
        return [([*range(m)], [*range(n)])]
    likeness: dict[tuple[int, int], float] = {}
    for j, held in _met(a, b) if met is None else met:
        if 2 * len(held) <= m:  # one of most sentences tells none
            w = ANCHOR * math.log(1 + (m + 1) / (0.5 + len(held)))
            for i in held:
                likeness[i, j] = likeness.get((i, j), 0.0) + w
    best_i, best_j = [0.0] * m, [0.0] * n
    for (i, j), w in likeness.items():
        best_i[i], best_j[j] = max(best_i[i], w), max(best_j[j], w)
    best = [k for k, w in likeness.items() if w >= best_i[k[0]] - 1e-9 and w >= best_j[k[1]] - 1e-9]
    n_i, n_j = [0] * m, [0] * n
    for i, j in best:
        n_i[i], n_j[j] = n_i[i] + 1, n_j[j] + 1
    fixed = sorted([k for k in best if n_i[k[0]] == n_j[k[1]] == 1], key=lambda k: k[1])
    out = [([i], [j]) for i, j in fixed]
    # the longest chain of fixed pairs in order bounds the rest
    ends, before, at = [], {}, []
    for k in fixed:
        p = bisect_left(ends, k[0])
        before[k] = at[p - 1] if p else None
        ends[p:], at[p:] = [k[0], *ends[p + 1 :]], [k, *at[p + 1 :]]
    chain, k = [], at[-1] if at else None
    while k is not None:
        chain.append(k)
        k = before[k]
    chain.reverse()
    held_i, held_j = {i for i, _ in fixed}, {j for _, j in fixed}
    left_i = _runs([i for i in range(m) if i not in held_i], [i for i, _ in chain])
    left_j = _runs([j for j in range(n) if j not in held_j], [j for _, j in chain])
    for g, (s, t) in enumerate(zip(left_i, left_j, strict=True)):
        if s and t:
            k = min(len(s), len(t))
            out += [(s[x * len(s) // k : (x + 1) * len(s) // k], t[x * len(t) // k : (x + 1) * len(t) // k]) for x in range(k)]
        elif s or t:
            near = chain[max(g - 1, 0) : g + 1]
            out.append((s or [i for i, _ in near] or [*range(m)], t or [j for _, j in near] or [*range(n)]))
    return out


def _once(batch: pa.RecordBatch, *columns: str) -> dict[tuple, list[int]]:
    """The rows of a batch by what stands in `columns`."""
    out: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in columns), strict=True)):
        out.setdefault(key, []).append(i)
    return out


def _shared(met: list[tuple[int, list[int]]]) -> list[int]:
    """Three numbers for each anchor of a target sentence and source sentence that has it: both sentences, and how many
    source sentences have it (below 0 from the second one on)."""
    out: list[int] = []
    for j, held in met:
        k = len(held)
        for i in held:
            out += (j, i, k)
            k = -abs(k)
    return out


_READ = (
    "ids array<bigint>, pair string, counted boolean, kept boolean, src array<int>, tgt array<int>, "
    "s binary, s_n binary, t binary, t_n binary, left binary, right binary, shared binary"
)
_READ_KINDS = {
    "ids": pa.list_(pa.int64()), "pair": pa.string(), "counted": pa.bool_(), "kept": pa.bool_(), "src": pa.list_(pa.int32()), "tgt": pa.list_(pa.int32()),
    **dict.fromkeys(("s", "s_n", "t", "t_n", "left", "right", "shared"), pa.binary()),
}


def _read_row(a: Side, b: Side, counted: bool, kept: bool, ids: list[int]) -> tuple:
    """What is kept of a pair of texts: where sentences begin, features, groups of counterparts, shared anchors."""
    left, right, met = [], [], _met(a, b)
    if counted:
        for g, (x, y) in enumerate(counterparts(a, b, met)):
            for i in x:
                left += (g, i)
            for j in y:
                right += (g, j)
    numbers = (array("i", x).tobytes() for x in (left, right, _shared(met) if kept else ()))
    return ids, f"{a.lang}>{b.lang}", counted, kept, [x for x, _ in a.spans], [x for x, _ in b.spans], *a.hashed, *b.hashed, *numbers


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * len(_READ_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _READ_KINDS.values(), strict=True)], names=list(_READ_KINDS))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different pair of texts of a batch that is counted in the lexicon (`counted`) or aligned (`kept`)."""
    for batch in batches:
        sides, out = _Sides(), []
        row_ids = batch.column("row_id").to_pylist()
        for (src, tgt, lang), rows in _once(batch, "src", "tgt", "lang").items():
            a, b = sides[src], Side(tgt)
            if not a.spans or not b.spans:
                continue
            counted = bool(a.lang and b.lang and a.lang != b.lang)
            kept = same_in_both(src, tgt, lang) if src == tgt or a.lang == b.lang is not None else not refuses(tgt)
            if counted or kept:
                out.append(_read_row(a, b, counted, kept, [row_ids[i] for i in rows]))
        yield _read_batch(out)


def read(texts: DataFrame) -> DataFrame:
    """Every pair of `texts` (row_id, lang, src, tgt) cut and compared once, for the lexicon and for likenesses."""
    return checkpointed(texts.select("row_id", "lang", "src", "tgt").mapInArrow(_reader, _READ))


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Where each of the runs of `sizes` begins, and the end of the last one."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _inner(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs that begin at `starts`, one after another."""
    ends = sizes.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Read:
    """A batch of `_READ` as flat arrays. `*_at` says where runs begin."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.batch, self.size = batch, batch.num_rows
        self.m, self.n = (np.array(batch.column(c).value_lengths().to_numpy(zero_copy_only=False), np.int64) for c in ("src", "tgt"))
        self.s, self.t = self._flat("s", np.uint16)[0], self._flat("t", np.uint16)[0]
        self.s_n, self.t_n = self._flat("s_n", np.int32)[0], self._flat("t_n", np.int32)[0]
        self.s_at, self.t_at = _starts(self.s_n), _starts(self.t_n)  # of each sentence's features
        self.m_at, self.n_at = _starts(self.m), _starts(self.n)  # of each text's sentences

    def _flat(self, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
        x = self.batch.column(column).cast(pa.large_binary())
        _, at, data = x.buffers()
        at = np.frombuffer(at, np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)
        flat = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]].view(kind)
        return flat, (at - at[0]) // flat.itemsize

    def numbers(self, column: str, each: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups of `each` numbers of some rows, and whose they are."""
        flat, at = self._flat(column, np.int32)
        sizes = np.diff(at)[rows] // each
        return flat.reshape(-1, each)[_inner(at[:-1][rows] // each, sizes)].astype(np.int64), np.repeat(rows, sizes)

    def pairs(self, column: str) -> Iterator[tuple[str, np.ndarray]]:
        """The rows for which `column` is true, by pair of languages."""
        codes = self.batch.column("pair").dictionary_encode()
        true = self.batch.column(column).to_numpy(zero_copy_only=False).astype(bool)
        which = codes.indices.to_numpy(zero_copy_only=False)
        for k, pair in enumerate(codes.dictionary.to_pylist()):
            if len(rows := np.flatnonzero(true & (which == k))):
                yield pair, rows


class _Sums:
    """How often features stand on both sides of a group, for one pair of languages.

    Features have places in order of their coming. While the table of all places is small, counts are added up in it;
    beyond that, by sorting. A feature is its hash and 1 more, as 0, with place 0, counts the other side alone.
    """

    def __init__(self) -> None:
        self.place = [np.append(0, np.full(SPACE, -1)) for _ in range(2)]
        self.at = [np.array([-1]), np.array([-1])]
        self.table = np.zeros((0, 0), np.int64)
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _places(self, side: int, features: np.ndarray) -> np.ndarray:
        place = self.place[side]
        got = place[features]
        if len(new := np.unique(features[got < 0])):
            place[new] = len(self.at[side]) + np.arange(len(new))
            self.at[side] = np.append(self.at[side], new - 1)
            got = place[features]
        return got

    def add(self, left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, times: np.ndarray) -> None:
        """Groups with `a` features of `left` and `b` of `right` each, counted `times`."""
        ends = (a * b).cumsum()
        from_a, from_b, k = _starts(a), _starts(b), 0
        left, right = self._places(0, left), self._places(1, right)
        while k < len(a):  # about as many cells at once as CELLS allows
            e = max(k + 1, int(ends.searchsorted((ends[k - 1] if k else 0) + CELLS, "right")))
            self._press(left[from_a[k] : from_a[e]], a[k:e], right[from_b[k] : from_b[e]], b[k:e], times[k:e])
            k = e

    def _press(self, left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, times: np.ndarray) -> None:
        # each left feature of a group meets all right ones of the group
        each = np.repeat(b, a)
        y = right[_inner(np.repeat(b.cumsum() - b, a), each)]
        x, w = np.repeat(left, each), np.repeat(np.repeat(times, a), each)
        rows, cols = len(self.at[0]), len(self.at[1])
        if rows * cols <= 4 * CELLS and not len(self.keys):
            if self.table.shape != (rows, cols):
                grown = np.zeros((rows, cols), np.int64)
                grown[: self.table.shape[0], : self.table.shape[1]] = self.table
                self.table = grown
            self.table += np.bincount(x * cols + y, w, rows * cols).astype(np.int64).reshape(rows, cols)
            return
        if self.table.size:
            i, j = self.table.nonzero()
            self.keys, self.n, self.table = (i << 20) | j, self.table[i, j], np.zeros((0, 0), np.int64)
        keys, inverse = np.unique(np.concatenate([self.keys, (x << 20) | y]), return_inverse=True)
        self.n = np.bincount(inverse, np.concatenate([self.n, w])).astype(np.int64)
        self.keys = keys

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of both sides (-1: none) and counts."""
        i, j = self.table.nonzero() if self.table.size else (self.keys >> 20, self.keys & 0xFFFFF)
        n = self.table[i, j] if self.table.size else self.n
        return self.at[0].astype(np.int32)[i], self.at[1].astype(np.int32)[j], n


def _members(groups: np.ndarray, sentences: np.ndarray, at: np.ndarray, features: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different features of each of n groups as `_Sums` has them, 0 first, and how many a group has."""
    sizes = at[sentences + 1] - at[sentences]
    own = np.repeat(groups, sizes) << 17 | features[_inner(at[sentences], sizes)].astype(np.int64) + 1
    keys = np.unique(np.concatenate([np.arange(n) << 17, own]))
    return keys & 0x1FFFF, np.bincount(keys >> 17, minlength=n)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often features stand on both sides of a group; -1 on one side counts the other side alone.

    Sums so far are given away whenever they pass CELLS, so memory doesn't grow with the texts.
    """
    sums: dict[str, _Sums] = defaultdict(_Sums)

    def given() -> Iterator[pa.RecordBatch]:
        for p, one in sums.items():
            s, t, n = one.cells()
            yield pa.RecordBatch.from_arrays([pa.array([p] * len(n)), pa.array(s), pa.array(t), pa.array(n)], names=["pair", "s", "t", "n"])
        sums.clear()

    for batch in batches:
        r = Read(batch)
        times = r.batch.column("ids").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        for pair, rows in r.pairs("counted"):
            (left, of_left), (right, of_right) = r.numbers("left", 2, rows), r.numbers("right", 2, rows)
            # groups of a text are numbered from 0 on
            many = np.zeros(r.size, np.int64)
            np.maximum.at(many, of_left, left[:, 0] + 1)
            first = _starts(many)
            total = int(first[-1])
            u, a = _members(first[of_left] + left[:, 0], r.m_at[of_left] + left[:, 1], r.s_at, r.s, total)
            v, b = _members(first[of_right] + right[:, 0], r.n_at[of_right] + right[:, 1], r.t_at, r.t, total)
            sums[pair].add(u, a, v, b, np.repeat(times, many))
        if sum(max(x.table.size // 4, len(x.keys)) for x in sums.values()) >= CELLS:
            yield from given()
    yield from given()


def lexicon(texts: DataFrame) -> dict[str, tuple]:
    """Dice tables by language pair, from all pairs of `texts` (src, tgt)."""
    return dice_tables(read(texts.select(F.lit(0).cast("bigint").alias("row_id"), F.lit(None).cast("string").alias("lang"), "src", "tgt")))


def dice_tables(texts: DataFrame) -> dict[str, tuple]:
    """The same from what `read` gives.

    What reaches the driver is bounded by the hashed features, and by their cells of LEAST_DICE or more.
    """
    # a part for each core at most, as every part gives all cells that it has met
    some = texts.where("counted").coalesce(texts.sparkSession.sparkContext.defaultParallelism)
    n = some.mapInArrow(_counts, "pair string, s int, t int, n bigint").groupBy("pair", "s", "t").agg(F.sum("n").alias("n"))
    n = checkpointed(n)
    ns = n.where("t < 0 and s >= 0").select("pair", F.col("s").alias("f"), "n")
    nt = n.where("s < 0 and t >= 0").select("pair", F.col("t").alias("f"), "n")
    cells = (
        n.where("s >= 0 and t >= 0")
        .join(ns.select("pair", F.col("f").alias("s"), F.col("n").alias("ns")), ["pair", "s"])
        .join(nt.select("pair", F.col("f").alias("t"), F.col("n").alias("nt")), ["pair", "t"])
        .withColumn("dice", (2 * F.col("n") / (F.col("ns") + F.col("nt"))).cast("float"))
        .where(F.col("dice") >= LEAST_DICE)
        .select("pair", "s", "t", "dice")
    )
    ns, nt, cells = (x.toArrow().to_pandas() for x in (ns, nt, cells))
    totals = {r.pair: r.n for r in n.where("s < 0 and t < 0").collect()}
    out = {}
    for p, total in totals.items():
        rows, cols = (x[x.pair == p].sort_values(["n", "f"], ascending=[False, True]) for x in (ns, nt))
        both = cells[cells.pair == p]
        si, ti = Index(rows.f.tolist()), Index(cols.f.tolist())
        dice = np.minimum(1.0, both.dice.to_numpy() * np.float32(1.25)).astype(np.float32)
        dice = Cells(both.s.map(si.place).to_numpy(int), both.t.map(ti.place).to_numpy(int), dice, si.none, ti.none)
        # a feature of nearly every sentence tells little
        weight = np.log(1 + total / (1 + np.append(cols.n.to_numpy(), 0))).astype(np.float32)
        weight[-1] = 0.0
        # with a well-filled lexicon, a feature it lacks speaks against any source sentence
        unknown = np.float32(min(3.0, 0.5 + total / 400))
        out[p] = (si, ti, dice, np.where(weight > 0, weight, unknown).astype(np.float32))
    return out


@dataclass(frozen=True)
class Model:
    """What the hidden Markov model has learnt: chances of null, of spans, of texts without any pair, of jumps (by JUMPS), of likenesses and additions."""

    null: float
    span: float
    bare: float  # of a text none of whose sentences is a translation
    jumps: np.ndarray
    like: np.ndarray  # of a state's source to what it emits
    unlike: np.ndarray  # of any other source
    adds: np.ndarray  # what the weaker sentence of a span adds, if the span is the state
    idle: np.ndarray  # and if one of its sentences alone is


#: Jumps from the last sentence reached: far back, one back, again, the next, over one, far on.
JUMPS = (-2, -1, 0, 1, 2, 3)
START = Model(
    0.03, 0.03, 0.02, np.array([0.01, 0.02, 0.04, 0.88, 0.04, 0.01]),
    np.repeat([0.01, 0.01, 0.02, 0.03, 0.05, 0.08, 0.11, 0.15, 0.2, 0.18, 0.1, 0.06], 3) / 3, np.repeat([0.4, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04, 0.025, 0.015, 0.007, 0.002, 0.001], 3) / 3,
    # a span whose weaker sentence adds nothing is none
    np.array([0.0, 0.05, 0.1, 0.15, 0.3, 0.4]), np.array([0.75, 0.12, 0.06, 0.04, 0.02, 0.01]),
)


def _placed(features: np.ndarray, at: np.ndarray, sentences_at: np.ndarray, rows: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the features of some texts, with one that the lexicon lacks for a sentence without any; where each sentence's begin, and each text's."""
    count = sentences_at[rows + 1] - sentences_at[rows]
    sentences = _inner(sentences_at[rows], count)
    sizes = at[sentences + 1] - at[sentences]
    held = np.maximum(sizes, 1)
    begin = _starts(held)
    ids = np.full(begin[-1], index.none)
    ids[_inner(begin[:-1], sizes)] = index.of[features[_inner(at[sentences], sizes)]]
    return ids, begin, begin[_starts(count)]


def _likened(r: Read, rows: np.ndarray, table: tuple | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For texts of one shape at a time: their rows, the likeness of every state and target sentence (size, 2 m - 1, n), between
    0 and 1 and below 0 where nothing is known, and the weight of each target sentence (size, n)."""
    m, n = r.m[rows], r.n[rows]
    at = _starts((2 * m - 1) * n)  # of each text's states and target sentences
    m_at, n_at = _starts(m), _starts(n)  # of each text's sentences
    got, total = np.zeros(at[-1]), np.zeros(n_at[-1])
    known_s, known_t = np.zeros(m_at[-1], bool), np.zeros(n_at[-1], bool)
    if table is not None:
        s_index, t_index, dice, weights = table
        s_ids, s_at, s_first = _placed(r.s, r.s_at, r.m_at, rows, s_index)
        t_ids, t_at, t_first = _placed(r.t, r.t_at, r.n_at, rows, t_index)
        w = weights[t_ids]
        total += np.add.reduceat(w, t_at[:-1])
        known_s = np.maximum.reduceat(s_ids != s_index.none, s_at[:-1])
        known_t = np.maximum.reduceat(t_ids != t_index.none, t_at[:-1])
        own_rows, own_cols = dice.rows(s_ids), dice.cols(t_ids)
        # where sentences begin in their text
        s_in, t_in = s_at[:-1] - np.repeat(s_first[:-1], m), t_at[:-1] - np.repeat(t_first[:-1], n)
        bounds = (x.tolist() for x in (at, m_at, n_at, s_first, t_first))
        for (g, g_end), (i, i_end), (j, j_end), (x, x_end), (y, y_end) in zip(*map(pairwise, bounds), strict=True):
            k, ids, jds, cols, source = i_end - i, s_ids[x:x_end], t_ids[y:y_end], own_cols[y:y_end], s_in[i:i_end]
            v = np.empty((2 * k - 1, y_end - y), np.float32)
            if len(ids) * len(jds) <= BLOCK:
                np.maximum.reduceat(dice.of(own_rows[x:x_end], ids, cols, jds), source, axis=0, out=v[:k])
            else:  # long texts: a source sentence at a time
                for z, (b, e) in enumerate(pairwise([*source.tolist(), len(ids)])):
                    v[z] = dice.of(own_rows[x + b : x + e], ids[b:e], cols, jds).max(0)
            if k > 1:
                np.maximum(v[: k - 1], v[1:k], out=v[k:])
            v *= w[y:y_end]
            got[g:g_end] = np.add.reduceat(v, t_in[j:j_end], axis=1).ravel()
    (anchors, of) = r.numbers("shared", 3, rows)
    if len(anchors):
        (j, i, k), of = anchors.T, rows.searchsorted(of)
        w = ANCHOR * np.log(1 + (m[of] + 1) / (0.5 + np.abs(k)))
        np.add.at(total, (n_at[of] + j)[k > 0], w[k > 0])
        np.add.at(got, at[of] + i * n[of] + j, w)
        # a span has an anchor once, if both of its sentences have it
        both = np.append(False, (k[1:] < 0) & (i[1:] == i[:-1] + 1))
        for span, ok in ((i, i < m[of] - 1), (i - 1, (i > 0) & ~both)):
            np.add.at(got, (at[of] + (m[of] + span) * n[of] + j)[ok], w[ok])
    shapes: dict[tuple[int, int], list[int]] = {}
    for k, shape in enumerate(zip(m.tolist(), n.tolist(), strict=True)):
        shapes.setdefault(shape, []).append(k)
    for (x, y), own in shapes.items():
        few = max(1, BLOCK // (2 * x * y))
        for k in range(0, len(own), few):
            some = np.array(own[k : k + few])
            e = got[at[some][:, None] + np.arange((2 * x - 1) * y)].reshape(-1, 2 * x - 1, y)
            weight = total[n_at[some][:, None] + np.arange(y)]
            # nothing is known of sentences without a feature that the lexicon has
            by_s, by_t = known_s[m_at[some][:, None] + np.arange(x)], known_t[n_at[some][:, None] + np.arange(y)]
            blind = ~(np.concatenate([by_s, by_s[:, :-1] | by_s[:, 1:]], axis=1)[:, :, None] & by_t[:, None, :])
            yield rows[some], np.where(blind & (e <= 0), -1.0, e / np.maximum(weight, 1e-6)[:, None, :]), weight


def _emissions(a: Side, b: Side, pair: str, table: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """Likeness of every state (rows) and target sentence (columns), and the weight of each target sentence, of one pair of texts."""
    _, e, total = next(_likened(Read(_read_batch([_read_row(a, b, False, True, [0])])), np.zeros(1, int), table))
    return e[0], total[0]


def _stepped(e: np.ndarray, total: np.ndarray, m: int) -> np.ndarray:
    """Likenesses of sources, then of spans, then what spans add, as steps; of each all sources by target sentence. A row for each text."""
    like = np.where(e < 0, UNKNOWN, LIKE.searchsorted(e, "right") * (len(SIZES) + 1) + SIZES.searchsorted(total)[:, None, :])
    adds = ADDED.searchsorted(e[:, m:] - np.maximum(e[:, : m - 1], e[:, 1:m]), "right")
    return np.concatenate([x.astype(np.uint8).transpose(0, 2, 1).reshape(len(e), -1) for x in (like[:, :m], like[:, m:], adds)], axis=1)


def _steps(likeness: tuple[np.ndarray, np.ndarray], m: int) -> bytes:
    """The same for one text."""
    e, total = likeness
    return _stepped(e[None], total[None], m).tobytes()


class Trellis:
    """Texts of one shape, m source and n target sentences, under a model. Places go from 0 (nothing reached) to m."""

    def __init__(self, steps: list[bytes], m: int, n: int, model: Model) -> None:
        self.m, self.n, self.model, self.size = m, n, model, len(steps)
        both = np.frombuffer(b"".join(steps), np.uint8).reshape(len(steps), -1)
        self.like = both[:, : n * m].reshape(self.size, n, m)
        self.span_like = both[:, n * m : n * (2 * m - 1)].reshape(self.size, n, m - 1)
        self.adds = both[:, n * (2 * m - 1) :].reshape(self.size, n, m - 1)
        odds = np.append(model.like / model.unlike, 1.0)
        one = (1 - model.null) * (1 - model.span)
        two = (1 - model.null) * model.span
        self.single = one * odds[self.like]
        self.span = two * odds[self.span_like] * (model.adds / model.idle)[self.adds]
        # far jumps go to any of m sentences
        # the way that reaches nothing is worth what texts without pairs are
        self.bare = model.bare / (1 - model.bare) * math.exp(min(600.0, -n * math.log(model.null)))
        self.counted = (1 - UNIFORM) * model.jumps / np.array([m, 1, 1, 1, 1, m])
        self.jump = self.counted + UNIFORM / m

    def reach(self, before: np.ndarray, top: bool = False) -> np.ndarray:
        """Chance of coming to each source sentence from places `before` (size, m + 1): summed, or of the best way."""
        m, (back, last, again, following, over, far) = self.m, self.jump
        mix = np.maximum if top else np.add
        out = before[:, :m] * following
        out = mix(out, before[:, 1:] * again)
        if m > 1:
            out[:, 1:] = mix(out[:, 1:], before[:, : m - 1] * over)
            out[:, : m - 1] = mix(out[:, : m - 1], before[:, 2:] * last)
        if m > 2:
            run = mix.accumulate(before, axis=1)
            out[:, 2:] = mix(out[:, 2:], run[:, : m - 2] * far)
            run = mix.accumulate(before[:, ::-1], axis=1)[:, ::-1]
            out[:, : m - 2] = mix(out[:, : m - 2], run[:, 3:] * back)
        return out

    def leave(self, ahead: np.ndarray) -> np.ndarray:
        """The same the other way round: from each place, the chance of all that follows, given that of each source sentence."""
        m, (back, last, again, following, over, far) = self.m, self.jump
        out = np.zeros((len(ahead), m + 1))
        out[:, :m] += ahead * following
        out[:, 1:] += ahead * again
        if m > 1:
            out[:, : m - 1] += ahead[:, 1:] * over
            out[:, 2:] += ahead[:, : m - 1] * last
        if m > 2:
            out[:, : m - 2] += ahead[:, ::-1].cumsum(1)[:, ::-1][:, 2:] * far
            out[:, 3:] += ahead.cumsum(1)[:, : m - 2] * back
        return out

    def forward(self, top: bool = False) -> np.ndarray:
        """(n + 1, size, m + 1): chance of each place after each target sentence, scaled to add up to 1 (or to 1 at most)."""
        mix = np.maximum if top else np.add
        a = np.zeros((self.n + 1, self.size, self.m + 1))
        a[0, :, 0] = 1.0
        for j in range(self.n):
            came = self.reach(a[j], top)
            now = a[j] * self.model.null
            now[:, 1:] = mix(now[:, 1:], came * self.single[:, j])
            if self.m > 1:
                now[:, 2:] = mix(now[:, 2:], came[:, :-1] * self.span[:, j])
            a[j + 1] = now / (now.max(1) if top else now.sum(1))[:, None]
        a[-1, :, 0] *= self.bare
        return a

    def paths(self) -> np.ndarray:
        """(size, n, 2): first and last source sentence of the best state of each target sentence; -1, -1 for null."""
        a, who = self.forward(top=True), np.arange(self.size)
        out = np.full((self.size, self.n, 2), -1)
        place = a[-1].argmax(1)
        for j in range(self.n - 1, -1, -1):
            before = a[j]
            choices = [before[who, place] * self.model.null]
            froms = [place]
            for width in (1, 2):  # a single sentence, a span of two
                first = place - width  # 0-based
                d = first[:, None] + 1 - np.arange(self.m + 1)[None, :]
                ways = before * self.jump[np.clip(d, -2, 3) + 2]
                best = ways.argmax(1)
                emitted = self.single[:, j] if width == 1 else self.span[:, j]
                ok = (first >= 0) & (first < emitted.shape[1])
                chance = emitted[who, np.where(ok, first, 0)] if emitted.shape[1] else np.zeros(self.size)
                choices.append(np.where(ok, ways[who, best] * chance, -1.0))
                froms.append(best)
            kind = np.stack(choices).argmax(0)
            out[:, j, 0] = np.where(kind > 0, place - kind, -1)
            out[:, j, 1] = np.where(kind > 0, place - 1, -1)
            place = np.stack(froms)[kind, who]
        return out

    def expected(self, times: np.ndarray) -> dict[str, np.ndarray]:
        """Expected counts of all that the model estimates; texts count `times`."""
        m, a = self.m, self.forward()
        got = {k: np.zeros(2 if isinstance(x, float) else len(x)) for k, x in vars(START).items()}
        bare = a[-1, :, 0] / a[-1].sum(1) * times
        got["bare"] += bare.sum(), times.sum()
        got["null"] -= bare.sum() * self.n  # what texts without pairs have isn't added
        after = np.ones((self.size, m + 1))
        after[:, 0] = self.bare
        for j in range(self.n - 1, -1, -1):
            before = a[j]
            came = self.reach(before)
            one = came * self.single[:, j] * after[:, 1:]
            two = came[:, :-1] * self.span[:, j] * after[:, 2:]
            none = before * self.model.null * after
            scale = times / (one.sum(1) + two.sum(1) + none.sum(1))
            one, two, none = one * scale[:, None], two * scale[:, None], none.sum(1) * scale
            got["null"] += none.sum(), times.sum()
            got["span"] += two.sum(), one.sum() + two.sum()
            like, wide, adds = self.like[:, j].ravel(), self.span_like[:, j].ravel(), self.adds[:, j].ravel()
            size = UNKNOWN + 1
            got["like"] += (np.bincount(like, one.ravel(), size) + np.bincount(wide, two.ravel(), size))[:-1]
            covered = one.copy()
            if m > 1:
                covered[:, :-1] += two
                covered[:, 1:] += two
                got["adds"] += np.bincount(adds, two.ravel(), len(ADDED) + 1)
                got["idle"] += np.bincount(adds, (one[:, :-1] + one[:, 1:]).ravel(), len(ADDED) + 1)
            got["unlike"] += np.bincount(like, np.maximum(times[:, None] - covered, 0).ravel(), size)[:-1]
            ahead = self.single[:, j] * after[:, 1:]
            if m > 1:
                ahead[:, :-1] += self.span[:, j] * after[:, 2:]
            x = ahead * scale[:, None]
            back, last, again, following, over, far = self.counted
            got["jumps"][3] += (before[:, :m] * x).sum() * following
            got["jumps"][2] += (before[:, 1:] * x).sum() * again
            if m > 1:
                got["jumps"][4] += (before[:, : m - 1] * x[:, 1:]).sum() * over
                got["jumps"][1] += (before[:, 2:] * x[:, : m - 1]).sum() * last
            if m > 2:
                got["jumps"][5] += (before.cumsum(1)[:, : m - 2] * x[:, 2:]).sum() * far
                got["jumps"][0] += (before[:, ::-1].cumsum(1)[:, ::-1][:, 3:] * x[:, : m - 2]).sum() * back
            after = self.leave(ahead) + after * self.model.null
            after /= after.max(1)[:, None]
        return got


def estimated(counts: dict[str, np.ndarray]) -> Model:
    """The model of expected counts, with PSEUDO sentences that are as START says."""
    share = lambda k: (counts[k][0] + PSEUDO * getattr(START, k)) / (counts[k][1] + PSEUDO)
    rates = lambda k: (counts[k] + PSEUDO * getattr(START, k)) / (counts[k].sum() + PSEUDO * getattr(START, k).sum())
    kept = lambda k: (1 - DOUBT) * rates(k) + DOUBT * getattr(START, k)
    return Model(*(float(share(k)) for k in ("null", "span", "bare")), rates("jumps"), kept("like"), kept("unlike"), rates("adds"), rates("idle"))


def _pairs(path: np.ndarray, src: list[int], tgt: list[int]) -> list[tuple[int, int]]:
    return [(src[i], tgt[j]) for j, (first, last) in enumerate(path.tolist()) if first >= 0 for i in range(first, last + 1)]


def align(a: Side, b: Side, lex: dict[str, tuple], model: Model = START) -> list[tuple[int, int]]:
    """Pairs of (start of a source sentence, start of a target sentence)."""
    m, n = len(a.spans), len(b.spans)
    if not m or not n:
        return []
    pair = f"{a.lang}>{b.lang}"
    steps = _steps(_emissions(a, b, pair, lex.get(pair)), m)
    return _pairs(Trellis([steps], m, n, model).paths()[0], [x for x, _ in a.spans], [x for x, _ in b.spans])


_LIKENESS = "ids array<bigint>, m int, n int, src array<int>, tgt array<int>, steps binary"


def _likeness(lex):
    """For each row of `read` its translations, where sentences begin, and their likenesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, steps = Read(batch), [b""] * batch.num_rows
            for pair, rows in r.pairs("kept"):
                for some, e, total in _likened(r, rows, lex.value.get(pair)):
                    for k, x in zip(some.tolist(), _stepped(e, total, (e.shape[1] + 1) // 2), strict=True):
                        steps[k] = x.tobytes()
            kept = (batch.column("ids"), pa.array(r.m, pa.int32()), pa.array(r.n, pa.int32()), batch.column("src"), batch.column("tgt"))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(steps, pa.binary())], names=["ids", "m", "n", "src", "tgt", "steps"])

    return run


def _trellises(batch: pa.RecordBatch, model: Model) -> Iterator[tuple[list[list[int]], Trellis]]:
    """The different likenesses of a batch by shape, as many at once as BLOCK allows: the rows of each, and their trellis."""
    shapes: dict[tuple[int, int], list[tuple[bytes, list[int]]]] = {}
    for (m, n, steps), rows in _once(batch, "m", "n", "steps").items():
        shapes.setdefault((m, n), []).append((steps, rows))
    for (m, n), own in shapes.items():
        few = max(1, BLOCK // (m * n))
        for k in range(0, len(own), few):
            some = own[k : k + few]
            yield [rows for _, rows in some], Trellis([steps for steps, _ in some], m, n, model)


def _expected(model: Model):
    """Sums over all texts; equal likenesses are held, up to half a BLOCK of different ones, and worked on once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        held: dict[tuple[int, int], dict[bytes, int]] = defaultdict(dict)

        def add_up() -> None:
            for (m, n), own in held.items():
                steps, times, few = list(own), np.array(list(own.values()), float), max(1, BLOCK // (m * n))
                for k in range(0, len(steps), few):
                    for what, x in Trellis(steps[k : k + few], m, n, model).expected(times[k : k + few]).items():
                        total[what] = total.get(what, 0) + x
            held.clear()

        size = 0
        for batch in batches:
            for m, n, steps, times in zip(*(batch.column(c).to_pylist() for c in ("m", "n", "steps", "times")), strict=True):
                own = held[m, n]
                if (before := own.get(steps)) is None:
                    before, size = 0, size + len(steps)
                own[steps] = before + times
            if size > BLOCK // 2:
                add_up()
                size = 0
        add_up()
        flat = [(k, i, float(y)) for k, x in total.items() for i, y in enumerate(x)]
        cols = list(zip(*flat, strict=True)) if flat else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.float64()), strict=True)], names=["what", "i", "x"])

    return run


def learnt(likeness: DataFrame) -> Model:
    """The model estimated from all texts; a few dozen sums reach the driver in each round."""
    model = START
    # a part for each core at most: equal likenesses meet, and what is done by shape is done for more texts at once
    slim = likeness.select("m", "n", "steps", F.size("ids").alias("times")).coalesce(likeness.sparkSession.sparkContext.defaultParallelism)
    for _ in range(ROUNDS):
        sums = slim.mapInArrow(_expected(model), "what string, i int, x double").groupBy("what", "i").agg(F.sum("x").alias("x")).collect()
        if not sums:
            break
        counts = {k: np.zeros(1 + max(r.i for r in sums if r.what == k)) for k in {r.what for r in sums}}
        for r in sums:
            counts[r.what][r.i] = r.x
        model = estimated(counts)
    return model


def _decoder(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "src", "tgt")}
            many = {c: batch.column(c).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in flat}
            at = {c: _starts(x) for c, x in many.items()}
            texts, src, tgt = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)]
            for rows, trellis in _trellises(batch, model):
                path = np.repeat(trellis.paths(), [len(own) for own in rows], axis=0)
                row = np.array([i for own in rows for i in own])
                k, j = (path[:, :, 0] >= 0).nonzero()
                first, last = path[k, j].T
                for i, who in ((first, slice(None)), (last, last > first)):
                    text = row[k[who]]
                    texts.append(text)
                    src.append(flat["src"][at["src"][text] + i[who]])
                    tgt.append(flat["tgt"][at["tgt"][text] + j[who]])
            text = np.concatenate(texts)
            times = many["ids"][text]
            ids = flat["ids"][_inner(at["ids"][text], times)]
            cols = (pa.array(ids, pa.int64()), *(pa.array(np.repeat(np.concatenate(x), times), pa.int32()) for x in (src, tgt)))
            yield pa.RecordBatch.from_arrays(list(cols), names=["translation_id", "src_start", "tgt_start"])

    return run


def aligned(texts: DataFrame) -> DataFrame:
    """(translation_id, src_start, tgt_start) of `texts` (row_id, lang, src, tgt)."""
    texts = read(texts.where(F.col("src").isNotNull() & F.col("tgt").isNotNull()))
    lex = texts.sparkSession.sparkContext.broadcast(dice_tables(texts))
    likeness = checkpointed(texts.where("kept").mapInArrow(_likeness(lex), _LIKENESS))
    return likeness.mapInArrow(_decoder(learnt(likeness)), "translation_id bigint, src_start int, tgt_start int").distinct()
