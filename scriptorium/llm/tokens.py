"""Encoding with a public byte-level BPE vocabulary, by a pair occurrence index.

All words of a batch are encoded together. Their bytes stand in one list, each symbol linked to its
neighbours; an index maps each adjacent pair to all its positions. The active ranks are applied in ascending
order: all occurrences of the lowest pair are merged from left to right, and the lists of the pairs to their
left and right are updated. Words that were encoded before are looked up.

The vocabulary file is a parameter; the driver reads it and sends its bytes (under MOST_BYTES, which is
checked) to the executors.

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary
text; lone surrogates can't occur in a string column.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How the vocabulary's makers cut text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_BYTES = 64 << 20
FOLDER = "/opt/tokenizers"
KEPT_WORDS = 500_000


def read_vocabulary(path: str) -> bytes:
    """The bytes of a .tiktoken or .json vocabulary file."""
    data = Path(path).read_bytes()
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes, more than is sent to executors")
    return data


def _byte_letters() -> dict[str, int]:
    """Which byte each letter of a byte-level JSON vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in shown]
    letters.update({chr(256 + i): b for i, b in enumerate(hidden)})
    return letters


def parse_vocabulary(data: bytes) -> dict[bytes, int]:
    """Token bytes to ids, from the tiktoken format or a byte-level JSON file."""
    if data[:1] == b"{":
        vocab = json.loads(data)["model"]["vocab"]
        letters = _byte_letters()
        return {bytes(letters[c] for c in k): v for k, v in vocab.items() if all(c in letters for c in k)}
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Encoder:
    """Encodes lists of texts; keeps the ids of the words it has met."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.known: dict[str, list[int]] = {}
        self.words = regex.compile(WORDS)

    def _rank(self, pair: tuple[int, int]) -> int:
        """The id, which is the rank, of the merge of a pair; -1 where there is none."""
        r = self.pair_rank.get(pair)
        if r is None:
            r = self.pair_rank[pair] = self.ranks.get(self.bytes_of[pair[0]] + self.bytes_of[pair[1]], -1)
        return r

    def _merge(self, words: list[str]) -> None:
        """Encodes distinct words together by the pair occurrence index."""
        symbol: list[int] = []
        before: list[int] = []
        after: list[int] = []
        first: list[int] = []
        for w in words:
            raw = w.encode("utf-8")
            whole = self.ranks.get(raw)
            start = len(symbol)
            first.append(start)
            ids = [whole] if whole is not None else [self.single[b] for b in raw]
            n = len(ids)
            symbol += ids
            before += [-1, *range(start, start + n - 1)]
            after += [*range(start + 1, start + n), -1]
        index: dict[int, set[int]] = {}
        rank = self._rank
        for i, j in enumerate(after):
            if j >= 0 and (r := rank((symbol[i], symbol[j]))) >= 0:
                index.setdefault(r, set()).add(i)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r, None)
            if not places:
                continue
            for i in sorted(places):
                j = after[i]
                # the pair may be gone since: one of its symbols was merged with another neighbour
                if symbol[i] < 0 or j < 0 or rank((symbol[i], symbol[j])) != r:
                    continue
                k, h = after[j], before[i]
                symbol[i], symbol[j], after[i] = r, -1, k
                if k >= 0:
                    before[k] = i
                for left, right in ((h, i), (i, k)):
                    if left >= 0 and right >= 0:
                        s = rank((symbol[left], symbol[right]))
                        if s >= 0:
                            at = index.get(s)
                            if at is None:
                                at = index[s] = set()
                                heapq.heappush(heap, s)
                            at.add(left)
        for w, i in zip(words, first, strict=True):
            ids = []
            while i >= 0:
                ids.append(symbol[i])
                i = after[i]
            self.known[w] = ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        cut = [self.words.findall(t) if t else [] for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        fresh = list(dict.fromkeys(w for ws in cut for w in ws if w not in self.known))
        for i in range(0, len(fresh), 20_000):
            self._merge(fresh[i : i + 20_000])
        known = self.known
        out = []
        for ws in cut:
            ids: list[int] = []
            for w in ws:
                ids += known[w]
            out.append(ids)
        return out


def _send(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_vocabulary(path))


def encode(df: DataFrame, keys: list[str], text: str, path: str) -> DataFrame:
    """The keys and `ids`, the list of token ids of each text."""
    sent = _send(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(parse_vocabulary(sent.value))
        for batch in batches:
            n = batch.num_columns - 1
            ids = encoder.encode(batch.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names[:n], "ids"]
            )

    slim = df.select(*keys, F.col(text).alias("_text"))
    schema = ", ".join(f"`{k}` {t}" for k, t in slim.dtypes[:-1]) + ", ids array<int>"
    return slim.mapInArrow(run, schema)


def count_tokens(df: DataFrame, keys: list[str], text: str, path: str) -> DataFrame:
    """The keys and `tokens`, the number of token ids of each text."""
    sent = _send(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(parse_vocabulary(sent.value))
        for batch in batches:
            n = batch.num_columns - 1
            sizes = [len(x) for x in encoder.encode(batch.column(n).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:n], "tokens"]
            )

    slim = df.select(*keys, F.col(text).alias("_text"))
    schema = ", ".join(f"`{k}` {t}" for k, t in slim.dtypes[:-1]) + ", tokens bigint"
    return slim.mapInArrow(run, schema)
