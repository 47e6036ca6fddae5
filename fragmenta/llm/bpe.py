"""Byte-level BPE encoding of a corpus by merge replay.

Texts are split by the vocabulary's pattern into words. The distinct words of a
block of the corpus are laid out as one array of symbols with an inverted index from
symbol pair to the positions where it stands; the merges are then applied in rank
order, each to all its positions at once, and only the two neighbours of a merged
position get new index entries. Work is in proportion to the distinct words, not to
the text, and nothing is shuffled: a block is what a task has read so far, words
that it has met before are looked up.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie; every function takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of encoded words that a task remembers; beyond it the memory starts anew.
MEMORY_BYTES = 64_000_000

_END = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a rank file; the rank is the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes blocks of words with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.base = [ranks[bytes([b])] for b in range(256)]
        self._merged: dict[tuple[int, int], int] = {}

    def merged(self, pair: tuple[int, int]) -> int:
        """The id that a pair of ids becomes, or -1."""
        known = self._merged.get(pair)
        if known is None:
            known = self._merged[pair] = self.ranks.get(self.token[pair[0]] + self.token[pair[1]], -1)
        return known

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        base = self.base
        symbol: list[int] = [_END]
        begins = []
        for word in words:
            begins.append(len(symbol))
            symbol.extend([base[b] for b in word])
            symbol.append(_END)
        size = len(symbol)
        before = list(range(-1, size - 1))
        after = list(range(1, size + 1))
        where: dict[tuple[int, int], list[int]] = {}
        heap: list[tuple[int, tuple[int, int]]] = []

        def note(left: int, pair: tuple[int, int]) -> None:
            at = where.get(pair)
            if at is not None:
                at.append(left)
            elif (new := self.merged(pair)) >= 0:
                where[pair] = [left]
                heapq.heappush(heap, (new, pair))

        previous = _END
        for i, s in enumerate(symbol):
            if s >= 0 and previous >= 0:
                note(i - 1, (previous, s))
            previous = s
        while heap:
            new, pair = heapq.heappop(heap)
            positions = where.pop(pair)
            positions.sort()
            left, right = pair
            for i in positions:
                j = after[i]
                # An earlier merge may have taken either side.
                if symbol[i] != left or j >= size or symbol[j] != right:
                    continue
                symbol[i], symbol[j] = new, -2
                k = after[i] = after[j]
                before[k] = i
                h = before[i]
                if symbol[h] >= 0:
                    note(h, (symbol[h], new))
                if symbol[k] >= 0:
                    note(i, (new, symbol[k]))
        out = []
        for begin in begins:
            ids, i = [], begin
            while symbol[i] != _END:
                ids.append(symbol[i])
                i = after[i]
            out.append(ids)
        return out


class CorpusEncoder:
    """Splits texts and keeps the ids of the words met so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, memory_bytes: int = MEMORY_BYTES):
        self.replay = MergeReplay(ranks)
        self.split = regex.compile(pattern).findall
        self.memory_bytes = memory_bytes
        self.known: dict[str, list[int]] = {}
        self.used = 0

    def __call__(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; none for null and empty texts."""
        split = [self.split(t) if t else [] for t in texts]
        if self.used > self.memory_bytes:
            self.known, self.used = {}, 0
        fresh = list(set(chain.from_iterable(split)) - self.known.keys())
        if fresh:
            coded = [w.encode("utf-8", "surrogatepass") for w in fresh]
            self.known.update(zip(fresh, self.replay.encode(coded)))
            self.used += sum(map(len, coded)) + 100 * len(coded)
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, words))) for words in split]


def _encoder(data) -> CorpusEncoder:
    ranks, pattern = data.value
    return CorpusEncoder(ranks, pattern)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``(<id_col>, ids ARRAY<INT>)`` of every row, without special tokens.

    Whatever looks like a special token is ordinary text. Null and empty texts give an
    empty list; a row with a null id is kept; repeated rows are encoded each. Only the
    two columns are read. The vocabulary (its size is fixed) is broadcast.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast((read_ranks(vocabulary), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = encoder(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``(<id_col>, n_tokens INT)`` of every row, by the same replay."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast((read_ranks(vocabulary), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n = [len(x) for x in encoder(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int32())], ["id", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens int").withColumnRenamed("id", id_col)
