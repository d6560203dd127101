"""Byte-level byte-pair encoding with a public vocabulary, and its inverse."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that splits text before the merges of these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words remembered per Python worker, and the longest word worth remembering.
CACHE_WORDS, CACHE_CHARS = 400_000, 64


class BytePairEncoder:
    """Encodes by the ranks of a vocabulary file (base64 token, rank per line)."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.strings: dict[int, bytes] = {}
        for token, rank in self.ranks.items():
            self.strings[rank] = token
        self._split = regex.compile(PATTERN).findall
        self._cache: dict[str, tuple[int, ...]] = {}

    def _merge(self, word: bytes) -> tuple[int, ...]:
        """Merges the best-ranked neighbours first: a heap of candidate pairs over a linked list of symbols.

        A symbol is known by the offset where it begins; ``end`` and ``before`` link it to its neighbours.
        An entry of the heap is stale when one of its two symbols has been merged since, and is skipped.
        """
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return (whole,)
        n = len(word)
        end = list(range(1, n + 1))
        before = list(range(-1, n))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(word[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 1, i + 2))
        heapq.heapify(heap)
        while heap:
            _, left, middle, right = heapq.heappop(heap)
            if end[left] != middle or end[middle] != right:
                continue
            end[left], end[middle] = right, 0
            if right < n:
                before[right] = left
                rank = ranks.get(word[left : end[right]])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, right, end[right]))
            first = before[left]
            if first >= 0:
                rank = ranks.get(word[first:right])
                if rank is not None:
                    heapq.heappush(heap, (rank, first, left, right))
        ids, at = [], 0
        while at < n:
            ids.append(ranks[word[at : end[at]]])
            at = end[at]
        return tuple(ids)

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self._merge(word.encode("utf-8"))
        if len(word) <= CACHE_CHARS:
            if len(self._cache) >= CACHE_WORDS:
                self._cache.clear()
            self._cache[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null and empty texts give an empty list, special tokens are ordinary text."""
        if not text:
            return []
        known = self._cache
        return list(chain.from_iterable([known.get(w) or self._word(w) for w in self._split(text)]))

    def decode(self, ids: list[int]) -> str:
        """The text whose ids these are."""
        return b"".join([self.strings[i] for i in ids]).decode("utf-8", errors="replace")


_LOADED: dict[str, BytePairEncoder] = {}


def encoder(path: str = DEFAULT_VOCABULARY) -> BytePairEncoder:
    """The encoder of a vocabulary file, read once per Python process."""
    if path not in _LOADED:
        if not os.path.exists(path):
            raise FileNotFoundError(f"no vocabulary file at {path} on this machine")
        _LOADED[path] = BytePairEncoder(path)
    return _LOADED[path]


def encode_texts(
    documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """(key, ids) of every row: the token ids of the whole text as array<int>.

    Null and empty texts give an empty list. Repeated rows come out repeatedly, an empty table gives an
    empty table, other columns are ignored. No shuffle: each batch of rows is encoded where it is read.
    The vocabulary file must lie at the same path on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            ids = pa.array([encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(
    documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """(key, n_tokens) of every row; null and empty texts have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            n = pa.array([len(encode(t)) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], [key, "n_tokens"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")


def round_trips(
    documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """(key, n_tokens, same): whether the decoded ids give the text again (null counts as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [model.encode(t) for t in texts]
            same = [model.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(same, pa.bool_())],
                [key, "n_tokens", "same"],
            )

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, same boolean")
