"""Byte-level byte-pair encoding of a whole corpus with a public vocabulary.

A text is split by the vocabulary's pattern; each piece is then merged with a segment tree over the ranks of its adjacent
pairs. The tree's root is the leftmost pair of the lowest rank; a merge changes the pairs of its two neighbours and
empties one leaf, each with logarithmic cost, until no pair can be merged. A piece of n bytes therefore costs
O(n log n) however long it is, so a text is never cut. Distinct pieces are encoded once per worker and kept in a bounded
cache. Texts reach Python as Arrow batches and leave as Arrow lists; no shuffle is needed.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesmith.plans.shipping import ship

#: Fixed value: the pattern that splits a text before the merges of the 50k byte vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Where the vocabulary files lie, unless a path is given.
FOLDER = os.environ.get("LAKESMITH_TOKENIZERS", "/opt/tokenizers")

#: Distinct pieces kept per worker, and the longest piece (in bytes) that is worth keeping.
CACHE_PIECES = 1 << 17
CACHE_BYTES = 64

#: Ids per Arrow batch that leaves a worker.
BATCH_IDS = 1 << 20

_NONE = 1 << 62


class Encoder:
    """Encodes texts to ids; `ranks` maps the bytes of a token to its rank, which is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self._ranks = ranks
        self._split = regex.compile(pattern).findall
        self._cache: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str = PATTERN) -> Encoder:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece. A byte or pair that the vocabulary lacks stays unmerged; every single byte must have a rank."""
        ranks, n = self._ranks, len(piece)
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        size = 1 << (n - 1).bit_length()
        # A leaf holds rank * size + start of the pair that begins there, so the minimum is the leftmost lowest rank.
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            if (rank := ranks.get(piece[i : i + 2])) is not None:
                tree[size + i] = rank * size + i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        end = list(range(1, n + 1))  # end[i]: where the symbol that starts at i ends
        before = list(range(-1, n))  # before[i]: start of the symbol before it

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                best = a if a < b else b
                if tree[k] == best:
                    break
                tree[k] = best
                k >>= 1

        while (least := tree[1]) != _NONE:
            i = least % size
            j = end[i]
            stop = end[i] = end[j]
            put(j, _NONE)
            if stop < n:
                before[stop] = i
                rank = ranks.get(piece[i : end[stop]])
                put(i, _NONE if rank is None else rank * size + i)
            else:
                put(i, _NONE)
            if (h := before[i]) >= 0:
                rank = ranks.get(piece[h:stop])
                put(h, _NONE if rank is None else rank * size + h)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; NULL and '' both give []. Unpaired surrogates are encoded as U+FFFD."""
        ids: list[int] = []
        if not text:
            return ids
        cache = self._cache
        for piece in self._split(text):
            known = cache.get(piece)
            if known is None:
                data = piece.encode("utf-8", "replace") if piece.isascii() else piece.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode()
                known = tuple(self.merge(data))
                if len(data) <= CACHE_BYTES:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = known
            ids += known
        return ids


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder.from_file(path)


def vocabulary(name: str, folder: str = FOLDER) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def ship_vocabulary(spark: SparkSession, path: str) -> str:
    """Has the executors fetch a vocabulary file of the driver; its name among their files."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(key, ids array<int>): one row per document, in the vocabulary's ids without special tokens.

    NULL and empty texts give an empty list; blank and odd characters, and the names of special tokens, are encoded as
    ordinary text. Repeated keys and NULL keys are kept as they are; other columns are never read.
    """
    ship(documents.sparkSession)
    file = ship_vocabulary(documents.sparkSession, vocabulary(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(SparkFiles.get(file)).encode
        for batch in batches:
            keys, first, ends, ids = batch.column(0), 0, [0], []
            for row, value in enumerate(batch.column(1)):
                ids += encode(value.as_py())
                ends.append(len(ids))
                if len(ids) >= BATCH_IDS or row + 1 == batch.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys.slice(first, row + 1 - first), lists], names=["k", "ids"])
                    first, ends, ids = row + 1, [0], []

    source = documents.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    kind = source.schema["k"].dataType.simpleString()
    return source.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(key, tokens int): the length of each document in tokens; only the counts leave the workers."""
    ship(documents.sparkSession)
    file = ship_vocabulary(documents.sparkSession, vocabulary(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(SparkFiles.get(file)).encode
        for batch in batches:
            counts = [len(encode(value.as_py())) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], names=["k", "tokens"])

    source = documents.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    kind = source.schema["k"].dataType.simpleString()
    return source.mapInArrow(run, f"k {kind}, tokens int").withColumnRenamed("k", key)
