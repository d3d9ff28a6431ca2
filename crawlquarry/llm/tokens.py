"""Byte-level BPE encoding of whole corpora with a public vocabulary.

The merge loop of a piece keeps the ranks of its adjacent pairs in a segment tree: the
root is the leftmost pair of lowest rank, a merge changes three leaves, and each change
is carried up in logarithmic time, so that a piece of n bytes takes O(n log n) however
long it is. Pieces recur, hence each worker memoises them in a table of bounded size.

Defined results: null and empty texts give an empty list; the names of special tokens
inside a text are ordinary text; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.session import spread

#: Fixed values of the vocabulary's format: how a text is cut into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in the vocabulary file: itself if printable, else the next code from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


def read_vocabulary(path: str) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(ids of the 256 bytes, merges as (left id, right id, merged id) in rank order) of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return [vocab[c] for c in byte_alphabet()], [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]


class SegmentTreeBPE:
    """Encoder of one vocabulary."""

    def __init__(self, byte_ids: list[int], merges: list[tuple[int, int, int]], most: int = 300_000):
        self.byte_ids = byte_ids
        self.pairs = {(a, b): (rank, merged) for rank, (a, b, merged) in enumerate(merges)}
        self.never = len(merges)
        self.memo: dict[str, list[int]] = {}
        self.most = most
        self.cut = regex.compile(PIECES).findall

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        pairs, never = self.pairs, (self.never, 0)
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        # A leaf holds rank * n + position, so that the least value is the leftmost pair of lowest rank.
        none = self.never * n + n
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = pairs.get((ids[i], ids[i + 1]), never)[0]
            if rank != self.never:
                tree[size + i] = rank * n + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                least = a if a < b else b
                if tree[i] == least:
                    break
                tree[i] = least

        def leaf(i: int) -> int:
            j = after[i]
            if j >= n:
                return none
            rank = pairs.get((ids[i], ids[j]), never)[0]
            return none if rank == self.never else rank * n + i

        while (top := tree[1]) != none:
            i = top % n
            j = after[i]
            ids[i] = pairs[ids[i], ids[j]][1]
            ids[j] = -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if j < n - 1:
                put(j, none)
            put(i, leaf(i)) if i < n - 1 else None
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text."""
        out: list[int] = []
        if not text:
            return out
        memo, extend = self.memo, out.extend
        for piece in self.cut(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "replace"))
                if len(memo) >= self.most:
                    memo.clear()
                if len(piece) <= 64:
                    memo[piece] = ids
            extend(ids)
        return out


#: One encoder for each vocabulary in a worker, kept with its memo from task to task.
_encoders: dict[str, SegmentTreeBPE] = {}


def encode(texts: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): each row of ``texts`` with the ids of its text. ``vocabulary`` is the path of a tokenizer file, read by the driver."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))  # a fixed table of about a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = SegmentTreeBPE(*shared.value)
        encoder = _encoders[vocabulary]
        for batch in batches:
            ids = pa.array([encoder.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = texts.schema[key].dataType.simpleString()
    return spread(texts.select(key, F.col(text)), key).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
