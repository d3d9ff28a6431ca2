"""Evaluation passages inside corpus documents: q-gram filtering with banded alignment.

Both sides are reduced to their words in lower case, joined and framed by single blanks. The items
are a stated query set: they are read in blocks of bounded size, each block is broadcast as plain
text and indexed where it's used, and every document is read against every block.

1. *Probe.* Cut a window of ``min_words`` words of an item into ``edits + 1`` pieces: ``edits`` edits
   leave one of them whole, so a document that holds the window holds every q-gram of that piece.
   The rarest of each piece is looked up for all positions of a batch of documents at once.
2. *Count.* A hit puts the window on a diagonal of the document. The q-grams it shares there are counted in
   the band of ``edits`` diagonals to each side (bands of neighbouring hits overlap); by the q-gram lemma a band
   that holds the window has at least ``w - q + 1 - edits * q``.
3. *Verify.* Bands that meet the bound are aligned with the window by edit distance inside the band.
4. *Align.* The diagonals of verified windows are aligned locally with the whole item in their band.
5. The exact check: the longest run of equal consecutive words in both.

Every step works on all hits of a batch of documents together.

Defined results: null, empty and wordless texts give no rows; repeated rows of a document or an
item give one row a pair; items under ``min_words`` words can't be found; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.llm.words import WORD
from crawlquarry.session import spread

_BASE = np.uint64(0x100000001B3)


def normal(text: str | None) -> str:
    """The words of a text in lower case, joined by blanks."""
    return " ".join(WORD.findall(text.lower())) if text else ""


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each position of an array of code points, by doubling: grams of 1, 2, 4, ... are joined."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h, size, whole, done = codes, 1, None, 0
        left = q
        while left:
            if left & 1:
                part = h[done : done + n]
                whole = part if whole is None else whole * (_BASE ** np.uint64(size)) + part
                done += size
            left >>= 1
            if left:
                h = h[:-size] * (_BASE ** np.uint64(size)) + h[size:]
                size *= 2
        whole = whole ^ (whole >> np.uint64(29))
        whole = whole * np.uint64(0xBF58476D1CE4E5B9)
        return whole ^ (whole >> np.uint64(32))


def _clip(at: np.ndarray, low: int, high: int) -> np.ndarray:
    return np.minimum(np.maximum(at, low), high)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


#: Hits that are counted and verified together; bounds the memory of a batch.
_CHUNK = 8_192


class ItemIndex:
    """Windows of one block of items and the probes that find them."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, q: int, edits: int):
        self.edits, self.min_words = edits, min_words
        texts = {i: normal(t) for i, t in items}
        texts = {i: t for i, t in texts.items() if t.count(" ") + 1 >= min_words}
        self.ids, self.words = list(texts), [t.split(" ") for t in texts.values()]
        own = [code_points(f" {t} ") for t in texts.values()]
        self.lengths = np.array([len(x) for x in own], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        # A band's width of padding at both ends saves every test of bounds.
        self.own = np.concatenate([*own, np.zeros(64, np.uint64)]) if own else np.zeros(64, np.uint64)
        item, start, size = [], [], []
        for k, words in enumerate(self.words):
            at = np.cumsum([0, *(len(w) + 1 for w in words)])
            first, last = at[: len(words) - min_words + 1], at[min_words:]
            item.append(np.full(len(first), k))
            start.append(first + self.offsets[k])
            size.append(last - first + 1)
        cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)
        self.item, self.start, self.size = cat(item), cat(start), cat(size)
        # A piece of a window must hold a q-gram.
        self.q = q = max(1, min(q, int(self.size.min()) // (edits + 1))) if len(self.size) else q
        self.grams = gram_hashes(self.own, q)
        _, inverse, counts = np.unique(self.grams, return_inverse=True, return_counts=True)
        common = counts[inverse]
        keys, windows, inside = [], [], []
        for w, (a, n) in enumerate(zip(self.start.tolist(), self.size.tolist())):
            piece = n // (edits + 1)
            for e in range(edits + 1):
                low = a + e * piece
                best = low + int(common[low : low + piece - q + 1].argmin())
                keys.append(self.grams[best])
                windows.append(w)
                inside.append(best - a)
        keys = np.array(keys, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.first = np.append(self.first, len(keys))
        self.probe_window, self.probe_inside = np.array(windows, np.int64)[order], np.array(inside, np.int64)[order]
        self.least = np.maximum(1, self.size - q + 1 - edits * q)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def _spaced(self, grams: np.ndarray, window: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The lemma on q-grams that don't overlap: an edit breaks one of them at most, so all but ``edits`` are in the band."""
        places = self.size[window] // self.q
        missing = np.zeros(len(window), np.int64)
        top = len(grams) - 1
        for k in range(int(places.max())):
            theirs = self.grams[self.start[window] + k * self.q]
            here = at + k * self.q
            shared = grams[_clip(here, 0, top)] == theirs
            for d in range(1, self.edits + 1):
                shared |= grams[_clip(here - d, 0, top)] == theirs
                shared |= grams[_clip(here + d, 0, top)] == theirs
            missing += ~shared & (k < places)
            if k >= self.edits:  # most hits are settled by now
                left = missing <= self.edits
                if not left.all():
                    out = np.zeros(len(window), bool)
                    if left.any():
                        out[left] = self._spaced_rest(grams, window[left], at[left], missing[left], k + 1)
                    return out
        return missing <= self.edits

    def _spaced_rest(self, grams, window, at, missing, k) -> np.ndarray:
        """The places from ``k`` on."""
        places, top = self.size[window] // self.q, len(grams) - 1
        for j in range(k, int(places.max())):
            theirs, here = self.grams[self.start[window] + j * self.q], at + j * self.q
            shared = np.zeros(len(window), bool)
            for d in range(-self.edits, self.edits + 1):
                shared |= grams[_clip(here + d, 0, top)] == theirs
            missing = missing + (~shared & (j < places))
        return missing <= self.edits

    def _counted(self, grams: np.ndarray, window: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the band around each hit (window, its place in the documents) meets the q-gram bound."""
        n = self.size[window] - self.q + 1
        step = np.arange(int(n.max()))
        theirs = self.grams[np.minimum(self.start[window][:, None] + step, len(self.grams) - 1)]
        shared = np.zeros(theirs.shape, bool)
        for d in range(-self.edits, self.edits + 1):
            shared |= grams[_clip(at[:, None] + step + d, 0, len(grams) - 1)] == theirs
        return (shared & (step < n[:, None])).sum(axis=1) >= self.least[window]

    def _distance(self, codes: np.ndarray, window: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Edit distance of each window to the documents inside its band, the ends in the documents free."""
        e, n = self.edits, self.size[window]
        far = np.int64(1 << 20)
        row = np.zeros((len(window), 2 * e + 1), np.int64)
        out = np.full(len(window), far)
        diagonals = np.arange(-e, e + 1)
        for i in range(int(n.max())):
            place = at[:, None] + i + diagonals
            unequal = codes[_clip(place, 0, len(codes) - 1)] != self.own[self.start[window] + i][:, None]
            new = row + (unequal | (place < 0) | (place >= len(codes)))
            new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)  # a character that the document lacks
            for k in range(1, 2 * e + 1):  # one more in the document
                new[:, k] = np.minimum(new[:, k], new[:, k - 1] + 1)
            row = new
            ends = n == i + 1
            if ends.any():
                out[ends] = row[ends].min(axis=1)
        return out

    def _holds(self, codes: np.ndarray, grams: np.ndarray, window: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each window is in the documents around its place with at most ``edits`` edits: counted, then verified."""
        out = np.zeros(len(window), bool)
        for a in range(0, len(window), _CHUNK):
            w, x = window[a : a + _CHUNK], at[a : a + _CHUNK]
            ok = np.flatnonzero(self._counted(grams, w, x))
            if len(ok):
                out[a + ok] = self._distance(codes, w[ok], x[ok]) <= self.edits
        return out

    def _aligned(self, codes: np.ndarray, item: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Best local alignment of whole items with the documents in the bands around diagonals: matched characters less ``q`` for each edit."""
        e, n, q = self.edits, self.lengths[item], self.q
        row = np.zeros((len(item), 2 * e + 1), np.int64)
        best = np.zeros(len(item), np.int64)
        diagonals = np.arange(-e, e + 1)
        for i in range(int(n.max())):
            place = shift[:, None] + i + diagonals
            there = (place >= 0) & (place < len(codes)) & (n[:, None] > i)
            equal = there & (codes[_clip(place, 0, len(codes) - 1)] == self.own[np.minimum(self.offsets[item] + i, len(self.own) - 1)][:, None])
            new = row + np.where(equal, 1, -q)
            new[:, :-1] = np.maximum(new[:, :-1], row[:, 1:] - q)
            for k in range(1, 2 * e + 1):
                new[:, k] = np.maximum(new[:, k], new[:, k - 1] - q)
            row = np.where(there, np.maximum(new, 0), 0)
            best = np.maximum(best, row.max(axis=1))
        return best

    def search(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(index of text, item's place, aligned) of each text, in normal form, that holds a window up to the edits."""
        codes = code_points("".join(f" {t} \0" for t in texts))
        grams = gram_hashes(codes, self.q)
        if not len(grams) or not len(self.keys):
            return []
        p = np.flatnonzero(self.filter[(grams >> np.uint64(42)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, grams[p]), len(self.keys) - 1)
        hit = self.keys[place] == grams[p]
        p, place = p[hit], place[hit]
        n = self.first[place + 1] - self.first[place]
        at_probe = np.repeat(self.first[place] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        window, at = self.probe_window[at_probe], np.repeat(p, n) - self.probe_inside[at_probe]
        ends = np.cumsum([len(t) + 3 for t in texts])
        owner = np.searchsorted(ends, np.repeat(p, n), "right")
        found = []
        ok = self._spaced(grams, window, at) if len(window) else np.zeros(0, bool)
        window, at, owner = window[ok], at[ok], owner[ok]
        if not len(window):
            return []
        # The windows of one text, item and diagonal stand for one another: one of each is verified, the others only where it fails.
        line = np.stack([owner, self.item[window], at - self.start[window] + self.offsets[self.item[window]]], 1)
        line, head, group = np.unique(line, axis=0, return_index=True, return_inverse=True)
        group = group.reshape(-1)
        good = self._holds(codes, grams, window[head], at[head])
        rest = np.flatnonzero(~good[group])
        rest = rest[rest != head[group[rest]]]
        if len(rest):
            _, one = np.unique(np.stack([window[rest], at[rest]]), axis=1, return_index=True)
            rest = rest[one]
            good[group[rest[self._holds(codes, grams, window[rest], at[rest])]]] = True
        found = line[good]
        if not len(found):
            return []
        # One alignment a text, item and diagonal.
        score = self._aligned(codes, found[:, 1], found[:, 2])
        best: dict[tuple[int, int], int] = {}
        for (d, i, _), v in zip(found.tolist(), score.tolist()):
            best[d, i] = max(best.get((d, i), 0), v)
        return [(d, i, v) for (d, i), v in sorted(best.items())]

    def longest_run(self, words: list[str], item: int) -> int:
        """The most consecutive words that a text and an item share, if at least ``min_words``; else 0."""
        other = np.array(self.words[item], object)
        places = {}
        for k, w in enumerate(self.words[item]):
            places.setdefault(w, []).append(k)
        row, best = np.zeros(len(other) + 1, np.int64), 0
        for w in words:
            new = np.zeros(len(other) + 1, np.int64)
            if w in places:
                k = places[w]
                new[np.array(k) + 1] = row[k] + 1
                best = max(best, int(new.max()))
            row = new
        return best if best >= self.min_words else 0


#: Indexes of this worker, by the block's name and settings; a worker outlives the queries it serves.
_INDEXES: dict[tuple, ItemIndex] = {}


def _index(shared, *settings) -> ItemIndex:
    name, block = shared.value
    key = (name, *settings)
    if key not in _INDEXES:
        if len(_INDEXES) > 4:
            _INDEXES.clear()
        _INDEXES[key] = ItemIndex(block, *settings)
    return _INDEXES[key]


def leaked_passages(documents: DataFrame, items: DataFrame, min_words: int = 12, q: int = 16, edits: int = 2, block_chars: int = 4_000_000, batch_chars: int = 400_000) -> DataFrame:
    """(doc_id, item_id, aligned, run): documents that hold a passage of an item, up to ``edits`` edits in ``min_words`` words.

    ``aligned`` is the score of the best banded alignment, ``run`` the longest run of equal
    consecutive words (0 under ``min_words``). Items pass through the driver in blocks of about
    ``block_chars`` characters, so that a broadcast stays bounded whatever their number; documents are taken
    ``batch_chars`` characters together, and longer ones alone and whole.
    """
    spark = documents.sparkSession
    item_type = pa.int32() if items.schema["item_id"].dataType.simpleString() == "int" else pa.int64()
    docs = spread(documents.where(F.col("text").isNotNull()).select("doc_id", "text"), "doc_id")
    kinds = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, aligned int, run int"

    def against(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _index(shared, min_words, q, edits)
            for batch in batches:
                ids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                out, at = [], 0
                while at < len(raw):
                    upto, size = at, 0
                    while upto < len(raw) and (upto == at or size + len(raw[upto]) <= batch_chars):
                        size += len(raw[upto])
                        upto += 1
                    texts = [normal(t) for t in raw[at:upto]]
                    out += [(ids[at + d], own.ids[i], v, own.longest_run(texts[d].split(" "), i)) for d, i, v in own.search(texts)]
                    at = upto
                columns = list(zip(*out)) if out else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], item_type), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())],
                    names=["doc_id", "item_id", "aligned", "run"],
                )

        return docs.mapInArrow(run, kinds)

    found, block, size = None, [], 0

    def close(found, block):
        part = against(spark.sparkContext.broadcast((uuid.uuid4().hex, block)))
        return part if found is None else found.unionByName(part)

    for row in items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct().toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= block_chars:
            found, block, size = close(found, block), [], 0
    if block or found is None:
        found = close(found, block)
    return found.groupBy("doc_id", "item_id").agg(F.max("aligned").alias("aligned"), F.max("run").alias("run"))
