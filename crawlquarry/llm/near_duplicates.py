"""Near-duplicate texts: SuperMinHash signatures, banding, verification, union-find groups.

A SuperMinHash signature slot holds the least ``rank + random`` over a text's shingles,
where every shingle walks the slots in its own permutation and ranks them 0, 1, 2, ...
All shingles of a batch take their step ``j`` together; a text stops as soon as all its
slots lie below ``j + 1``, since later steps can't lower any of them.

Texts of equal word sequences form one class. A task hands on the bands of a class once,
so that a text copied over a third of the corpus meets the shuffle as one row a task at
most. Classes that share a band are compared block by block on sketches (one byte of some
signature slots); only pairs that pass go on to exact verification on their whole shingle
sets. A class is named by 64 bits of a hash of its words.

Defined results: null or empty texts and texts under ``min_words`` words take no part;
of repeated rows of a key the greatest text counts; keys with equal text are pairs of similarity 1; no
text is paired with itself; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlquarry.llm.words import WordHashes, mix, shingles, unique_by_owner
from crawlquarry.session import broadcast_if_small, materialize, shuffle_width, spread

_RANDOM_BITS = 22


@dataclass(frozen=True)
class Settings:
    """Shingle width, similarity to reach, and the banding (slots = bands x rows)."""

    width: int = 5
    threshold: float = 0.8
    min_words: int = 5
    bands: int = 20
    rows: int = 8
    block: int = 512
    sketch: int = 96

    @property
    def slots(self) -> int:
        return self.bands * self.rows

    def sketch_matches(self) -> int:
        """Equal sketch bytes that a pair at the threshold misses with a probability under 1e-6 (5 sigma)."""
        n, p = min(self.sketch, self.slots), self.threshold + (1 - self.threshold) / 256
        return max(1, int(n * p - 5 * (n * p * (1 - p)) ** 0.5))


def superminhash(values: np.ndarray, owner: np.ndarray, texts: int, slots: int, block: int = 40_000) -> np.ndarray:
    """Signatures (texts x slots, uint32) of sets given as distinct (owner, value) rows sorted by owner.

    Blocks of rows bound the memory of the permutations; a set may span blocks, as its signature is a minimum.
    """
    h = np.full((texts, slots), np.uint32(0xFFFFFFFF), np.uint32)
    for at in range(0, len(values), block):
        _lower(h, values[at : at + block], owner[at : at + block])
    return h


def _lower(h: np.ndarray, values: np.ndarray, owner: np.ndarray) -> None:
    """Lower the signatures ``h`` by some of their sets' elements."""
    texts, slots = h.shape
    flat = h.reshape(-1)
    live = np.arange(len(values))
    perm = np.broadcast_to(np.arange(slots, dtype=np.uint16), (len(values), slots)).copy()
    seed, base = mix(values), owner * slots
    have = np.zeros(texts, bool)
    have[owner] = True
    gold = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for j in range(slots):
            x = mix(seed[live] + gold * np.uint64(j + 1))
            k = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
            slot = perm[live, k]
            perm[live, k] = perm[live, j]
            value = (np.uint32(j) << np.uint32(_RANDOM_BITS)) | (x >> np.uint64(64 - _RANDOM_BITS)).astype(np.uint32)
            np.minimum.at(flat, base[live] + slot, value)
            open_ = have & (h.max(axis=1) >= np.uint32(j + 1) << np.uint32(_RANDOM_BITS))
            live = live[open_[owner[live]]]
            if not len(live):
                break


def band_keys(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(h), bands)).copy()
        cube = h.reshape(len(h), bands, rows).astype(np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cube[:, :, r])
    return key.view(np.int64)


def _signer(s: Settings, chunk: int = 128):
    schema = pa.schema([("key", pa.string()), ("id", pa.int64()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = WordHashes(), set()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), chunk):
                part = texts[at : at + chunk]
                v, o, counts = shingles(part, s.width, memo)
                take = np.flatnonzero(counts >= max(s.min_words, s.width))
                if not len(take):
                    continue
                with np.errstate(over="ignore"):
                    place = (np.arange(len(v)) - np.searchsorted(o, np.arange(len(part)))[o]).astype(np.uint64)
                    ids = np.zeros(len(part), np.uint64)
                    np.add.at(ids, o, mix(v + mix(place)))
                    ids = mix(ids).view(np.int64)[take]
                new = np.array([x not in seen and not seen.add(x) for x in ids.tolist()])
                first = take[new]
                index = np.full(len(part), -1)
                index[first] = np.arange(len(first))
                uv, uo = unique_by_owner(v, o)
                inside = index[uo] >= 0
                h = superminhash(uv[inside], index[uo[inside]], len(first), s.slots)
                step = max(1, s.slots // s.sketch)
                sketch = iter(h[:, ::step][:, : s.sketch].astype(np.uint8))
                bands = iter(band_keys(h, s.bands, s.rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(at, len(part)).take(pa.array(take)).cast(pa.string()), pa.array(ids),
                        pa.array([next(sketch).tobytes() if n else None for n in new], pa.binary()),
                        pa.array([next(bands) if n else None for n in new], pa.list_(pa.int64())),
                    ],
                    schema=schema,
                )

    return run


def signatures(texts: DataFrame, s: Settings) -> DataFrame:
    """(key, id, sketch, bands) of each text that takes part; the last two are null where the task has given them for the same id."""
    return spread(texts, "key").mapInArrow(_signer(s), "key string, id bigint, sketch binary, bands array<bigint>")


def _compare_blocks(s: Settings):
    least = s.sketch_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for same, left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids_a = np.array([x["id"] for x in left], np.int64)
                mat_a = np.frombuffer(b"".join(x["sketch"] for x in left), np.uint8).reshape(len(left), -1)
                if same:
                    ids_b, mat_b = ids_a, mat_a
                else:
                    ids_b = np.array([x["id"] for x in right], np.int64)
                    mat_b = np.frombuffer(b"".join(x["sketch"] for x in right), np.uint8).reshape(len(right), -1)
                for i in range(len(ids_a)):
                    ok = (mat_b == mat_a[i]).sum(axis=1) >= least
                    ok &= ids_b > ids_a[i] if same else ids_b != ids_a[i]
                    hit = ids_b[ok]
                    out_a.append(np.minimum(hit, ids_a[i]))
                    out_b.append(np.maximum(hit, ids_a[i]))
            a = np.concatenate(out_a) if out_a else np.empty(0, np.int64)
            b = np.concatenate(out_b) if out_b else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["id_a", "id_b"])

    return run


def candidate_pairs(signed: DataFrame, s: Settings) -> DataFrame:
    """(id_a, id_b), id_a < id_b: classes that share a band and whose sketches agree enough.

    Bands travel as (band, id); sketches join only what shares a band with another class. The
    classes of a band are cut into blocks, and every pair of blocks is a cell of its own key, so a
    band that a third of all classes share is spread over as many tasks as it has cells.
    """
    width = shuffle_width(signed.sparkSession)
    # One exchange serves both the search for shared bands and the join with them.
    rows = signed.select("id", F.explode("bands").alias("band")).repartition(width, "band")
    shared = rows.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).where("least <> most").select("band", F.ceil(F.col("n") / s.block).cast("long").alias("blocks"))
    members = rows.join(shared, "band").select("band", "blocks", "id").distinct()
    sketches = signed.where(F.col("sketch").isNotNull()).select("id", "sketch").dropDuplicates(["id"])
    members = members.join(sketches, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # Block b takes part in the cells (least, greatest) of itself and every other block.
    cells = members.select(
        "band", "id", "sketch", "block", F.explode(F.expr("transform(sequence(0L, blocks - 1), x -> struct(least(x, block) AS row, greatest(x, block) AS col))")).alias("cell"),
    ).select("band", F.col("cell.row").alias("row"), F.col("cell.col").alias("col"), "block", "id", "sketch")
    side = lambda which: F.collect_list(F.when(F.col("block") == F.col(which), F.struct("id", "sketch")))
    cells = cells.groupBy("band", "row", "col").agg(side("row").alias("l"), side("col").alias("r"))
    none = F.expr("cast(array() as array<struct<id:bigint,sketch:binary>>)")
    same = F.col("row") == F.col("col")
    pairs = cells.where((same & (F.size("l") > 1)) | (~same & (F.size("l") > 0) & (F.size("r") > 0)))
    return pairs.select(same.alias("same"), "l", F.when(same, none).otherwise(F.col("r")).alias("r")).mapInArrow(_compare_blocks(s), "id_a bigint, id_b bigint").distinct()


def _shingle_sets(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            v, o, _ = shingles(batch.column(1).to_pylist(), s.width, memo)
            v, o = unique_by_owner(v, o)
            cuts = np.searchsorted(o, np.arange(batch.num_rows + 1))
            raw = v.tobytes()
            sets = [raw[8 * a : 8 * b] for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

    return run


@F.pandas_udf(T.DoubleType())
def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact Jaccard similarity of two sorted sets of 64-bit hashes."""
    out = np.empty(len(a))
    for i, (x, y) in enumerate(zip(a, b)):
        u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(u, v, assume_unique=True))
        out[i] = both / max(1, len(u) + len(v) - both)
    return pd.Series(out)


@dataclass(frozen=True)
class NearDuplicates:
    """members: (key, id) with id the class; pairs: (id_a, id_b, similarity) between classes."""

    members: DataFrame
    pairs: DataFrame


def one_text_a_key(texts: DataFrame) -> DataFrame:
    """(key, text): one row a key, so that a class is verified on the very text it was made of.

    Whether keys repeat is counted on the keys alone; only then are texts shuffled.
    """
    texts = texts.where(F.col("key").isNotNull() & F.col("text").isNotNull()).select(F.col("key").cast("string").alias("key"), "text")
    repeated = texts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return texts if repeated.isEmpty() else texts.groupBy("key").agg(F.max("text").alias("text"))


def near_duplicates(texts: DataFrame, s: Settings = Settings(), small: int = 200_000) -> NearDuplicates:
    """Classes of equal texts and the verified pairs between classes of ``texts`` (key, text).

    The texts to verify are fetched by a broadcast of their keys if these are counted to be
    at most ``small``, else by a shuffle.
    """
    texts = one_text_a_key(texts)
    signed = materialize(signatures(texts, s), "signatures")
    members = signed.select("key", "id")
    found = materialize(candidate_pairs(signed, s), "candidates")
    wanted = found.select(F.col("id_a").alias("id")).union(found.select("id_b")).distinct()
    bodies = materialize(members.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("key").alias("key")), "wanted")
    bodies, _ = broadcast_if_small(bodies, small)
    bodies = texts.join(bodies, "key").select("id", "text")
    sets = materialize(bodies.mapInArrow(_shingle_sets(s), "id bigint, set binary"), "sets")
    checked = (
        found.join(sets.select(F.col("id").alias("id_a"), F.col("set").alias("set_a")), "id_a")
        .join(sets.select(F.col("id").alias("id_b"), F.col("set").alias("set_b")), "id_b")
        .select("id_a", "id_b", jaccard("set_a", "set_b").alias("similarity"))
        .where(F.col("similarity") >= s.threshold)
    )
    return NearDuplicates(members, checked)


def key_pairs(found: NearDuplicates) -> DataFrame:
    """(key_a, key_b), key_a < key_b: the pairs of keys, a number linear in the copies at every size.

    A class is represented by its least key. Each other copy is a pair with it; and for two similar classes each
    copy of the one is a pair with the representative of the other. So no link between different texts
    is lost, pairs of classes of up to two copies are all there but one, and no group of copies grows quadratically.
    """
    least = found.members.groupBy("id").agg(F.min("key").alias("least"))
    members = materialize(found.members.join(least, "id"), "classes")
    linked = materialize(found.pairs.select("id_a", "id_b"), "pairs")
    both = linked.unionByName(linked.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    others = members.where(F.col("key") == F.col("least")).select(F.col("id").alias("id_b"), F.col("least").alias("kb"))
    # The pair of two representatives is given from one side only.
    between = members.join(both.join(others, "id_b").select(F.col("id_a").alias("id"), "id_b", "kb"), "id").where((F.col("key") != F.col("least")) | (F.col("id") < F.col("id_b"))).select(F.col("key").alias("ka"), "kb")
    star = members.where(F.col("key") != F.col("least")).select(F.col("least").alias("ka"), F.col("key").alias("kb"))
    return between.unionByName(star).select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))


def _local_union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition as (node, root) stars, by union-find with path halving."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["u", "v"])


def groups(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root): connected components of ``edges`` (u, v), root the least node.

    Each partition contracts its own edges by union-find; what joins partitions is then
    contracted by alternating large-star and small-star rounds until nothing changes.
    """
    e = materialize(edges.select("u", "v").where("u <> v").mapInArrow(_local_union_find, "u bigint, v bigint").where("u <> v"), "stars")
    for _ in range(most_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select("u", "v", "m")
        after = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(after, "stars")
        same = after.exceptAll(e).isEmpty() and e.exceptAll(after).isEmpty()
        e = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def duplicate_groups(found: NearDuplicates) -> DataFrame:
    """(key, class_id, group_id, links): one row per text; links counts the other classes it is linked to."""
    pairs = materialize(found.pairs, "pairs")
    roots = groups(pairs.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")))
    links = pairs.select(F.col("id_a").alias("id")).union(pairs.select("id_b")).groupBy("id").agg(F.count("*").alias("links"))
    out = found.members.join(roots.withColumnRenamed("node", "id"), "id", "left").join(links, "id", "left")
    return out.select("key", F.col("id").alias("class_id"), F.coalesce("root", "id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
