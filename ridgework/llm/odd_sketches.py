"""Near copies by MinHash bands and odd sketches, confirmed on whole sets.

Documents are linked whose sets of three-word shingles have a resemblance of 85/100 or more. Equal
sets are one node from the first aggregation on.

1. ``BANDS * ROWS`` MinHash samples per set; a band key stands for ``ROWS`` of them. Sets at the least
   resemblance share a key but with probability ``(1 - 0.85**5)**40``, below 1e-10 a pair.
2. The samples are folded into an odd sketch (Mitzenmacher, Pagh and Pham, 2014): every sample flips one bit of a
   bitmap, so samples that two sets share cancel in the exclusive or of their bitmaps, and its population
   count tells how many differ. Pairs above the count that alike sets exceed with probability 1e-9
   are dropped without reading a text (``odd_cut``; it follows from the sampling, not from data).
3. At every key all sets are compared with one of them, the one that meets most others anywhere. Every set
   is confirmed against the best of those it was compared with, on the whole sets of both texts, so that a
   family becomes one component with one confirmation per member.
4. Keys whose members are still in several components are left. Their members meet again by prefixes: all shingles have one order,
   the rarest among these members first; of two alike sets the smaller one has one of its first 8 in 100 shingles among
   the larger one's first 15 in 100, and what either has left from there on reaches the overlap they need.
   That is exact, and neither a passage in many unlike documents nor a family whose members are just too far
   apart makes its members meet. Pairs that do are scored and confirmed.

A second odd sketch, of all shingles instead of samples, is part of the score: its population count never exceeds the number of
shingles two sets differ in, so what it drops is certain.

Components, not pairs, are what is kept: within one component nothing can change.

Defined cases: letter case counts only beyond ASCII; fewer than three words are one shingle; without words (or
text) a row has the empty set, is linked with nothing and names its own component; rows of one
``doc_id`` whose texts differ are linked; rows without ``doc_id`` are linked with others, name no
component, and alone have none (NULL, ``kept``); repeated rows repeat their result; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from math import comb
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ridgework.llm.components import components
from ridgework.session import checked_broadcast, discard, stage

SHINGLE = 3
SEED = 42
# Least resemblance of linked sets, in hundredths.
ALIKE = 85
ROWS, BANDS = 5, 40
SAMPLES = ROWS * BANDS
SKETCH_BITS = 512
WHOLE_BITS = 2048
MISS = 1e-9
# Steps towards the head of a family taken before looking for what is left; each doubles the distance.
JUMPS = 3
# Shingles whose samples are drawn at once; few enough for the processor's cache.
BLOCK = 128


def _constants(count: int, salt: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), salt) for i in range(count)], np.uint64)


FACTORS, SHIFTS = (_constants(SAMPLES, salt).astype(np.uint32) | np.uint32(1) for salt in (1, 2))
BAND_FACTORS = _constants(SAMPLES, 3) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist())], np.uint64))


def samples(hashes: np.ndarray) -> np.ndarray:
    """The least value of the set under each of ``SAMPLES`` hash functions, of 32 bits."""
    least, short = np.full(SAMPLES, np.iinfo(np.uint32).max, np.uint32), hashes.astype(np.uint32)
    for at in range(0, len(short), BLOCK):
        np.minimum(least, (short[at:at + BLOCK, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    return least.astype(np.uint64)


def band_keys(least: np.ndarray) -> np.ndarray:
    sums = (mixed(least) * BAND_FACTORS).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    return mixed(sums + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Bit ``i`` is 1 if an odd number of samples fall on it; as signed 64-bit numbers."""
    places = (mixed(least ^ BAND_FACTORS) >> np.uint64(32)).astype(np.int64) % SKETCH_BITS
    odd = (np.bincount(places, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def whole_sketch(hashes: np.ndarray) -> np.ndarray:
    """The odd sketch of the set itself."""
    odd = (np.bincount((hashes % np.uint64(WHOLE_BITS)).astype(np.int64), minlength=WHOLE_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


@functools.cache
def odd_cut(alike: int = ALIKE, count: int = SAMPLES, bits: int = SKETCH_BITS, miss: float = MISS) -> int:
    """The population count that sketches of sets at resemblance ``alike`` exceed with probability ``miss`` at most.

    The number of differing samples is binomial; each flips one bit on either side, and the number of odd bits after
    so many flips is a walk that goes down from ``s`` with probability ``s / bits``.
    """
    differ = 1 - alike / 100
    odd, down = np.zeros(bits + 1), np.arange(bits + 1) / bits
    odd[0] = 1.0
    above = np.zeros(bits + 1)
    for d in range(count + 1):
        above += comb(count, d) * differ**d * (1 - differ) ** (count - d) * (1 - np.cumsum(odd))
        for _ in range(2):
            odd = np.append((odd * down)[1:], 0) + np.append(0, (odd * (1 - down))[:-1])
    return int(np.argmax(above <= miss))


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, tid, sid, n, sketch, whole, keys`` for every row: of its text, its set (NULL if empty) and what stands for it."""
    names = ["doc_id", "tid", "sid", "n", "sketch", "whole", "keys"]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sids, sizes, sketches, wholes, keys = [], [], [], [], []
                for text in part.column(2):
                    hashes = shingle_set(text.as_py())
                    sizes.append(len(hashes))
                    sids.append(xxhash.xxh128_digest(hashes.tobytes(), SEED) if len(hashes) else None)
                    least = samples(hashes)
                    sketches.append(odd_sketch(least))
                    wholes.append(whole_sketch(hashes))
                    keys.append(band_keys(least) if len(hashes) else least[:0].view(np.int64))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(sids, pa.binary()), pa.array(sizes, pa.int64()),
                    pa.array(sketches, pa.list_(pa.int64())), pa.array(wholes, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())),
                ], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), _text_id("text").alias("tid"), "text").mapInArrow(
        read, "doc_id bigint, tid binary, sid binary, n bigint, sketch array<bigint>, whole array<bigint>, keys array<bigint>")


def _text_id(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


class Nodes:
    """The distinct sets: their sketches, and their texts as read from one document each."""

    def __init__(self, docs: DataFrame, rows: DataFrame):
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("d"), _text_id("text").alias("t"), "text")
        found = rows.where("sid is not null").groupBy("sid").agg(
            *[F.first(name).alias(name) for name in ("n", "sketch", "whole", "keys")], F.min(F.struct("doc_id", "tid")).alias("of"), F.min("doc_id").alias("least"))
        self.table = stage(found.withColumn("node", F.monotonically_increasing_id()), "sets")

    def scored(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs ``a, b`` that may be alike by size and sketches, with the samples' ``distance``."""
        one, two = (self.table.select(F.col("node").alias(x), *[F.col(name).alias(f"{name}_{x}") for name in ("n", "sketch", "whole")]) for x in "ab")

        def apart(name: str, bits: int) -> Column:
            return functools.reduce(add, [F.bit_count(F.col(f"{name}_a")[i].bitwiseXOR(F.col(f"{name}_b")[i])) for i in range(bits // 64)])

        near = (100 * F.least("n_a", "n_b") >= ALIKE * F.greatest("n_a", "n_b")) & (F.col("distance") <= odd_cut())
        # Sets alike enough differ in (100 - ALIKE) / (100 + ALIKE) of their shingles at most.
        certain = (100 + ALIKE) * apart("whole", WHOLE_BITS) <= (100 - ALIKE) * (F.col("n_a") + F.col("n_b"))
        return pairs.join(one, "a").join(two, "b").withColumn("distance", apart("sketch", SKETCH_BITS)).where(near & certain).select("a", "b", "distance")

    def texts(self, wanted: DataFrame) -> DataFrame:
        """``node, text`` of the nodes ``wanted``."""
        of = stage(self.table.join(wanted.distinct(), "node").select("node", "of.doc_id", "of.tid"), "texts-wanted")
        met = self.docs.join(checked_broadcast(of, 64), (F.col("t") == F.col("tid")) & F.col("d").eqNullSafe(F.col("doc_id")))
        return met.groupBy("node").agg(F.first("text").alias("text"))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs ``a, b`` whose whole sets are alike; texts of many pairs' ``a`` may be split over tasks."""
        pairs = stage(pairs.select("a", "b").distinct(), "pairs")
        texts = stage(self.texts(pairs.select(F.explode(F.array("a", "b")).alias("node"))), "texts")
        one, two = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")

        def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, of = None, None
            for batch in batches:
                alike = []
                for a, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                    if a != held:
                        held, of = a, shingle_set(text_a.as_py())
                    other = shingle_set(text_b.as_py())
                    both = len(np.intersect1d(of, other, assume_unique=True))
                    alike.append(100 * both >= ALIKE * (len(of) + len(other) - both))
                keep = pa.array(np.flatnonzero(alike))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

        met = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
        links = stage(met.mapInArrow(confirm, "a bigint, b bigint"), "links")
        discard(pairs, texts)
        return links


def shared_bands(nodes: Nodes) -> DataFrame:
    """``key, node, held``: keys of several nodes, and how many hold each."""
    keyed = nodes.table.select("node", F.explode("keys").alias("key"))
    # Stored counts come to the join by a shuffle of their own, so that adaptive execution can split a crowded key.
    held = stage(keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "keys-shared")
    met = stage(keyed.join(held, "key"), "keys-met")
    discard(held)
    return met


def heads(nodes: Nodes, met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of the nodes of ``met`` to heads of their keys, and ``node, label``: a connected node for each that has one.

    A head meets more nodes than whatever is linked to it, so following links ends.
    """
    central = stage(met.groupBy("node").agg(F.sum("held").alias("meets")), "meets")
    weighed = stage(met.join(central, "node"), "keys-weighed")
    chosen = stage(weighed.groupBy("key").agg(F.max_by("node", F.struct("meets", F.xxhash64("node"))).alias("a")), "keys-heads")
    pairs = weighed.join(chosen, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    links = nodes.confirmed(nodes.scored(pairs).groupBy("b").agg(F.min_by("a", F.struct("distance", "a")).alias("a")))
    labels = links.select(F.col("b").alias("node"), F.col("a").alias("label"))
    for _ in range(JUMPS):
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = stage(labels.join(further, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
    discard(central, weighed, chosen)
    return links, labels


def unsettled(met: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, label`` of the nodes at keys that hold several labels; a node without one is its own."""
    named = stage(met.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "keys-named")
    open_ = stage(named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key"), "keys-open")
    left = stage(named.join(open_, "key").select("node", "label").distinct(), "nodes-left")
    discard(named, open_)
    return left


def prefix_pairs(nodes: Nodes, left: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of nodes with different labels that meet by their prefixes, and no pair less that is alike."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [shingle_set(text.as_py()).view(np.int64) for text in part.column(1)]
                of = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), pa.array(np.concatenate(sets))], names=["node", "key"])

    texts = stage(nodes.texts(left.select("node")), "texts-left")
    held = texts.mapInArrow(read, "node bigint, key bigint")
    # Shingles of one node alone meet nobody; they come first in its order, so their number is all that counts.
    often = stage(held.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "shingles-shared")
    shared = held.join(checked_broadcast(often, 48), "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "key"))).alias("all"))
    # What a node has left from a shared shingle on, itself included.
    placed = shared.join(left, "node").join(nodes.table.select("node", "n"), "node").select(
        "node", "label", "n", F.size("all").alias("common"), F.posexplode("all").alias("i", "shingle"))
    rest = F.col("common") - F.col("i")
    ahead = stage(placed.where(100 * rest >= ALIKE * F.col("n")).select(
        "shingle.key", "node", "label", "n", rest.alias("rest"), ((100 + ALIKE) * rest >= 2 * ALIKE * F.col("n")).alias("early")), "prefixes")
    one, two = (ahead.select("key", *[F.col(name).alias(f"{name}_{x}") for name in ("node", "label", "n", "rest", "early")]) for x in "ab")
    reach = (100 + ALIKE) * F.least("rest_a", "rest_b") >= ALIKE * (F.col("n_a") + F.col("n_b"))
    pairs = one.where("early_a").join(two, "key").where(
        "(n_a < n_b or (n_a = n_b and node_a < node_b)) and label_a <> label_b").where(reach & (100 * F.col("n_a") >= ALIKE * F.col("n_b")))
    found = stage(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "prefix-pairs")
    discard(texts, often, ahead)
    return found


def near_links(nodes: Nodes, by_heads: bool = True) -> DataFrame:
    """Links ``a, b`` that connect all nodes linked by resemblance."""
    met = shared_bands(nodes)
    if by_heads:
        links, labels = heads(nodes, met)
    else:
        links = labels = None
    left = unsettled(met, labels) if by_heads else stage(met.select("node", F.col("node").alias("label")).distinct(), "nodes-left")
    found = nodes.confirmed(nodes.scored(prefix_pairs(nodes, left)))
    return found if links is None else links.unionByName(found)


def near_copies(docs: DataFrame, by_heads: bool = True) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row; a component has the least ``doc_id`` of its rows."""
    rows = stage(sketched(docs), "sketches")
    nodes = Nodes(docs, rows)
    links = near_links(nodes, by_heads)
    # Rows of one doc_id are one document: its sets are linked with one of them.
    ids = rows.where("doc_id is not null and sid is not null").select("doc_id", "sid")
    several = ids.groupBy("doc_id").agg(F.min(F.xxhash64("sid")).alias("lo"), F.max(F.xxhash64("sid")).alias("hi")).where("lo <> hi").select("doc_id")
    held = stage(ids.join(several, "doc_id").distinct().join(nodes.table.select("sid", "node"), "sid").select("doc_id", "node"), "sets-of-ids")
    shared = held.join(held.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b"))
    grouped = components(links.unionByName(shared)).select("node", F.col("component").alias("root"))
    named = stage(nodes.table.select("sid", "node", "least").join(grouped, "node", "left").withColumn("root", F.coalesce("root", "node")), "sets-named")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = stage(named.join(names, "root").select("sid", "component_id"), "set-components")
    return rows.select("doc_id", "sid", "n").join(known, "sid", "left").withColumn(
        "component_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    ).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
