"""The prefixes that rebuilt conversations share, as the nodes of a z-fast trie.

A z-fast trie (Belazzougui, Boldi, Pagh and Vigna, 2010) keeps only the nodes of a compacted trie: a node
stands for an edge, the depths ``(top, end]`` of one path, and is hashed at its *handle*, the prefix
whose depth is the two-fattest number of that interval (the one with most trailing zero bits). A fat
binary search finds where a key leaves the trie with one probe per bit of its length: a probe of
the two-fattest depth left either hits a handle, and the search goes on below that node's end, or misses,
and it goes on above.

Every turn is known by a hash of its role and text, every prefix by the exclusive or of hashes of its
``(depth, turn)`` pairs, twice 64 bits; equal prefixes are told by those. The trie holds one key
for all conversations that are equal throughout (the least of their ids).

1. Turns get their place by a sort over ranges of ``(conv_id, turn, ...)``: a conversation that holds most of the
   rows is numbered range by range, and the ranges' totals are carried forward. Prefix hashes are
   running exclusive ors made the same way.
2. Keys are inserted in batches. In a batch every key finds its exit edge by the fat binary search, where each
   probe is one join of all keys with the handle table, and its exact exit depth by comparing prefix
   hashes along that edge alone. Of all keys that leave the trie at one place by one turn, one is inserted; the others
   leave deeper in the next batch. All splits of one edge happen in one batch.
3. Sums over subtrees are made by pointer doubling over the compacted nodes.
4. Edges are expanded to one node per depth.

Defined cases: rows without ``conv_id`` belong to no conversation; rows of one conversation with equal ``turn``
follow the order of an MD5 hash of role and text, and repeated rows are repeated turns; a missing turn comes
first; NULL role or text is empty; negative ids use the sign of ``c % 20`` that SQL gives; an empty table has
no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ridgework.session import discard, stage

GROUP = 20
HEADS = 4
# Ids written into one string of the list that a node's digest is taken of.
IDS_AT_ONCE = 8192
WORD = r"[^\x20\x09-\x0D]+"
HASH = ["a", "b"]
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, order: list[str], sums: dict[str, tuple]) -> DataFrame:
    """``rows`` with aggregates over all rows of the same ``conv_id`` up to each, in ``order``.

    ``sums`` has per new column ``(aggregate, of, combine)``. Rows are dealt by ranges of the order, which also cut through
    a large conversation; each range is aggregated alone, then ranges are told what came before.
    """
    by = ["conv_id", *order, "tie"]
    dealt = stage(rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).withColumn(
        "part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("conv_id", "part").orderBy(*order, "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("conv_id", "part").agg(*[f(of).alias(name) for name, (f, of, _) in sums.items()])
    earlier = totals.select("conv_id", "part", *[
        (F.sum if f is F.count else f)(name).over(before).alias(f"before_{name}") for name, (f, _, _) in sums.items()
    ]).where(" or ".join(f"before_{name} is not null" for name in sums))
    local = dealt.select("*", *[f(of).over(inside).alias(name) for name, (f, of, _) in sums.items()])
    return local.join(earlier, ["conv_id", "part"], "left").select(*rows.columns, *[
        combine(F.col(name), F.coalesce(F.col(f"before_{name}"), F.lit(0))).alias(name) for name, (_, _, combine) in sums.items()
    ])


def _add(x: Column, y: Column) -> Column:
    return x + y


def _xor(x: Column, y: Column) -> Column:
    return x.bitwiseXOR(y)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, code, words``: the turns of every conversation in order, numbered from 1."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint"), "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("code"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    placed = running(rows, ["turn", "code"], {"place": (F.count, F.lit(1), _add)})
    return placed.select("conv_id", "place", "code", "words")


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """``conv_id, len`` of every rebuilt conversation, and ``conv_id, depth, code, words, len`` of its turns.

    Conversation ``c`` takes its first turns from the first of its group: ``crc32(c) % heads`` at most.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("first_of_group"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"),
    )
    lengths = convs.select(F.col("conv_id").alias("first_of_group"), F.col("n").alias("there"))
    sized = stage(convs.join(lengths, "first_of_group", "left").withColumn(
        "head", F.least(F.coalesce("there", F.lit(0)), "h")
    ).select("conv_id", "first_of_group", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "rebuilt")
    opening = turns.where(F.col("place") < heads).withColumnRenamed("conv_id", "first_of_group")
    head = sized.join(opening, "first_of_group").where("place <= h").select("conv_id", F.col("place").alias("depth"), "code", "words", "len")
    tail = turns.join(sized, "conv_id").where("place > h").select(
        "conv_id", (F.col("head") + F.col("place") - F.col("h")).alias("depth"), "code", "words", "len"
    )
    return sized.select("conv_id", "len"), head.unionByName(tail)


def prefixes(steps: DataFrame) -> DataFrame:
    """``conv_id, depth, words, len`` with ``a, b``, the hash of the prefix, and ``upto``, its words."""
    hashed = steps.select("conv_id", "depth", "words", "len", *[
        F.xxhash64(F.lit(lane), "code", "depth").alias(f"step_{lane}") for lane in HASH
    ])
    sums = {lane: (F.bit_xor, f"step_{lane}", _xor) for lane in HASH} | {"upto": (F.sum, "words", _add)}
    return running(hashed, ["depth"], sums).select("conv_id", "depth", "words", "len", *HASH, "upto")


def fattest(low: str, high: str) -> Column:
    """The number in ``(low, high]`` with most trailing zero bits."""
    bit = f"(length(bin({low} ^ {high})) - 1)"
    return F.expr(f"shiftleft(shiftright({high}, {bit}), {bit})")


class Paths:
    """Prefix hashes of the trie's keys, depth 0 included, to be looked up by key and depth."""

    def __init__(self, keys: DataFrame, found: DataFrame):
        roots = keys.select("key", *[F.lit(0).cast("bigint").alias(name) for name in ("depth", *HASH, "words", "upto")])
        own = found.join(keys.select(F.col("key").alias("conv_id")), "conv_id", "left_semi")
        self.rows = stage(roots.unionByName(own.select(F.col("conv_id").alias("key"), "depth", *HASH, "words", "upto")), "paths")

    def look_up(self, rows: DataFrame, key: str, depth: Column, *names: str) -> DataFrame:
        """``rows`` with the hash of ``key``'s prefix at ``depth``, NULL where there is none, as two more columns."""
        at = self.rows.select(F.col("key").alias("__key"), F.col("depth").alias("__depth"), *[F.col(lane).alias(name) for lane, name in zip(HASH, names)])
        return rows.join(at, (F.col(key) == F.col("__key")) & (depth == F.col("__depth")), "left").drop("__key", "__depth")


# A node is the edge of depths (top, end] on the path of key ``rep``: the hash of its end (a, b), of its
# parent's end (pa, pb), of its handle at depth f (fa, fb) and of its first prefix below the parent (da, db).
NODE = ["rep", "top", "end", "a", "b", "pa", "pb", "f", "fa", "fb", "da", "db"]
END = ["end", "a", "b"]


def locate(open_: DataFrame, nodes: DataFrame, paths: Paths, probes: int) -> DataFrame:
    """For every key the place where it leaves the trie.

    ``key, len, ka, kb`` with ``exit``, the depth up to which the trie has it, ``la, lb`` and ``na, nb``, its hashes there and one
    turn further (NULL at its end), and the edge left (``NODE`` columns), NULL where it is left at a node.
    """
    handles = nodes.select("f", "fa", "fb", F.struct("f", "rep", "top", *END, "pa", "pb").alias("node"))
    state = open_.withColumns({"low": F.lit(0).cast("bigint"), "high": F.col("len"), "hit": F.lit(None).cast(handles.schema["node"].dataType)})
    for _ in range(probes):
        state = state.withColumn("f", F.when(F.col("low") < F.col("high"), fattest("low", "high")))
        state = paths.look_up(state, "key", F.col("f"), "fa", "fb").join(handles, ["f", "fa", "fb"], "left")
        found = F.col("node").isNotNull()
        state = state.select(
            *open_.columns, F.when(found, F.col("node.end")).otherwise(F.col("low")).alias("low"),
            F.when(F.col("f").isNotNull() & ~found, F.col("f") - 1).otherwise(F.col("high")).alias("high"),
            F.coalesce("node", "hit").alias("hit"),
        )
    # The handle of the last hit is a prefix of the key; its end may be further than the key follows.
    state = paths.look_up(state, "key", F.col("hit.end"), "va", "vb")
    follows = F.coalesce((F.col("va") == F.col("hit.a")) & (F.col("vb") == F.col("hit.b")), F.col("hit").isNull())
    state = state.withColumns({"follows": follows, "at": F.when(follows, F.coalesce("hit.end", F.lit(0)))})
    doors = nodes.select((F.col("top") + 1).alias("door"), "da", "db", F.struct((F.col("top") + 1).alias("f"), "rep", "top", *END, "pa", "pb").alias("below"))
    state = paths.look_up(state, "key", F.col("at") + 1, "da", "db").withColumn("door", F.col("at") + 1).join(doors, ["door", "da", "db"], "left")
    edge = F.when(F.col("follows"), F.col("below")).otherwise(F.col("hit"))
    state = stage(state.select(*open_.columns, "at", edge.alias("edge")), "exit-edges")
    # Along an edge the prefix is known to agree down to the edge's depth f.
    along = state.where("edge is not null").select(
        "key", F.col("edge.rep").alias("rep"), F.explode(F.sequence(F.col("edge.f"), F.least("len", "edge.end"))).alias("d"))
    along = paths.look_up(paths.look_up(along, "key", F.col("d"), "a", "b"), "rep", F.col("d"), "ra", "rb")
    depths = along.where("a = ra and b = rb").groupBy("key").agg(F.max("d").alias("deepest"))
    state = state.join(depths, "key", "left").withColumn("exit", F.coalesce("deepest", "at"))
    state = paths.look_up(state, "key", F.col("exit"), "la", "lb")
    state = paths.look_up(state, "key", F.col("exit") + 1, "na", "nb")
    return state.select(*open_.columns, "exit", "la", "lb", "na", "nb", *[F.col(f"edge.{name}").alias(name) for name in ("rep", "top", *END, "pa", "pb")])


def from_root(open_: DataFrame, paths: Paths) -> DataFrame:
    """What ``locate`` gives while the trie is empty: every key leaves it at the root, by its first turn."""
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    state = open_.withColumns({"exit": zero, "la": zero, "lb": zero})
    state = paths.look_up(state, "key", F.lit(1), "na", "nb")
    return state.withColumns({name: none for name in ("rep", "top", *END, "pa", "pb")})


def insert(exits: DataFrame, nodes: DataFrame, paths: Paths) -> tuple[DataFrame, DataFrame]:
    """The nodes after a batch, and the keys that still wait; of all that leave by one turn one goes in."""
    # Different keys have different hashes (64 bits are mixed one to one), so every reading picks the same key.
    order = F.xxhash64("key")
    leaves = exits.where("exit < len").groupBy("exit", "na", "nb").agg(*[
        F.min_by(name, order).alias(name) for name in ("key", "len", "ka", "kb", "la", "lb")
    ])
    none = F.lit(None).cast("bigint")
    grown = leaves.select(
        F.col("key").alias("rep"), F.col("exit").alias("top"), F.col("len").alias("end"), F.col("ka").alias("a"), F.col("kb").alias("b"),
        F.col("la").alias("pa"), F.col("lb").alias("pb"), none.alias("f"),
    )
    cuts = exits.where("end is not null").select("rep", "top", *END, "pa", "pb", "exit", "la", "lb").distinct()
    upward = Window.partitionBy(*END).orderBy("exit")
    upper = cuts.select(
        "rep", F.lag("exit").over(upward).alias("cut"), "top", F.col("exit").alias("end_"), F.col("la").alias("a_"), F.col("lb").alias("b_"),
        F.lag("la").over(upward).alias("pa_"), F.lag("lb").over(upward).alias("pb_"), "pa", "pb",
    ).select(
        "rep", F.coalesce("cut", "top").alias("top"), F.col("end_").alias("end"), F.col("a_").alias("a"), F.col("b_").alias("b"),
        F.coalesce("pa_", "pa").alias("pa"), F.coalesce("pb_", "pb").alias("pb"), none.alias("f"),
    )
    lowest = cuts.groupBy(*END).agg(F.max("exit").alias("cut"), F.max_by("la", "exit").alias("pa_"), F.max_by("lb", "exit").alias("pb_"))
    kept = nodes.join(lowest, END, "left")
    cut = F.col("cut").isNotNull()
    shorter = kept.where(cut).select("rep", F.col("cut").alias("top"), *END, F.col("pa_").alias("pa"), F.col("pb_").alias("pb"), none.alias("f"))
    fresh = grown.unionByName(upper).unionByName(shorter).withColumn("f", fattest("top", "end"))
    fresh = paths.look_up(paths.look_up(fresh, "rep", F.col("f"), "fa", "fb"), "rep", F.col("top") + 1, "da", "db")
    after = stage(kept.where(~cut).select(*NODE).unionByName(fresh.select(*NODE)), "trie")
    waiting = stage(exits.where("exit < len").join(leaves.select("key"), "key", "left_anti").select("key", "len", "ka", "kb"), "keys-waiting")
    return after, waiting


def compacted_trie(keys: DataFrame, paths: Paths) -> DataFrame:
    """All edges below the root, for the keys ``key, len, ka, kb``."""
    spark = keys.sparkSession
    nodes = spark.createDataFrame([], ", ".join(f"{name} bigint" for name in NODE))
    waiting = stage(keys.where("len > 0").select("key", "len", "ka", "kb"), "keys-waiting")
    probes = (waiting.agg(F.max("len")).first()[0] or 0).bit_length()
    done: list[DataFrame] = []
    while not waiting.isEmpty():
        exits = stage(locate(waiting, nodes, paths, probes) if done else from_root(waiting, paths), "exits")
        before, (nodes, left) = nodes, insert(exits, nodes, paths)
        discard(exits, waiting, *([before] if done else []))
        waiting = left
        done = [nodes]
    return nodes


def subtree_sums(nodes: DataFrame, sums: dict) -> DataFrame:
    """``nodes`` (``id, parent``) with columns in ``sums`` aggregated over each node's subtree.

    Pointer doubling: after round k a node holds what lies less than ``2**k`` levels below it, so the rounds
    are as many as the height of the compacted trie has bits.
    """
    state = nodes.withColumn("above", F.col("parent"))
    while True:
        state = stage(state, "subtrees")
        if state.where("above is not null").isEmpty():
            return state.drop("above")
        sent = state.where("above is not null").groupBy(F.col("above").alias("id")).agg(*[f(name).alias(f"more_{name}") for name, (f, _) in sums.items()])
        up = state.select(F.col("id").alias("above"), F.col("above").alias("further"))
        state = state.join(sent, "id", "left").join(up, "above", "left").select(
            *[c for c in state.columns if c not in sums and c != "above"],
            *[both(F.col(name), F.col(f"more_{name}")).alias(name) for name, (_, both) in sums.items()], F.col("further").alias("above"),
        )


def _plus(x: Column, y: Column) -> Column:
    return x + F.coalesce(y, F.lit(0))


def end_digests(ends: DataFrame) -> DataFrame:
    """``end, a, b, digest`` of the ascending ids of the conversations that end at each place.

    Ids are sorted over ranges that also cut through one place, written into strings of bounded length,
    and only those strings meet, in order, in a stream that feeds the place's hash.
    """

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids = None, []
        for batch in batches:
            for *at, conv in zip(*(column.to_pylist() for column in batch.columns)):
                if place != at or len(ids) >= IDS_AT_ONCE:
                    if ids:
                        yield line(place, ids)
                    place, ids = at, []
                ids.append(conv)
        if ids:
            yield line(place, ids)

    def line(place: list, ids: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([v], pa.int64()) for v in (*place, ids[0])] + [pa.array([",".join(map(str, ids))])], names=["end", "a", "b", "first", "ids"])

    def digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, digest = None, None
        for batch in batches:
            for *at, _, ids in zip(*(column.to_pylist() for column in batch.columns)):
                if place == at:
                    digest.update(b",")
                else:
                    if place:
                        yield row(place, digest)
                    place, digest = at, hashlib.sha256()
                digest.update(ids.encode())
        if place:
            yield row(place, digest)

    def row(place: list, digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in place] + [pa.array([digest.hexdigest()])], names=["end", "a", "b", "digest"])

    by = [*END, "conv_id"]
    lines = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(
        written, "end bigint, a bigint, b bigint, first bigint, ids string")
    met = stage(lines, "end-ids").repartition(*END).sortWithinPartitions(*END, "first")
    return met.mapInArrow(digested, "end bigint, a bigint, b bigint, digest string")


def prefix_nodes(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, root included (see the module)."""
    turns = stage(numbered_turns(conversations), "turns")
    lengths, steps = rebuilt(turns, group, heads)
    found = stage(prefixes(steps), "prefixes")
    nothing = F.lit(0).cast("bigint")
    ends = stage(
        found.where("depth = len").select(F.col("len").alias("end"), *HASH, "conv_id", "upto")
        .unionByName(lengths.where("len = 0").select(F.col("len").alias("end"), *[nothing.alias(name) for name in HASH], "conv_id", nothing.alias("upto"))),
        "ends",
    )
    keys = stage(ends.groupBy(*END).agg(F.min("conv_id").alias("key"), F.count("*").alias("n_convs"), F.max("upto").alias("upto")), "keys")
    paths = Paths(keys, found)
    trie = compacted_trie(keys.select("key", F.col("end").alias("len"), F.col("a").alias("ka"), F.col("b").alias("kb")), paths)

    # Compacted nodes with what ends at them; the root is the edge of depth 0 alone.
    words = paths.rows.select(F.col("key").alias("rep"), "depth", "upto")
    spans = trie.join(words.withColumnRenamed("depth", "end").withColumnRenamed("upto", "upto_end"), ["rep", "end"]).join(
        words.withColumnRenamed("depth", "top").withColumnRenamed("upto", "upto_top"), ["rep", "top"]
    ).select("rep", "top", *END, "pa", "pb", "upto_top", (F.col("upto_end") - F.col("upto_top")).alias("edge_words"))
    root = keys.groupBy().agg(F.min("key").alias("rep")).where("rep is not null").select(
        "rep", F.lit(-1).cast("bigint").alias("top"), *[nothing.alias(name) for name in END],
        *[F.lit(None).cast("bigint").alias(name) for name in ("pa", "pb")], nothing.alias("upto_top"), nothing.alias("edge_words"))
    known = stage(spans.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "edges")
    parents = known.select(F.col("id").alias("parent"), F.col("end").alias("top"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    children = known.groupBy(F.col("top").alias("end"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("children"))
    own = known.join(parents, ["top", "pa", "pb"], "left").join(keys, END, "left").join(children, END, "left").select(
        "id", "parent", "rep", "top", *END, "upto_top", F.coalesce("children", nothing).alias("children"), F.col("key").alias("conv_id"),
        F.coalesce("n_convs", nothing).alias("n_convs"), F.col("children").isNull().cast("bigint").alias("n_leaves"),
        (F.coalesce("n_convs", nothing) * F.coalesce("upto", nothing)).alias("all_words"), "edge_words",
    )
    summed = subtree_sums(own, {
        "conv_id": (F.min, F.least), "n_convs": (F.sum, _plus), "n_leaves": (F.sum, _plus), "all_words": (F.sum, _plus), "edge_words": (F.sum, _plus),
    })

    named = summed.join(summed.select(F.col("id").alias("parent"), F.col("conv_id").alias("conv_above")), "parent", "left").join(
        end_digests(ends), END, "left")
    spread = named.withColumn("depth", F.explode(F.sequence(F.col("top") + 1, F.col("end"))))
    steps_of = paths.rows.select(F.col("key").alias("rep"), "depth", (F.col("upto") - F.col("words")).alias("before"))
    at_end, at_top = F.col("depth") == F.col("end"), F.col("depth") == F.col("top") + 1
    # All words the members read from this depth on, less each node's words once.
    saved = (F.col("all_words") - F.col("n_convs") * F.col("before")) - (F.col("edge_words") - (F.col("before") - F.col("upto_top")))
    return spread.join(steps_of, ["rep", "depth"]).select(
        "conv_id", "depth", F.when(at_top, F.col("conv_above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(at_end, F.col("children")).otherwise(F.lit(1)).cast("bigint").alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
        F.when(at_end, F.coalesce("digest", F.lit(EMPTY_DIGEST))).otherwise(F.lit(EMPTY_DIGEST)).alias("ends_sha256"),
    )
