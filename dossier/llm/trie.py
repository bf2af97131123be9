"""Prefix trie of conversations: a z-fast trie kept as tables.

A sequence of turns has a 128-bit name for each of its prefixes. Compacted nodes are rows: the edge from the parent's depth a
(exclusive) to the extent's depth e, the names of the prefixes on it, and the handle: the name at the two-fattest depth of
(a, e], the multiple of the largest power of two. A sequence finds its exit node by fat binary search, one join on handles for
each bit of its length, for all sequences at once; comparing names along that edge gives the depth at which it leaves.

Insertion goes in batches: of the sequences that leave at one place with one next turn, the one with the least hash is hung
there as a leaf (edges split where sequences leave or end inside them), and the others search again in the larger trie. The
least of a hash is a random pick, so a sequence's group shrinks as in a random search tree, and batches are logarithmic in
number. Equal sequences are one row throughout. Counts below a node are sums over ancestors at distances 1, 2, 4, ...; then
edges are expanded into one node per depth.

Turns are ordered by number, null first, ties by a hash of role and text; null role or text is empty. Rows with a null
conversation id belong to no conversation and are left out; repeated rows are repeated turns. Of other columns none is read.
An empty table has no nodes. Only names and sizes of a conversation's turns are gathered in one row (24 bytes a turn), never
texts. The conversation ids that end at one node are hashed in order as a stream: they are formatted in range partitions of
any number, and only text of bounded pieces goes to the task that hashes it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BATCHES = 200       # far above what logarithmic growth needs; more is an error
_NAME = "struct<hi: bigint, lo: bigint>"
_SUMS = ["n_convs", "all_bytes", "edge_bytes", "n_leaves"]


def turns(df: DataFrame, id_: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, ts: the turns of every conversation in order, each as two hashes and the bytes of its text."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = df.where(F.col(id_).isNotNull()).select(
        F.col(id_).cast("long").alias("conv"), F.struct(F.col(turn).alias("turn"), F.xxhash64(r, t).alias("hi"), F.xxhash64(F.lit(7), t, r).alias("lo"),
                                                       F.octet_length(t).cast("long").alias("bytes")).alias("t"))
    bare = lambda x: F.struct(x.hi.alias("hi"), x.lo.alias("lo"), x.bytes.alias("bytes"))
    return rows.groupBy("conv").agg(F.transform(F.sort_array(F.collect_list("t")), bare).alias("ts"))


def rebuilt(convs: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """conv, ts: the first h turns of the first conversation of each group of ids, then the own turns after the first h."""
    h = (F.crc32(F.col("conv").cast("string")) % most).cast("int")
    own = convs.select("conv", (F.col("conv") - F.pmod("conv", F.lit(group))).alias("base"), h.alias("h"), F.slice("ts", h + 1, F.greatest(F.size("ts") - h, F.lit(0))).alias("rest"))
    heads = convs.select(F.col("conv").alias("base"), F.slice("ts", 1, most).alias("head"))
    none = F.array().cast("array<struct<hi: bigint, lo: bigint, bytes: bigint>>")
    return own.join(heads, "base", "left").select("conv", F.concat(F.slice(F.coalesce("head", none), 1, F.col("h")), "rest").alias("ts"))


def named(convs: DataFrame) -> DataFrame:
    """conv, n, p: p[d] is the name of the first d turns and the bytes of their texts; p[0] is the root's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1).combine_chunks() if isinstance(b.column(1), pa.ChunkedArray) else b.column(1)
            flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(sizes)
            at = np.arange(len(flat)) - np.repeat(ends - sizes, sizes) + 1
            value = lambda c: np.asarray(flat.field(c)).astype(np.int64).view(np.uint64)
            out = []
            for c, odd in (("hi", 0x9E3779B97F4A7C15), ("lo", 0xC2B2AE3D27D4EB4F)):
                out.append(np.bitwise_xor.accumulate(_mixed(value(c) + at.astype(np.uint64) * np.uint64(odd))))
            out.append(np.cumsum(value("bytes")))
            # an entry for the root in front of each sequence, and every prefix relative to what came before it
            place = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes) + 1
            columns = []
            for k, acc in enumerate(out):
                before = np.concatenate((np.zeros(1, np.uint64), acc))[ends - sizes]
                own = np.zeros(len(flat) + len(sizes), np.uint64)
                own[place] = acc - np.repeat(before, sizes) if k == 2 else acc ^ np.repeat(before, sizes)
                columns.append(pa.array(own.view(np.int64)))
            name = pa.StructArray.from_arrays(columns[:2], ["hi", "lo"])
            p = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes + 1))).astype(np.int32)), pa.StructArray.from_arrays([name, columns[2]], ["k", "bytes"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes.astype(np.int32)), p], ["conv", "n", "p"])

    return convs.select("conv", "ts").mapInArrow(run, f"conv bigint, n int, p array<struct<k: {_NAME}, bytes: bigint>>")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] that is divisible by the largest power of two."""
    bit = F.length(F.bin(a.bitwiseXOR(b).cast("long"))) - 1
    step = F.pow(F.lit(2.0), bit)
    return (F.floor(b / step) * step).cast("int")


def _nodes(edges: DataFrame) -> DataFrame:
    """e, key, a, up (the parent's name), first (the name at a + 1), handle, and the edge: names and bytes at depths a + 1 to e.
    edges: a, up, edge."""
    e = edges.withColumn("e", F.col("a") + F.size("edge"))
    at = lambda d: F.get("edge", d - F.col("a") - 1)
    return e.select("a", "e", "up", at(F.col("e")).k.alias("key"), at(F.col("a") + 1).k.alias("first"), at(fattest(F.col("a"), F.col("e"))).k.alias("handle"), "edge")


def _leave(waiting: DataFrame, nodes: DataFrame, bits: int) -> DataFrame:
    """waiting with a and L: the depth of the deepest node whose extent the sequence has, and the depth at which it leaves the trie;
    key and e of the node on whose edge it leaves, null if it leaves at an extent."""
    ask = waiting.withColumn("a", F.lit(0)).withColumn("b", F.col("n"))
    handles = nodes.select(F.col("handle").alias("_h"), F.col("a").alias("_a"), F.col("e").alias("_e"), F.col("key").alias("_k"))
    for _ in range(bits):
        f = fattest(F.col("a"), F.col("b"))
        looking = F.col("a") < F.col("b")
        ask = ask.withColumn("_f", F.when(looking, f)).withColumn("_h", F.when(looking, F.get("p", F.col("_f")).k))
        ask = ask.join(handles, "_h", "left")
        on_path = (F.col("_e") <= F.col("n")) & (F.get("p", F.col("_e")).k == F.col("_k"))
        found = F.col("_k").isNotNull()
        # the handle of a node that goes another way later on: the sequence leaves on its edge
        leaves = found & ~F.coalesce(on_path, F.lit(False))
        ask = ask.withColumn("_b", F.when(leaves, F.col("_a")).when(~found & looking, F.col("_f") - 1).otherwise(F.col("b"))) \
            .withColumn("a", F.when(leaves, F.col("_a")).when(found, F.col("_e")).otherwise(F.col("a"))) \
            .withColumn("b", F.greatest("_b", "a")).drop("_h", "_a", "_e", "_k", "_f", "_b")
    ask = ask.drop("b").withColumn("_first", F.when(F.col("a") < F.col("n"), F.get("p", F.col("a") + 1).k))
    below = nodes.select(F.col("first").alias("_first"), "key", "e", F.col("edge.k").alias("_names"))
    ask = ask.join(below, "_first", "left")
    # names along an edge agree up to the depth of departure and never after it
    alike = F.size(F.filter(F.sequence(F.lit(1), F.size("_names")), lambda i: F.get("_names", i - 1) == F.get("p", F.col("a") + i).k))
    return ask.withColumn("L", F.col("a") + F.when(F.col("key").isNotNull(), alike).otherwise(0)).drop("_first", "_names")


def insert(sequences: DataFrame, bits: int) -> DataFrame:
    """The compacted nodes, without the root, of sequences(sid, n, p)."""
    order = F.struct(F.xxhash64(F.lit(3), "sid.hi", "sid.lo"), "sid")
    nodes, waiting = None, sequences.where("n > 0").select("sid", "n", "p")
    for _ in range(BATCHES):
        if nodes is None:
            left = waiting.withColumn("a", F.lit(0)).withColumn("L", F.lit(0)).withColumn("key", F.lit(None).cast(_NAME)).withColumn("e", F.lit(None).cast("int"))
        else:
            left = stored(_leave(waiting, nodes, bits), "leave")
        at = left.withColumn("up", F.get("p", F.col("L")).k)
        goes_on = at.where("L < n").withColumn("next", F.get("p", F.col("L") + 1).k)
        chosen = stored(goes_on.groupBy("up", "next").agg(F.min_by(F.struct("sid", "L", "n", "p"), order).alias("x"))
                        .select(F.col("x.L").alias("a"), "up", F.slice("x.p", F.col("x.L") + 2, F.col("x.n") - F.col("x.L")).alias("edge"), F.col("x.sid").alias("sid")), "leaves")
        grown = chosen.select("a", "up", "edge")
        if nodes is not None:
            cuts = left.where("key is not null and L > a").groupBy("key").agg(F.sort_array(F.collect_set("L")).alias("cuts"))
            old = nodes.join(cuts, "key", "left")
            piece = F.explode(F.arrays_zip(F.concat(F.array("a"), F.col("cuts")).alias("x"), F.concat(F.col("cuts"), F.array("e")).alias("y")))
            parts = old.where("cuts is not null").select(F.col("a").alias("top"), "up", "edge", piece.alias("z"))
            parts = parts.select(F.col("z.x").alias("a"), F.when(F.col("z.x") == F.col("top"), F.col("up")).otherwise(F.get("edge", F.col("z.x") - F.col("top") - 1).k).alias("up"),
                                 F.slice("edge", F.col("z.x") - F.col("top") + 1, F.col("z.y") - F.col("z.x")).alias("edge"))
            grown = grown.unionByName(parts).unionByName(old.where("cuts is null").select("a", "up", "edge"))
        nodes = stored(_nodes(grown), "trie")
        waiting = stored(left.where("L < n").select("sid", "n", "p").join(chosen.select("sid"), "sid", "left_anti"), "waiting")
        if waiting.isEmpty():
            return nodes
    raise RuntimeError("insertion did not end")


def _below(nodes: DataFrame) -> DataFrame:
    """key, and the sums (least for conv) over each node and all nodes below it. nodes: key, up (null at the root), sums, conv."""
    s = nodes.select("key", F.col("up").alias("jump"), *_SUMS, "conv")
    while not s.where("jump is not null").isEmpty():
        more = s.where("jump is not null").groupBy(F.col("jump").alias("key")).agg(*[F.sum(c).alias(f"_{c}") for c in _SUMS], F.min("conv").alias("_conv"))
        further = s.select(F.col("key").alias("jump"), F.col("jump").alias("_jump"))
        s = stored(s.join(more, "key", "left").join(further, "jump", "left").select(
            "key", F.col("_jump").alias("jump"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in _SUMS], F.least("conv", "_conv").alias("conv")), "sums")
    return s.drop("jump")


def ended(members: DataFrame) -> DataFrame:
    """key, sha: SHA-256 of the conversation ids of each key, ascending and comma-joined. members: key, conv."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))])
            starts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [b.num_rows]))
            ids = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(starts[:-1])), b.column(1).take(pa.array(starts[:-1])), b.column(2).take(pa.array(starts[:-1])),
                                              pa.array([",".join(map(str, ids[i:j])) for i, j in zip(starts[:-1], starts[1:])])], ["hi", "lo", "conv", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            done = []
            for hi, lo, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
                if key != (hi, lo):
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha = (hi, lo), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _digests(done)
        if key is not None:
            yield _digests([(*key, sha.hexdigest())])

    rows = members.select("key.hi", "key.lo", "conv").repartitionByRange("hi", "lo", "conv").sortWithinPartitions("hi", "lo", "conv")
    texts = rows.mapInArrow(pieces, "hi bigint, lo bigint, conv bigint, ids string")
    found = texts.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "conv").mapInArrow(digest, "hi bigint, lo bigint, sha string")
    return found.select(F.struct("hi", "lo").alias("key"), "sha")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["hi", "lo", "sha"])


def build(convs: DataFrame) -> DataFrame:
    """All nodes of the trie of convs(conv, ts): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, members but one times the bytes of the last text), ends_sha256."""
    whole = stored(named(convs).withColumn("sid", F.get("p", F.col("n")).k), "sequences")
    same = whole.groupBy("sid").agg(F.count(F.lit(1)).alias("members"), F.min("conv").alias("conv"), F.first("n").alias("n"), F.first("p").alias("p"))
    sequences = stored(same, "distinct")
    longest = sequences.agg(F.max("n")).first()[0]
    # the root is there if there is any conversation
    root = sequences.limit(1).select(F.lit(-1).alias("a"), F.lit(0).alias("e"), F.lit(None).cast(_NAME).alias("up"), F.get("p", F.lit(0)).k.alias("key"),
                                     F.array(F.get("p", F.lit(0))).alias("edge"))
    nodes = root if not longest else root.unionByName(insert(sequences, int(longest).bit_length()).select(*root.columns))
    children = nodes.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    here = sequences.select(F.col("sid").alias("key"), "members", "conv", (F.col("members") * F.get("p", F.col("n")).bytes).alias("all_bytes"))
    # bytes at the parent's extent are those at the first place of the edge less its own text, so edges carry them from the parent
    start = nodes.select(F.col("key").alias("up"), F.element_at("edge", -1).bytes.alias("top_bytes"))
    full = stored(nodes.join(children, "key", "left").join(here, "key", "left").join(start, "up", "left").select(
        "key", "up", "a", "e", "edge", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("top_bytes", F.lit(0)).cast("long").alias("top_bytes"),
        F.coalesce("members", F.lit(0)).cast("long").alias("n_convs"), F.coalesce("all_bytes", F.lit(0)).cast("long").alias("all_bytes"), "conv",
        (F.element_at("edge", -1).bytes - F.coalesce("top_bytes", F.lit(0))).alias("edge_bytes"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves")), "nodes")
    sums = stored(_below(full), "below")
    ends = ended(whole.select(F.col("sid").alias("key"), "conv"))
    parents = sums.select(F.col("key").alias("up"), F.col("conv").alias("up_conv"))
    edges = full.select("key", "up", "a", "e", "edge", "n_children", "top_bytes", F.col("edge_bytes").alias("own_bytes")) \
        .join(sums, "key").join(parents, "up", "left").join(ends, "key", "left")
    one = edges.select("*", F.posexplode("edge.bytes").alias("i", "bytes")).withColumn("before", F.when(F.col("i") > 0, F.get("edge", F.col("i") - 1).bytes).otherwise(F.col("top_bytes")))
    last = F.col("i") == F.size("edge") - 1
    # members times bytes of all they hold from this depth on, less each text once
    saved = F.col("all_bytes") - F.col("n_convs") * F.col("before") - (F.col("edge_bytes") - F.col("own_bytes") + F.element_at("edge", -1).bytes - F.col("before"))
    return one.select(F.col("conv").alias("conv_id"), (F.col("a") + 1 + F.col("i")).cast("long").alias("depth"), F.when(F.col("i") > 0, F.col("conv")).otherwise(F.col("up_conv")).alias("parent_conv_id"),
                      "n_convs", F.when(last, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
                      F.when(last & F.col("sha").isNotNull(), F.col("sha")).otherwise(F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
