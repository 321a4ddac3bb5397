"""The trie of the beginnings that conversations share, by preorder intervals.

A node is a distinct sequence of first turns. Turns are numbered and the hashes of beginnings are made by running sums over
ranges (prefix_sums), so that a conversation of any length is walked by many tasks. Distinct conversations, not nodes, are
sorted: by the hashes of those turns that they share with others and one more, which tells them apart. In that order a node's
members are an interval [first, last]; sorted by (first, depth) the nodes are in preorder, and whatever is summed up over a
subtree is the difference of two prefix sums, at the node and at the end of its last member.

A turn is known by 128 bits of hash (two 64-bit hashes of role and text), a beginning by the exclusive or of its turns' hashes
with their places. Order among siblings is that of the hashes, which any fixed order serves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .prefix_sums import running

#: Conversation ids that are joined to one piece of text before a node's digest goes over them.
IDS_OF_PIECE = 10_000
NODE = ["depth", "p1", "p2"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns as (conv_id, place, h1, h2, points): place from 1 in order of turn, null first, ties by role and then by hash.

    A null role or text is empty. Rows without a conv_id belong to no conversation and are left out; repeated rows count."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), r.alias("role"), F.xxhash64(F.lit(1), r, t).alias("h1"), F.xxhash64(F.lit(2), t, r).alias("h2"), F.length(t).cast("long").alias("points")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]
    return running(rows, order, "turns", segment="conv_id").select("conv_id", F.col("at").alias("place"), "h1", "h2", "points")


def rebuilt(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Numbered turns of conversations that begin with turns of their block's first conversation, and all ids: (turns, ids).

    Conversation c takes the first h turns of c - c % block (all if it has fewer, none if there is none), h being the crc32 of
    c in decimals modulo ``most``, and goes on with its own turns after its first h."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).alias("h")
    ids = turns.groupBy("conv_id").agg(F.max("place").alias("own")).select("conv_id", "own", h, (F.col("conv_id") - F.col("conv_id") % block).alias("lead"))
    heads = turns.where((F.col("place") < most) & (F.col("conv_id") % block == 0)).groupBy(F.col("conv_id").alias("lead")).agg(F.array_sort(F.collect_list(F.struct("place", "h1", "h2", "points"))).alias("head"))  # fewer than ``most`` turns each
    ids = materialize(ids.join(heads, "lead", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,h1:bigint,h2:bigint,points:bigint>>")), 1, F.col("h").cast("int"))), "conversations")
    lent = ids.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    # A long conversation is a hot key of this join: one side has one row for it, and the other may be split.
    own = turns.join(ids.select("conv_id", "h", F.size("head").alias("n_head")), "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("n_head")).alias("place"), "h1", "h2", "points")
    return lent.unionByName(own), ids.select("conv_id")


def beginnings(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, h1, h2, points, p1, p2, q1, q2): p names the beginning that ends with this turn, q the one before it."""
    keyed = turns.withColumns({"k1": F.xxhash64("place", "h1", "h2"), "k2": F.xxhash64("h2", "place", "h1")})
    walked = running(keyed, [F.col("conv_id"), F.col("place")], "beginnings", segment="conv_id", xors=("k1", "k2"))
    before = lambda k: F.col(f"xor_{k}").bitwiseXOR(F.col(k))
    return walked.select("conv_id", F.col("place").alias("depth"), "h1", "h2", "points", F.col("xor_k1").alias("p1"), F.col("xor_k2").alias("p2"), before("k1").alias("q1"), before("k2").alias("q2"))


def digests(members: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of rows (depth, p1, p2, conv_id): the ids ascending, joined by commas.

    Ids are joined in pieces by Spark first, then a node's pieces run through one digest in order: what one task reads of a
    node is its ids over IDS_OF_PIECE rows, and what it holds is one piece."""
    piece = (F.col("conv_id") - F.pmod("conv_id", F.lit(IDS_OF_PIECE))).alias("piece")
    pieces = members.groupBy(*NODE, piece).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(3)]))
            done: list[tuple] = []
            for key, ids in zip(keys, batch.column(4).to_pylist()):
                if key != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _batch(done)
        if node is not None:
            yield _batch([(*node, state.hexdigest())])

    arranged = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    return arranged.mapInArrow(walk, "depth long, p1 long, p2 long, ends_sha256 string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), (), ()]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*NODE, "ends_sha256"])


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """All nodes of the trie of ``turns`` (conv_id, place from 1, h1, h2, points); ``ids`` has every conv_id once, also those
    without a turn.

    A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes in its
    subtree), saved_tokens (over the subtree, (n_convs - 1) times the points of each node's last turn), ends_sha256, and the
    interval: preorder (from 0, the root's) and end (the last preorder in its subtree). Without any id there is no node."""
    rows = beginnings(turns)
    # The whole of each conversation is the beginning at its greatest depth; copies count through the smallest of them.
    whole = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "p1", "p2")).alias("e"))
    zero = F.lit(0).cast("long")
    whole = materialize(ids.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(f"e.{c}"), zero).alias(c) for c in NODE]), "ends")
    copies = materialize(whole.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")), "copies")
    rows = materialize(rows.join(copies.select("conv_id", "copies"), "conv_id"), "distinct")
    nodes = rows.groupBy(*NODE).agg(F.sum("copies").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.count("*").alias("sequences"), F.first("points").alias("points"), F.first("q1").alias("q1"), F.first("q2").alias("q2"))
    nodes = materialize(nodes, "nodes")
    # Conversations in order: by the turns they share with others, and the one after.
    shared = rows.join(nodes.where("sequences > 1").select(*NODE), NODE).groupBy("conv_id").agg(F.max("depth").alias("deepest"))
    telling = rows.select("conv_id", "depth", "h1", "h2").join(shared, "conv_id", "left").where(F.col("depth") <= F.coalesce("deepest", zero) + 1)
    keys = telling.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "h1", "h2"))), lambda t: F.struct(t["h1"], t["h2"])).alias("key"))
    turnless = F.array().cast("array<struct<h1:bigint,h2:bigint>>")
    sequences = copies.select("conv_id", F.col("depth").alias("length")).join(keys, "conv_id", "left").withColumn("key", F.coalesce("key", turnless))
    ranks = running(sequences, [F.col("key"), F.col("conv_id")], "ranks").select("conv_id", "length", F.col("at").alias("rank"))
    intervals = rows.select("conv_id", *NODE).join(ranks, "conv_id").groupBy(*NODE).agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    top, last = ids.agg(F.min("conv_id"), F.count("*")).first(), ranks.agg(F.max("rank")).first()[0]
    root = turns.sparkSession.createDataFrame([(0, 0, 0, top[1], top[0], 0, None, None, 1, last)] if top[1] else [], ", ".join(f"{c} long" for c in [*NODE, "n_convs", "conv_id", "points", "q1", "q2", "first", "last"]))
    placed = nodes.drop("sequences").join(intervals, NODE).unionByName(root)
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    placed = placed.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    placed = placed.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("points")})
    pre = running(placed, [F.col("first"), F.col("depth")], "preorder", sums=("leaf", "saved"))
    # The prefix sums at the end of each conversation: the last node that it is the first to have.
    ends = pre.groupBy(F.col("first").alias("last")).agg(F.max("at").alias("at_end"), F.max("sum_leaf").alias("leaf_end"), F.max("sum_saved").alias("saved_end"))
    out = pre.join(ends, "last").join(digests(whole), NODE, "left")
    parents = pre.where("n_children > 0").select(F.col("depth").alias("q0"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    out = out.withColumn("q0", F.col("depth") - 1).join(parents, ["q0", "q1", "q2"], "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("leaf_end") - F.col("sum_leaf") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_end") - F.col("sum_saved") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
        (F.col("at") - 1).alias("preorder"),
        (F.col("at_end") - 1).alias("end"),
    )

