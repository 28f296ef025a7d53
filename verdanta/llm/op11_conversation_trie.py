"""Prefix trie of conversations, built level by level and rolled up in reverse.

A node is a distinct sequence of first turns (role, text); its members are the conversations that start with it. A
node is named by its smallest member and its depth, since a conversation has one node per depth.

1. Every turn becomes a digest (SHA-256 of role and text) and its bytes, so texts leave the plan before any shuffle.
2. A conversation's turns are rebuilt: its base's first turns, then its own (``rebuilt``).
3. Conversations with equal sequences become one class with its number of members: ten thousand copies take the
   room of one. The ids of a class are hashed in ascending order: they are range-partitioned, written down as text
   per partition, and these few stretches pass through one hash object as a stream.
4. Per depth, the live classes are grouped by (parent node, next turn); the minimum conv_id names the child. A class
   that is alone in its node leaves: from there on it is a chain, whose nodes are written at once. So there are as
   many levels as different conversations share turns, not as many as the longest conversation has. The groups are
   aggregated before their shuffle and joined back by a plain join, which Spark splits where a third of all
   conversations share a first turn.
5. In reverse, each level's leaves and savings are added to their parents.

Every level is a table in the shared folder, so a lost executor costs a level at most, and plans stay short. One
conversation's turn digests are one row (40 bytes a turn).

Cases: a null role or text is empty; turns with equal numbers are ordered by their digests, repeated rows are turns of
their own; rows with a null conv_id are left out; a conversation may have no turns after it is rebuilt and is then
a member of the root alone; for a negative conv_id, ``%`` has its sign, as in SQL; extra columns are ignored. An
empty table gives no rows.
"""

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch, stored

EVERY, MOST = 5, 9
NOBODY = hashlib.sha256().hexdigest()


def turn_lists(turns: DataFrame) -> DataFrame:
    """(conv, seq): each conversation's turns in order as (k, the digest of role and text; n, the text's bytes)."""
    role, text = (F.encode(F.coalesce(c, F.lit("")), "UTF-8") for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.encode(F.octet_length(role).cast("string"), "UTF-8"), F.encode(F.lit(":"), "UTF-8"), role, text), 256))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn"), digest.alias("k"), F.octet_length(text).cast("long").alias("n")).alias("t"))
    return rows.groupBy("conv").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["k"].alias("k"), t["n"].alias("n"))).alias("seq"))


def borrowed(conv: Column) -> Column:
    """How many turns a conversation takes from its base."""
    return F.crc32(F.encode(conv.cast("string"), "UTF-8")) % MOST


def rebuilt(lists: DataFrame) -> DataFrame:
    """(conv, seq): the first ``borrowed`` turns of conversation conv - conv % EVERY, then the own ones after as many."""
    h = borrowed(F.col("conv")).cast("int")
    heads = lists.select(F.col("conv").alias("base"), F.slice("seq", 1, MOST - 1).alias("head"))
    own = lists.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % EVERY).alias("base"), "seq")
    lead = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(lists.schema["seq"].dataType))
    rest = F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv", F.concat(lead, rest).alias("seq"))


def ids_hash(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, ends): of the conversations (key, conv), the hash of each key's ids in ascending order, joined by commas."""
    parts = scratch.stored(members.repartitionByRange("key", "conv").withColumn("part", F.spark_partition_id()))
    told = parts.groupBy("part", "key").agg(F.min("conv").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in ((0, pa.binary()), (1, pa.string()))], names=["key", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])

    return told.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(run, "key binary, ends string")


def classes(convs: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, w, seq, ends): one row for each distinct sequence, with its smallest id, its number of members and the hash of their ids."""
    key = F.unhex(F.sha2(F.encode(F.array_join(F.transform("seq", lambda t: F.hex(t["k"])), ""), "UTF-8"), 256))
    keyed = scratch.stored(convs.select("conv", key.alias("key"), "seq"))
    sizes = keyed.groupBy("key").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("w"))
    named = sizes.join(ids_hash(keyed.select("key", "conv"), scratch), "key")
    return named.join(keyed.select("conv", "seq"), "conv").select("conv", "w", "seq", "ends")


def trie(convs: DataFrame) -> DataFrame:
    """Nodes of the conversations (conv, seq): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch()
    live = scratch.stored(classes(convs, scratch).withColumn("node", F.lit(None).cast("long")))
    ender = lambda depth: F.max(F.when(F.size("seq") == depth, F.col("ends"))).alias("ends")
    root = live.agg(F.min("conv").alias("node"), F.sum("w").alias("n_convs"), ender(0)).where("node IS NOT NULL")
    shared = [scratch.stored(root.select("node", F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("bytes"), "ends"))]
    live = live.drop("node").join(F.broadcast(shared[0].select("node")))  # one row
    alone = []
    while True:
        depth = len(shared)
        turn = F.get("seq", F.lit(depth - 1))
        going = live.where(F.size("seq") >= depth).withColumn("k", turn["k"]).withColumnRenamed("node", "parent")
        groups = going.groupBy("parent", "k").agg(F.min("conv").alias("node"), F.sum("w").alias("n_convs"), F.max(turn["n"]).alias("bytes"), F.count(F.lit(1)).alias("n_classes"), ender(depth))
        groups = scratch.stored(groups)
        level = scratch.stored(going.join(groups.select("parent", "k", "node", (F.col("n_classes") == 1).alias("alone")), ["parent", "k"]).drop("k"))
        alone.append(level.where("alone").select(F.lit(depth).alias("depth"), "parent", "conv", "w", "seq", "ends"))
        many = groups.where("n_classes > 1").select("node", "parent", "n_convs", "bytes", "ends")
        if many.isEmpty():
            break
        shared.append(many)
        live = level.where("NOT alone").select("conv", "w", "seq", "ends", "node")

    nodes, below = [], None
    zero = F.lit(0).cast("long")
    for depth in reversed(range(len(shared))):
        tail = F.aggregate(F.slice("seq", F.lit(depth + 1), F.size("seq") - depth), zero, lambda a, t: a + t["n"])
        up = alone[depth].select("parent", F.lit(1).cast("long").alias("n_leaves"), (tail * (F.col("w") - 1)).alias("saved"))
        if below is not None:
            up = up.unionByName(below.select("parent", "n_leaves", "saved"))
        up = up.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        own = shared[depth].join(up, "node", "left")
        saved = (F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("saved", zero)
        below = stored(own.select("node", "parent", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), saved.alias("saved"), "ends"))
        nodes.append(below.withColumn("depth", F.lit(depth)))
    # the chains: every node has the class's members, and all but the last one child
    chains = reduce(DataFrame.unionByName, alone)
    steps = chains.select("conv", "parent", "w", "ends", "depth", F.size("seq").alias("end"), F.posexplode(F.transform("seq", lambda t: t["n"])).alias("at", "bytes")).where("at + 1 >= depth").withColumn("d", F.col("at") + 1)
    rest = Window.partitionBy("conv").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.where("w = 1").withColumn("saved", zero).unionByName(steps.where("w > 1").withColumn("saved", F.sum("bytes").over(rest) * (F.col("w") - 1)))
    last = F.col("d") == F.col("end")
    chain = steps.select(F.col("conv").alias("node"), F.when(F.col("d") == F.col("depth"), F.col("parent")).otherwise(F.col("conv")).alias("parent"), F.col("w").alias("n_convs"), (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), "saved", F.when(last, F.col("ends")).alias("ends"), F.col("d").alias("depth"))
    out = stored(chain)
    scratch.clear()
    return reduce(DataFrame.unionByName, nodes, out).select(F.col("node").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of all conversations, each rebuilt from its base and itself."""
    scratch = Scratch()
    nodes = trie(rebuilt(scratch.stored(turn_lists(turns))))
    scratch.clear()
    return nodes
