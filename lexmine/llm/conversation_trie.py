"""A trie of conversations: which prefixes they share and what sharing saves, by time-forward processing.

A prefix is known by a sum of hashes of (place, turn), modulo 2^64, twice; sums along a conversation can be
taken over any split of its rows, so no conversation has to lie in one task. Nodes are then equal prefixes
counted, and totals go from nodes to parents in reverse level order through a priority queue that spills.

Nodes are dealt into shards. A node is heavy if over `bound` turns lie below it, over all its members; bound
is a share of the turns of all. A light node's shard is its uppermost light ancestor, so its subtree is
whole and holds bound nodes at most. Heavy nodes are few to a level, and form shards of at most bound nodes
along the path of their smallest member. Light shards are processed first, then totals go across the roots
of the heavy shards (some thousands of rows, whatever the input), and then into these.

Odd rows. Rows without a conv_id belong to no conversation. Null roles and texts are empty ones. Rows of one
turn go by role, then by the text's hash; equal rows count each. An empty table has no nodes, not even a
root. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmine.llm.common import checkpoint, partitions
from lexmine.llm.ordered import running

#: Conversations of one family share turns: each takes over the beginning of the family's first one.
FAMILY, MOST_SHARED = 5, 9
#: Rows of a side that are broadcast at most; with more, the sides are shuffled.
BROADCAST_ROWS = 100_000
NO_IDS = hashlib.sha256(b"").hexdigest()


class SpillingQueue:
    """A queue of tuples, smallest first. Holds about `most` in memory; beyond that the larger half goes into a sorted file, read back in blocks.

    The files are the task's own and have no name, like Spark's spills: they go with the task.
    """

    def __init__(self, most: int = 200_000, block: int = 1000):
        self.most, self.block = most, block
        self.heap: list[tuple] = []
        self.runs: list[Iterator[tuple]] = []
        self.heads: list[tuple] = []  # (first item of a run, number of the run)

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        self.heap.sort()
        half = len(self.heap) // 2
        file = tempfile.TemporaryFile()
        for k in range(half, len(self.heap), self.block):
            pickle.dump(self.heap[k : min(k + self.block, len(self.heap))], file)
        file.seek(0)
        del self.heap[half:]
        self.runs.append(self._read(file))
        self._next(len(self.runs) - 1)

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    block = pickle.load(file)
                except EOFError:
                    return
                yield from block

    def _next(self, run: int) -> None:
        item = next(self.runs[run], None)
        if item is not None:
            heapq.heappush(self.heads, (item, run))

    def first(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, run = heapq.heappop(self.heads)
            self._next(run)
            return item
        return heapq.heappop(self.heap)


#: A node on its way: when it is processed, when its parent is, is that in the same shard, what is known of it, what came from other shards.
NODE = ["t1", "t2", "t3", "u1", "u2", "u3", "inside", "conv_id", "depth", "n_convs", "own", "x_children", "x_leaves", "x_saved", "ends"]
DONE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, open boolean, u2 long, u3 long"
_DONE = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("open", pa.bool_()), ("u2", pa.int64()), ("u3", pa.int64())])


def forward(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Totals of the nodes of a partition, which come in the order of their times (t1, t2, t3), children before parents.

    A node takes from the queue what its children sent, adds it up, and sends its own record to its parent;
    it is written when the parent is processed, which knows the parent's conv_id. The roots of shards are
    written at once and stay open: their parents lie in other shards.
    """
    queue, rows = SpillingQueue(most), []
    for batch in batches:
        for t1, t2, t3, u1, u2, u3, inside, conv, depth, n, own, children, leaves, saved, ends in zip(*(batch.column(c).to_pylist() for c in NODE), strict=True):
            now = (t1, t2, t3)
            saved += own
            while (first := queue.first()) is not None and first[:3] == now:
                child = queue.pop()[3:]
                children, leaves, saved = children + 1, leaves + child[4], saved + child[5]
                rows.append((child[0], child[1], conv, *child[2:], False, 0, 0))
            leaves = leaves if children else 1
            if inside:
                queue.push((u1, u2, u3, conv, depth, n, children, leaves, saved, ends))
            else:
                rows.append((conv, depth, None, n, children, leaves, saved, ends, True, u2, u3))
            if len(rows) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DONE, strict=True)], schema=_DONE)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DONE, strict=True)], schema=_DONE)


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its rows, which are counted, are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and two hashes of role and text, bytes of the text. No text goes further."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(11), role, text).alias("b"), F.octet_length(text).cast("long").alias("bytes"))


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over from its family's first."""
    return F.crc32(conv_id.cast("string")) % MOST_SHARED


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, len, place from 1, a, b, bytes), and all conversations (conv_id, len), those without turns too."""
    numbered = running(turns_of(conversations), "conv_id", ["turn", "role", "a", "b"]).drop("turn", "role")
    sizes = numbered.groupBy("conv_id").agg(F.max("n").alias("size"))
    of = sizes.withColumns({"h": shared_turns(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    of = of.join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("there")), "base", "left")
    shared = F.least("h", F.coalesce("there", F.lit(0)))
    of = checkpoint(of.select("conv_id", "base", "h", shared.alias("shared"), (shared + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("len")))
    own = numbered.join(of, "conv_id").where("n > h").select("conv_id", "len", (F.col("shared") + F.col("n") - F.col("h")).alias("place"), "a", "b", "bytes")
    heads = numbered.where((F.col("n") < MOST_SHARED) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    taken = heads.join(of, "base").where("n <= h").select("conv_id", "len", F.col("n").alias("place"), "a", "b", "bytes")
    return own.unionByName(taken), of.select("conv_id", "len")


def ends_of(members: DataFrame) -> DataFrame:
    """The digest of the ids that end at a node: members (place, a, b, conv_id) to (place, a, b, ends).

    Ids are sorted over the cluster and joined into blocks where they lie; a node's blocks are then hashed
    in order, one at a time, as a SHA-256 can't be taken otherwise.
    """
    n = partitions(members.sparkSession)
    text = pa.schema([("place", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])

    def blocks(batches, most=4096):
        key, ids = None, []
        for batch in batches:
            out = []
            for *one, conv in zip(*(batch.column(c).to_pylist() for c in ("place", "a", "b", "conv_id")), strict=True):
                if one != key or len(ids) == most:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = one, []
                ids.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), text, strict=True)], schema=text)
        if ids:
            yield pa.RecordBatch.from_pydict(dict(zip(text.names, ([x] for x in (*key, ids[0], ",".join(map(str, ids)))), strict=True)), text)

    def hashes(batches):
        told = pa.schema([("place", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends", pa.string())])
        key, digest = None, None
        for batch in batches:
            out = []
            for *one, ids in zip(*(batch.column(c).to_pylist() for c in ("place", "a", "b", "ids")), strict=True):
                if one != key:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = one, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), told, strict=True)], schema=told)
        if key:
            yield pa.RecordBatch.from_pydict(dict(zip(told.names, ([x] for x in (*key, digest.hexdigest())), strict=True)), told)

    joined = members.repartitionByRange(n, "place", "a", "b", "conv_id").sortWithinPartitions("place", "a", "b", "conv_id").mapInArrow(blocks, "place long, a long, b long, first long, ids string")
    return joined.repartition(n, "place", "a", "b").sortWithinPartitions("place", "a", "b", "first").mapInArrow(hashes, "place long, a long, b long, ends string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    parts = partitions(spark)
    turns, convs = rebuilt(conversations)
    root = convs.agg(F.min("conv_id").alias("first"), F.count("*").alias("n"), F.sum("len").alias("turns")).first()
    if not root["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    bound = max(1, root["turns"] // (4 * parts))

    hashed = turns.withColumns({"fa": F.xxhash64("place", "a"), "fb": F.xxhash64("place", "b")}).drop("a", "b")
    paths = running(hashed, "conv_id", ["place"], ("fa", "fb")).select("conv_id", "len", "place", "bytes", F.col("run_fa").alias("a"), F.col("run_fb").alias("b"), F.col("before_fa").alias("pa"), F.col("before_fb").alias("pb"))
    nodes = checkpoint(paths.groupBy("place", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("bytes").alias("bytes"), F.sum(F.col("len") - F.col("place")).alias("below")))
    ends = ends_of(paths.where("place = len").select("place", "a", "b", "conv_id").unionByName(convs.where("len = 0").select("len", "conv_id").withColumnRenamed("len", "place").withColumns({"a": F.lit(0).cast("long"), "b": F.lit(0).cast("long")})))
    top = spark.createDataFrame([(0, 0, 0, root["first"], root["n"], 0, 0, 0, root["turns"])], "place long, a long, b long, conv_id long, n_convs long, pa long, pb long, bytes long, below long")
    heavy = top.unionByName(nodes.where(F.col("below") > bound))
    own = ((F.col("n_convs") - 1) * F.col("bytes")).alias("own")
    known_ends = F.coalesce("ends", F.lit(NO_IDS)).alias("ends")

    # light shards: whole subtrees, each below its uppermost light node
    shard = paths.join(_small(heavy.select("place", "a", "b")), ["place", "a", "b"], "left_anti").groupBy("conv_id").agg(F.min(F.struct("place", "a", "b")).alias("shard"))
    light = nodes.where(F.col("below") <= bound).join(shard, "conv_id").join(ends, ["place", "a", "b"], "left")
    zero = F.lit(0).cast("long")
    light = light.select((-F.col("place")).alias("t1"), F.col("a").alias("t2"), F.col("b").alias("t3"), (1 - F.col("place")).alias("u1"), F.col("pa").alias("u2"), F.col("pb").alias("u3"), (F.col("place") > F.col("shard.place")).alias("inside"), "conv_id", F.col("place").alias("depth"), "n_convs", own, zero.alias("x_children"), zero.alias("x_leaves"), zero.alias("x_saved"), known_ends, "shard")
    below = checkpoint(light.repartition(parts, "shard").sortWithinPartitions("t1", "t2", "t3").select(NODE).mapInArrow(forward, DONE))
    up = below.where("open").groupBy((F.col("depth") - 1).alias("place"), F.col("u2").alias("a"), F.col("u3").alias("b")).agg(F.count("*").alias("x_children"), F.sum("n_leaves").alias("x_leaves"), F.sum("saved_tokens").alias("x_saved"))

    # heavy shards: pieces of `bound` nodes along a path; what lies below their roots goes across shards first
    piece = lambda place: F.floor(place / bound).cast("long")
    parent = heavy.select((F.col("place") + 1).alias("place"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("p_conv"))
    spine = heavy.join(up, ["place", "a", "b"], "left").join(ends, ["place", "a", "b"], "left").join(parent, ["place", "pa", "pb"], "left")
    spine = checkpoint(spine.select("place", "a", "b", "pa", "pb", "conv_id", "p_conv", "n_convs", own, *[F.coalesce(c, zero).alias(c) for c in ("x_children", "x_leaves", "x_saved")], known_ends, piece(F.col("place")).alias("piece"), piece(F.col("place") - 1).alias("p_piece")))
    roots = spine.groupBy("conv_id", "piece").agg(F.min_by(F.struct("place", "pa", "pb", "p_conv", "p_piece"), "place").alias("r"), F.sum("x_leaves").alias("x_leaves"), F.sum(F.col("x_saved") + F.col("own")).alias("x_saved"))
    link = lambda c, absent: F.coalesce(F.col(c), F.lit(absent)).cast("long")
    roots = roots.select((-F.col("conv_id")).alias("t1"), (-F.col("piece")).alias("t2"), zero.alias("t3"), (-link("r.p_conv", 0)).alias("u1"), (-link("r.p_piece", 0)).alias("u2"), zero.alias("u3"), F.col("r.p_conv").isNotNull().alias("inside"), "conv_id", F.col("r.place").alias("depth"), zero.alias("n_convs"), zero.alias("own"), F.lit(1).cast("long").alias("x_children"), "x_leaves", "x_saved", F.concat_ws(",", F.col("r.pa"), F.col("r.pb")).alias("ends"))
    across = roots.repartition(1).sortWithinPartitions("t1", "t2").select(NODE).mapInArrow(forward, DONE)
    to = F.split("ends", ",")
    across = across.where("depth > 0").groupBy((F.col("depth") - 1).alias("place"), to[0].cast("long").alias("a"), to[1].cast("long").alias("b")).agg(F.count("*").alias("y_children"), F.sum("n_leaves").alias("y_leaves"), F.sum("saved_tokens").alias("y_saved"))
    # within a piece the root of the next piece is a child too, so only children of other pieces are added
    inside = (F.col("p_conv") == F.col("conv_id")) & (F.col("p_piece") == F.col("piece"))
    spine = spine.join(across, ["place", "a", "b"], "left").select((-F.col("place")).alias("t1"), F.col("a").alias("t2"), F.col("b").alias("t3"), (1 - F.col("place")).alias("u1"), F.col("pa").alias("u2"), F.col("pb").alias("u3"), F.coalesce(inside, F.lit(False)).alias("inside"), "conv_id", F.col("place").alias("depth"), "n_convs", "own", *[(F.col(f"x_{c}") + F.coalesce(f"y_{c}", zero)).alias(f"x_{c}") for c in ("children", "leaves", "saved")], "ends", "piece")
    above = spine.repartition(parts, "conv_id", "piece").sortWithinPartitions("t1", "t2", "t3").select(NODE).mapInArrow(forward, DONE)

    done = below.unionByName(above)
    opened = done.where("open").join(_small(heavy.select((F.col("place") + 1).alias("depth"), F.col("a").alias("u2"), F.col("b").alias("u3"), F.col("conv_id").alias("p_conv"))), ["depth", "u2", "u3"], "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    return done.where("NOT open").select(columns).unionByName(opened.withColumn("parent_conv_id", F.col("p_conv")).select(columns))
