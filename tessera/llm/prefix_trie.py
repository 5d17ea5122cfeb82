"""Conversation prefix tries: succinct level-order tries for each shard of prefixes, heavy upper levels on their own.

A conversation is a sequence of turns; a node stands for a distinct sequence of first d turns. Turns leave the texts
behind at once: a step is a 16-byte digest of role and text and the text's length. A prefix is told from others by
128 bits, the exclusive or of hashes of its digests with their places, which a window adds up.

1. Steps are grouped by prefix (partial sums first, so that a hot prefix is a few rows). A node of one conversation
   needs no trie: below it is that conversation's rest. The others are *shared*.
2. Shared nodes of more than ``limit`` conversations are *heavy*. They are the upper end of the tree, at most
   steps / limit of them, which is bounded (``HEAVY``). Below them hang light subtrees, dealt out by their top prefix.
3. A task builds one level-order (LOUDS) trie of all subtrees dealt to it: a bitvector of degrees and arrays by node in
   breadth-first order. The tries are a Parquet table. Rollups go through the levels from the last to the first with
   ``np.add.at``. Sums of the subtrees' tops are added to the heavy nodes, whose trie is rolled up last.

A shard's size: a light subtree has at most ``limit`` conversations, times the length that two of them share; only that
of two very long equal conversations isn't bounded by a parameter, at about 100 bytes a turn. The digest of the ids that
end in one node is a SHA-256, which can't be split: a task reads a hot node's ids in order, as strings of up to 4096,
and holds one of them.

Defined results: rows without conv_id belong to no conversation and are left out; a null role or text is empty; turns
go by ``turn``, null first, equal ones by digest, so that repeated rows are turns of their own; an empty table has no
nodes; other columns are not read; texts of any length count whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, int64, key_columns, partitions

#: Turns of a group's first conversation that the others may begin with.
MOST_HEAD = 5
#: Heavy nodes at most, and the fewest conversations that make a node heavy.
HEAVY, LEAST = 100_000, 1000
#: Nodes that a shard should have.
SHARD = 200_000
#: Conversation ids that are joined to one string before they are hashed.
CHUNK = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
ROLLED = "k1 long, k2 long, depth int, conv_id long, parent_conv_id long, q1 long, q2 long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_ends long, end_id long"
TRIES = "shard int, louds binary, labels binary, k1 array<long>, k2 array<long>, depth array<int>, conv_id array<long>, n_convs array<long>, n_ends array<long>, end_id array<long>, chars array<long>, q1 array<long>, q2 array<long>, sub_convs array<long>, sub_children array<long>, sub_leaves array<long>, sub_saved array<long>"
NODE = ["k1", "k2", "depth", "conv_id", "n_convs", "n_ends", "end_id", "chars", "sub_convs", "sub_children", "sub_leaves", "sub_saved"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, label, chars): turns in order, without their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = key_columns(conversations, ["conv_id", "turn", "role", "text"]).where("conv_id is not null")
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(F.unhex(digest), 1, 16).alias("label"), F.char_length(text).cast("long").alias("chars"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "label"))
    return turns.select("conv_id", pos.alias("pos"), "label", "chars")


def _hash(seed: int, label: str, depth: str) -> str:
    return f"xxhash64({seed}, {label}, cast({depth} as int))"


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their hundred: (steps, conversations) of ``numbered`` turns.

    Conversation c has the first h turns of conversation c - c % 100 (as many as it has), then its own behind its first
    h; h = crc32(c) % 6. conversations: (conv_id, total). A hundred conversations share one array of five turns at most.
    """
    first = F.array_sort(F.collect_list(F.struct("pos", "label", "chars")))
    head = turns.where(f"conv_id % 100 = 0 and pos <= {MOST_HEAD}").groupBy(F.col("conv_id").alias("base")).agg(first.alias("head"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.withColumns({"h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_HEAD + 1)).cast("int"), "base": F.expr("conv_id - conv_id % 100")})
    convs = convs.join(head, "base", "left").withColumn("head", F.expr("coalesce(slice(head, 1, h), cast(array() as array<struct<pos:int,label:binary,chars:bigint>>))"))
    convs = convs.selectExpr("conv_id", "h", "head", "size(head) as k", "cast(size(head) + greatest(n - h, 0) as int) as total")
    mix = lambda seed, upto: f"aggregate(slice(head, 1, {upto}), 0L, (a, x) -> a ^ {_hash(seed, 'x.label', 'x.pos')})"
    borrowed = convs.selectExpr(
        "conv_id", "total", f"inline(transform(head, x -> struct(x.pos as depth, {mix(1, 'x.pos')} as k1, {mix(2, 'x.pos')} as k2, {_hash(1, 'x.label', 'x.pos')} as p1, {_hash(2, 'x.label', 'x.pos')} as p2, x.label, x.chars)))"
    )
    own = turns.join(convs.selectExpr("conv_id", "h", "k", "total", f"{mix(1, 'k')} as x1", f"{mix(2, 'k')} as x2"), "conv_id").where("pos > h")
    own = own.selectExpr("*", "cast(k + pos - h as int) as depth").selectExpr("*", f"{_hash(1, 'label', 'depth')} as p1", f"{_hash(2, 'label', 'depth')} as p2")
    so_far = "over (partition by conv_id order by depth rows between unbounded preceding and current row)"
    own = own.selectExpr("conv_id", "total", "depth", f"(bit_xor(p1) {so_far}) ^ x1 as k1", f"(bit_xor(p2) {so_far}) ^ x2 as k2", "p1", "p2", "label", "chars")
    return borrowed.unionByName(own), convs.select("conv_id", "total")


class Trie:
    """A level-order trie of a forest: node 0 stands above all tops, node i + 1 is row i of the arrays."""

    def __init__(self, louds: np.ndarray, columns: dict[str, np.ndarray]):
        self.louds, self.columns = louds, columns
        ones = np.flatnonzero(louds)
        #: by row: the parent's node, that is the zeros before the row's one
        self.parent = np.cumsum(louds == 0)[ones]
        self.degree = np.diff(np.concatenate(([-1], np.flatnonzero(louds == 0)))) - 1

    @classmethod
    def build(cls, rows: dict[str, np.ndarray]) -> Trie:
        """rows: the columns of nodes with their own key (k1, k2) and their parent's (q1, q2), in any order."""
        n = len(rows["k1"])
        keys, above = _key(rows["k1"], rows["k2"]), _key(rows["q1"], rows["q2"])
        by_key = np.argsort(keys, kind="stable")
        at = np.minimum(np.searchsorted(keys[by_key], above), max(n - 1, 0))
        has = keys[by_key][at] == above if n else np.zeros(0, bool)
        parent = np.where(has & (rows["depth"] > 0), by_key[at] if n else 0, -1)
        level = np.zeros(n, np.int64)
        for d in np.unique(rows["depth"]):
            here = np.flatnonzero((rows["depth"] == d) & (parent >= 0))
            level[here] = level[parent[here]] + 1
        place, order, done = np.zeros(n + 1, np.int64), [], 1
        for depth in range(int(level.max()) + 1 if n else 0):
            here = np.flatnonzero(level == depth)
            here = here[np.lexsort((rows["k2"][here], rows["k1"][here], rows["conv_id"][here], place[parent[here]]))]  # place[-1] is 0: the node above
            place[here] = np.arange(done, done + len(here))
            order.append(here)
            done += len(here)
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        children = np.bincount(place[parent[order]], minlength=n + 1)
        louds = np.ones(2 * n + 1, np.uint8)
        louds[np.cumsum(children + 1) - 1] = 0
        return cls(louds, {c: v[order] for c, v in rows.items()})

    def levels(self) -> list[slice]:
        """Rows of each level, the tops first."""
        out, a, b = [], 0, int(self.degree[0])
        while a < b:
            out.append(slice(a, b))
            a, b = b, b + int(self.degree[a + 1 : b + 1].sum())
        return out

    def rollups(self) -> dict[str, np.ndarray]:
        """By row: children, childless nodes below and sums of (n_convs - 1) * chars; subtrees include their top."""
        c, n = self.columns, len(self.parent)
        inner = np.zeros(n + 1, np.int64)
        np.add.at(inner, self.parent, c["n_convs"])
        alone = c["n_convs"] - c["n_ends"] - inner[1:] - c["sub_convs"]  # children of one conversation each
        children = self.degree[1:] + c["sub_children"] + alone
        leaves, saved = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        leaves[1:] = (children == 0) + alone + c["sub_leaves"]
        saved[1:] = (c["n_convs"] - 1) * c["chars"] + c["sub_saved"]
        for rows in reversed(self.levels()):
            nodes = np.arange(rows.start, rows.stop) + 1
            np.add.at(leaves, self.parent[rows], leaves[nodes])
            np.add.at(saved, self.parent[rows], saved[nodes])
        return {"n_children": children, "n_leaves": leaves[1:], "saved_tokens": saved[1:]}


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of longs as one sortable value; equal exactly if the pairs are."""
    pair = np.stack([a, b], axis=1).astype(">u8") if len(a) else np.zeros((0, 2), ">u8")
    return np.ascontiguousarray(pair).view("S16").ravel()


def build_tries(nodes: DataFrame) -> DataFrame:
    """One row a partition of nodes (columns NODE, label, q1, q2): its trie. q1 and q2 are kept for the tops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        from pyspark import TaskContext

        table = pa.Table.from_batches(held)
        rows = {c: np.asarray(table.column(c)) for c in [*NODE, "q1", "q2"]}
        rows["label"] = np.frombuffer(b"".join(table.column("label").to_pylist()), "S16") if table.num_rows else np.zeros(0, "S16")
        trie = Trie.build(rows)
        c, tops = trie.columns, int(trie.degree[0])
        values = [[TaskContext.get().partitionId()], [np.packbits(trie.louds).tobytes()], [c["label"].tobytes()], *[[c[x]] for x in NODE[:8]], [c["q1"][:tops]], [c["q2"][:tops]], *[[c[x]] for x in NODE[8:]]]
        names = [f.split()[0] for f in TRIES.split(", ")]
        kinds = [pa.int32(), pa.binary(), pa.binary(), *[pa.list_(pa.int32() if n == "depth" else pa.int64()) for n in names[3:]]]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

    return nodes.select(*NODE, "label", "q1", "q2").mapInArrow(run, TRIES)


def roll_up(tries: DataFrame) -> DataFrame:
    """The nodes of written tries with their rollups (ROLLED). The tops' parent_conv_id is null, their parent's key kept."""
    names = [f.split()[0] for f in ROLLED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = {x: np.asarray(batch.column(x)[i].values) for x in NODE}
                n, tops = len(columns["k1"]), len(batch.column("q1")[i])
                trie = Trie(np.unpackbits(np.frombuffer(batch.column("louds")[i].as_py(), np.uint8), count=2 * n + 1), columns)
                out = columns | trie.rollups()
                above = np.concatenate(([0], columns["conv_id"]))[trie.parent]
                out["parent_conv_id"] = pa.array(above, mask=trie.parent == 0)
                for q in ("q1", "q2"):
                    key = np.zeros(n, np.int64)
                    key[:tops] = np.asarray(batch.column(q)[i].values)
                    out[q] = pa.array(key, mask=np.arange(n) >= tops)
                yield pa.RecordBatch.from_arrays([pa.array(out[x], pa.int32()) if x == "depth" else out[x] if isinstance(out[x], pa.Array) else int64(out[x]) for x in names], names)

    return tries.mapInArrow(run, ROLLED)


def end_digests(ends: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the wanted prefixes: the ids (ends: k1, k2, conv_id) in order, joined by commas."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = ends.groupBy("k1", "k2", F.expr(f"conv_id div {CHUNK}").alias("chunk")).agg(ids.alias("ids"))
    chunks = chunks.join(wanted.select("k1", "k2"), ["k1", "k2"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([int64([at[0]]), int64([at[1]]), pa.array([state.hexdigest()])], ["k1", "k2", "ends_sha256"])

        at, state = None, hashlib.sha256()
        for batch in batches:
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
                if at != (k1, k2):
                    if at:
                        yield row()
                    at, state = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if at:
            yield row()

    spread = chunks.repartition(partitions(ends.sparkSession), "k1", "k2").sortWithinPartitions("k1", "k2", "chunk")
    return spread.select("k1", "k2", "ids").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def prefix_nodes(steps: DataFrame, convs: DataFrame, stage: Stage, limit: int | None = None) -> DataFrame:
    """One row a node of the trie of all conversations. steps and convs as ``rebuilt`` gives them, written already.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    last = F.col("depth") == F.col("total")
    merged = steps.groupBy("k1", "k2", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(last).alias("n_ends"), F.coalesce(F.min(F.when(last, F.col("conv_id"))), F.lit(0)).alias("end_id"), F.min("chars").alias("chars"),
        F.min("label").alias("label"), F.expr("k1 ^ min(p1)").alias("q1"), F.expr("k2 ^ min(p2)").alias("q2"),
    )
    nodes = stage.write(merged, "nodes")
    if limit is None:
        n_steps = nodes.agg(F.sum("n_convs")).first()[0] or 0
        limit = max(LEAST, n_steps // HEAVY)
    nothing = {f"sub_{c}": F.lit(0).cast("long") for c in ("convs", "children", "leaves", "saved")}
    heavy = nodes.where(F.col("n_convs") > limit)  # at most steps / limit rows
    light = nodes.where(F.col("n_convs").between(2, limit))
    # a conversation's topmost light prefix is that of all its light nodes' shard
    tops = steps.join(F.broadcast(heavy.select("k1", "k2")), ["k1", "k2"], "left_anti").groupBy("conv_id").agg(F.min_by(F.struct("k1", "k2"), "depth").alias("top"))
    dealt = light.withColumns(nothing).join(tops, "conv_id")
    shards = max(partitions(steps.sparkSession), -(-light.count() // SHARD))
    tries = stage.write(build_tries(dealt.repartition(shards, "top")), "tries")
    rolled = stage.write(roll_up(tries), "light")

    below = rolled.where("q1 is not null").groupBy("q1", "q2").agg(F.sum("n_convs").alias("sub_convs"), F.count("*").alias("sub_children"), F.sum("n_leaves").alias("sub_leaves"), F.sum("saved_tokens").alias("sub_saved"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.expr("count_if(total = 0)").alias("n_ends"), F.expr("coalesce(min(conv_id) filter (where total = 0), 0)").alias("end_id")).where("n_convs > 0")
    root = root.select(zero.alias("k1"), zero.alias("k2"), F.lit(0).alias("depth"), "conv_id", "n_convs", "n_ends", "end_id", zero.alias("chars"), F.unhex(F.lit("00" * 16)).alias("label"), zero.alias("q1"), zero.alias("q2"))
    upper = heavy.select(root.columns).unionByName(root).join(below.withColumnsRenamed({"q1": "k1", "q2": "k2"}), ["k1", "k2"], "left").fillna(0, list(nothing))
    # HEAVY nodes at most, whatever the input
    above = stage.write(roll_up(stage.write(build_tries(upper.repartition(1)), "upper_tries")), "upper")

    parents = F.broadcast(above.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("upper_id")))
    low = rolled.join(parents, ["q1", "q2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "upper_id")).drop("upper_id")
    shared = low.select(rolled.columns).unionByName(above)
    digests = end_digests(steps.where(last).select("k1", "k2", "conv_id").unionByName(convs.where("total = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id")), shared.where("n_ends > 1"))
    of_one = F.sha2(F.col("end_id").cast("string"), 256)
    ends = F.when(F.col("n_ends") == 0, F.lit(EMPTY)).when(F.col("n_ends") == 1, of_one).otherwise(F.col("ends_sha256"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = shared.join(digests, ["k1", "k2"], "left").withColumn("ends_sha256", ends).withColumn("depth", F.col("depth").cast("long"))

    # below a node of one conversation there is that conversation alone
    one = nodes.where("n_convs = 1").select("q1", "q2", "conv_id", "depth", "n_convs", "n_ends", "end_id")
    owner = rolled.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("light_id"))
    one = one.join(parents, ["q1", "q2"], "left").join(owner, ["q1", "q2"], "left")
    one = one.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.coalesce("upper_id", "light_id", "conv_id").alias("parent_conv_id"), "n_convs", (1 - F.col("n_ends")).alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), F.when(F.col("n_ends") == 0, F.lit(EMPTY)).otherwise(of_one).alias("ends_sha256"),
    )
    return shared.select(out).unionByName(one.select(out))


def conversation_trie(conversations: DataFrame, stage: Stage, limit: int | None = None) -> DataFrame:
    """``prefix_nodes`` of the rebuilt conversations. limit: conversations above which a node is heavy."""
    turns = stage.write(numbered(conversations), "turns")
    steps, convs = rebuilt(turns)
    return prefix_nodes(stage.write(steps, "steps"), stage.write(convs, "convs"), stage, limit)
