"""Prefix trie of conversations by an LCP-aware external mergesort.

A conversation is the path of its turns' digests. Tasks sort bounded runs of different
paths and note how many turns each shares with the one before it (its LCP); the runs
are written, dealt by ranges of paths, and merged in each range by a loser tree that
compares two paths only from the turns on which their LCPs agree. The merged stream
drives a stack of open nodes: what a path doesn't share with the one before is
finished, and goes out. Nodes on the first and last path of a range may go on in the
next; they are few, are summed by their digest, and a second stack in path order
finishes them.

A node is known by the MD5 of its turns' digests. A conversation's path has 16 bytes a
turn and lies in one task; texts do not. Members that end at one node are hashed in a
stream, ordered by their ids.

Defined results: turns are ordered by turn (null first), role and text; null role or
text is empty; repeated rows are turns of their own; rows of null conv_id are one
conversation, not rebuilt, which counts as a member and has no id (least is over the
others, and the hash leaves it out); ids below 0 find their head by the remainder with
the id's sign; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonolith.llm.common import bounded_batches, join_one, stable

#: Bytes of a turn in a path.
WIDTH = 16
#: Paths and bytes of paths of a run that a task sorts at once, and bytes of a range that one merges.
RUN_PATHS, RUN_BYTES, RANGE_BYTES = 1 << 16, 1 << 25, 1 << 25
#: Stands for no id.
NO_ID = (1 << 63) - 1
#: Rows of a batch that a task gives out.
OUT = 1 << 13


def paths(conversations: DataFrame, modulo: int = 5, heads: int = 9) -> DataFrame:
    """conv_id, path (digests of its turns in order), sizes (bytes of their texts), after
    each conversation took the first h turns of the one whose id is the multiple of
    `modulo` below, h from 0 to heads - 1 by the crc32 of its id."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    turns = turns.select("conv_id", F.row_number().over(order).alias("pos"), digest.alias("digest"), F.octet_length("text").alias("size"))
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "size"))).alias("turns"))
    own = stable(own, "trie-turns")
    base = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % modulo).join(base, "base", "left")
    h = F.when(F.col("conv_id").isNull(), 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), h))
    tail = F.slice("turns", h + 1, F.size("turns"))
    both = both.select("conv_id", F.concat(head, tail).alias("turns"))
    return both.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), "")).alias("path"), F.transform("turns", lambda x: x["size"].cast("long")).alias("sizes"))


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two paths share, of which the first `known` are."""
    most = min(len(a), len(b)) // WIDTH
    while known < most and a[known * WIDTH : (known + 1) * WIDTH] == b[known * WIDTH : (known + 1) * WIDTH]:
        known += 1
    return known


@dataclass
class Row:
    path: bytes
    lcp: int  # turns shared with the row before it in its run, or with the last winner
    sizes: list
    n: int
    least: int


def _runs(most: int):
    """Sorted runs of bounded size, each path with its LCP."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size, name = 0, TaskContext.get().partitionId() << 24

        def done() -> pd.DataFrame:
            held.sort(key=lambda x: x[0])
            lcps = [0, *(shared(x[0], y[0]) for x, y in zip(held, held[1:], strict=False))]
            return pd.DataFrame([(name, *x, lcp) for x, lcp in zip(held, lcps, strict=True)], columns=["run", "path", "sizes", "n", "least", "lcp"])

        for batch in batches:
            for path, sizes, n, least in zip(batch["path"], batch["sizes"], batch["n"], batch["least"], strict=True):
                held.append((bytes(path), sizes, n, least))
                size += len(path)
                if len(held) >= most or size >= RUN_BYTES:
                    yield done()
                    held.clear()
                    size, name = 0, name + 1
        if held:
            yield done()

    return run


def merged(runs: list[Iterator[Row]]) -> Iterator[Row]:
    """Rows of all runs in the order of paths, each with its LCP to the one before.

    A loser tree: inner nodes hold the loser of their match, and only the winner's own
    matches are played again. All rows carry their LCP to the last winner, which they
    follow; of two, the one that shares more comes first, and only equal LCPs are compared."""
    k = len(runs)
    rows: list[Row | None] = [next(r, None) for r in runs]
    for row in rows:
        row.lcp = 0
    losers: list[int] = [-1] * k

    def match(a: int, b: int) -> tuple[int, int]:
        x, y = rows[a], rows[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if x.lcp != y.lcp:
            return (a, b) if x.lcp > y.lcp else (b, a)
        at = shared(x.path, y.path, x.lcp)
        if x.path[at * WIDTH :] <= y.path[at * WIDTH :]:
            y.lcp = at
            return a, b
        x.lcp = at
        return b, a

    # Leaves k .. 2k - 1 are the runs; node i plays the winners of 2i and 2i + 1.
    winners = [-1] * k + list(range(k))
    for i in range(k - 1, 0, -1):
        winners[i], losers[i] = match(winners[2 * i], winners[2 * i + 1])
    first = winners[1] if k > 1 else 0
    while rows[first] is not None:
        yield rows[first]
        rows[first] = next(runs[first], None)  # its LCP in the run is that to the last winner
        i = (first + k) // 2
        while i >= 1:
            first, losers[i] = match(first, losers[i])
            i //= 2


@dataclass
class Node:
    digest: "hashlib._Hash"
    edge: bool  # on the first or last path of its range
    size: int  # bytes of its last text
    n: int = 0  # members
    least: int = NO_ID
    children: int = 0
    leaves: int = 0
    saved: int = 0

    def close(self) -> None:
        """All that stands beneath is in: a node without children is a leaf itself."""
        self.leaves = self.leaves if self.children else 1
        self.saved += (self.n - 1) * self.size

    def take(self, child: Node) -> None:
        self.n += child.n
        self.least = min(self.least, child.least)
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved


NODE = "key binary, parent binary, depth long, least long, n long, children long, leaves long, saved long"
EDGE = "edge boolean, part long, side int, size long"
_COLUMNS = [x.split()[0] for x in f"{NODE}, {EDGE}".split(", ")]


def nodes_of(rows: Iterator[Row], part: int) -> Iterator[tuple]:
    """The nodes of one range's merged stream. Those on its first and last path go out
    as edges, without what edges beneath them hold."""
    stack: list[Node] = []

    def out(depth: int, side: int) -> tuple:
        node, above = stack[depth], stack[depth - 1] if depth else None
        if not node.edge:
            node.close()
            above.take(node)
        return (node.digest.digest(), above.digest.digest() if above else None, depth, node.least, node.n, node.children, node.leaves, node.saved, node.edge, part, side, node.size)

    first = True
    for row in rows:
        if not stack:
            stack.append(Node(hashlib.md5(), True, 0))
        while len(stack) - 1 > row.lcp:
            yield out(len(stack) - 1, 0)
            stack.pop()
        for d in range(len(stack) - 1, len(row.path) // WIDTH):
            digest = stack[-1].digest.copy()
            digest.update(row.path[d * WIDTH : (d + 1) * WIDTH])
            stack.append(Node(digest, first, int(row.sizes[d])))
        stack[-1].n += row.n
        stack[-1].least = min(stack[-1].least, row.least)
        first = False
    last = [not node.edge for node in stack]
    for node in stack:
        node.edge = True
    while stack:
        yield out(len(stack) - 1, int(last[len(stack) - 1]))
        stack.pop()


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of a range, whose rows come run after run."""
    runs: list[list[Row]] = []
    name = None
    for batch in batches:
        for run, path, sizes, n, least, lcp in zip(*(batch[c] for c in ("run", "path", "sizes", "n", "least", "lcp")), strict=True):
            if run != name:
                runs.append([])
                name = run
            runs[-1].append(Row(bytes(path), lcp, sizes, n, least))
    if not runs:
        return
    held = []
    for node in nodes_of(merged([iter(r) for r in runs]), TaskContext.get().partitionId()):
        held.append(node)
        if len(held) >= OUT:
            yield pd.DataFrame(held, columns=_COLUMNS)
            held = []
    yield pd.DataFrame(held, columns=_COLUMNS)


@dataclass
class Open:
    row: tuple
    node: Node = field(default=None)


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of all ranges, summed and in path order: a stack hands each one's sums to its parent."""
    stack: list[Open] = []
    held: list[tuple] = []

    def pop() -> None:
        top = stack.pop()
        top.node.close()
        if stack:
            stack[-1].node.take(top.node)
        key, parent, depth = top.row
        held.append((key, parent, depth, top.node.least, top.node.n, top.node.children, top.node.leaves, top.node.saved))

    names = ["key", "parent", "depth", "least", "n", "children", "leaves", "saved", "size"]
    for batch in batches:
        for key, parent, depth, least, n, children, leaves, saved, size in zip(*(batch[c] for c in names), strict=True):
            while stack and stack[-1].row[2] >= depth:
                pop()
            stack.append(Open((key, parent, depth), Node(None, True, size, n, least, children, leaves, saved)))
        if len(held) >= OUT:
            yield pd.DataFrame(held, columns=names[:-1])
            held.clear()
    while stack:
        pop()
    yield pd.DataFrame(held, columns=names[:-1])


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, ends_sha256) of rows sorted by key and id, an id at a time."""
    key, digest, some = None, hashlib.sha256(), False
    for batch in batches:
        out = []
        for k, conv_id in zip(batch["key"], batch["id"], strict=True):
            if k != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest, some = k, hashlib.sha256(), False
            digest.update((b"," if some else b"") + conv_id.encode())
            some = True
        yield pd.DataFrame(out, columns=["key", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "ends_sha256"])


def nodes(members: DataFrame, range_bytes: int = RANGE_BYTES, run_paths: int = RUN_PATHS) -> DataFrame:
    """key, parent, depth, least, n, children, leaves, saved of each trie node of the
    members (conv_id, path, sizes)."""
    spark = members.sparkSession
    bounded_batches(spark)
    apart = members.groupBy("path").agg(F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.coalesce(F.min("conv_id"), F.lit(NO_ID)).alias("least"))
    runs = stable(apart.mapInPandas(_runs(run_paths), "run long, path binary, sizes array<long>, n long, least long, lcp long"), "trie-runs")
    total = runs.agg(F.coalesce(F.sum(F.length("path") + 64), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // range_bytes + 1)
    ranges = runs.repartitionByRange(parts, "path").sortWithinPartitions("run", "path")
    made = stable(ranges.mapInPandas(_merge, f"{NODE}, {EDGE}"), "trie-nodes")
    # An edge's place in path order is that of its first occurrence.
    edges = made.where("edge").groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("least").alias("least"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.first("size").alias("size"), F.min(F.struct("part", "side", "depth")).alias("at"))
    edges = edges.repartition(1).sortWithinPartitions("at").drop("at").mapInPandas(_finish, NODE)
    return stable(made.where(~F.col("edge")).drop("edge", "part", "side", "size").unionByName(edges), "trie-finished")


def trie(conversations: DataFrame, range_bytes: int = RANGE_BYTES, run_paths: int = RUN_PATHS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    members = stable(paths(conversations), "trie-members")
    found = nodes(members, range_bytes, run_paths)
    above = found.where("children > 0").select(F.col("key").alias("parent"), F.col("least").alias("above"), F.col("children").alias("siblings"))
    below = found.where("parent is not null")
    joined = join_one(below, stable(above, "trie-parents"), "parent", "siblings", found.count()).drop("siblings")
    joined = joined.unionByName(found.where("parent is null").withColumn("above", F.lit(None).cast("long")))
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = members.where("conv_id is not null").select(F.unhex(F.md5("path")).alias("key"), "conv_id")
    ends = ends.repartition(parts, "key").sortWithinPartitions("key", "conv_id").select("key", F.col("conv_id").cast("string").alias("id")).mapInPandas(_ends, "key binary, ends_sha256 string")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return joined.join(ends, "key", "left").select(
        real("least").alias("conv_id"),
        "depth",
        real("above").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def report(conversations: DataFrame) -> DataFrame:
    return trie(conversations)
