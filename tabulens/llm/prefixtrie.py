"""The prefix tree of conversations: how many share each beginning, and what sharing saves.

 1. Turns travel as a 16-byte key of role and text and their number of words. Sorted by
    conversation, each task streams them into steps: one for each beginning, named by a digest
    of the beginning before it and the turn.
 2. Beginnings with more than a hundred-thousandth of all steps (and ``least`` members at least)
    are upper nodes; there are fewer than a hundred thousand of them, whatever the corpus.
    What hangs below them are whole subtrees, dealt to prefix shards by their tops.
 3. A shard gives its turns dense ids and packs its nodes into one double array: the child of
    state s by turn id c is cell BASE[s] + c, and CHECK of that cell is s. Traversing it, level by
    level and back, gives members, children, leaves and saved words of every node.
 4. What the shards found below each upper node is summed up globally, and the upper nodes are
    packed and traversed in the same way with these sums to start from.
So a beginning that a third of all conversations share is split below it, and equal conversations
are one path. A conversation's path lies in one shard, about 100 bytes for each of its turns.

Defined results: a NULL role or text is an empty one; turns are ordered by their number, NULL
first, and by their keys where numbers tie; rows without a conv_id belong to no conversation and
are left out; repeated rows are turns of their own; an empty table has no nodes, not even a root;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import col, word_count
from tabulens.session import cut_lineage

#: Upper nodes are fewer than this; and the members that a subtree has without being cut.
UPPER_NODES, LEAST = 100_000, 1_000
#: Steps that fall to a shard, about.
SHARD_STEPS = 50_000
#: Conversations whose ids are joined to one text before they are hashed.
ID_RUN = 1 << 14
#: Free cells that are tried for a state with several children before new ones are added.
TRIES = 32

ROOT = b""


def keyed(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, key, words) of every turn; places count from 1."""
    role, text = (F.coalesce(col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where(col("conv_id").isNotNull()).select(
        col("conv_id").cast("long").alias("conv_id"), col("turn").alias("turn"), key.alias("key"), word_count(text).alias("words")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "key", "words")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """``turns`` where each conversation begins as the first of its family of ``family`` ids does.

    Its first h turns are those of that conversation (all if it has fewer, none if it is absent),
    with h = crc32(conv_id as text) % ``most``; they stand for its own first h turns. A row with place 0
    and no key stands for each conversation, so one without turns is not lost.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = turns.where(F.col("place") > h).select("conv_id", (F.col("place") + most).alias("place"), "key", "words")
    ids = turns.select("conv_id").distinct()
    firsts = turns.where((F.col("conv_id") % family == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "first")
    wanted = ids.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("wanted")).where("h > 0")
    taken = wanted.join(firsts, (F.col("first") == F.col("wanted")) & (F.col("place") <= F.col("h")))
    markers = ids.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("words"))
    return taken.select("conv_id", "place", "key", "words").union(own).union(markers)


_STEP = "conv_id long, depth long, node binary, parent binary, turn binary, words long, top binary, ends boolean"
_STEP_NAMES = [f.split()[0] for f in _STEP.split(", ")]


def _stepped(upper: frozenset[bytes]):
    """Rows sorted by conversation and place to steps; ``top`` names the subtree below the upper nodes."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, step = None, None
        for batch in batches:
            rows = []
            for c, key, words in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "key", "words")), strict=True):
                if c != conv:
                    if step is not None:
                        rows.append((*step, True))
                    conv, step = c, (c, 0, ROOT, None, None, 0, None)
                if key is None:
                    continue
                rows.append((*step, False))
                parent, top = step[2], step[6]
                node = hashlib.blake2b(parent + key, digest_size=16).digest()
                step = (c, step[1] + 1, node, parent, key, words, top if top is not None or node in upper else node)
            if rows:
                yield _batch(rows)
        if step is not None:
            yield _batch([(*step, True)])

    return steps


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    columns = [pa.array(x, kinds[f.split()[1]]) for x, f in zip(zip(*rows, strict=True), _STEP.split(", "), strict=True)]
    return pa.RecordBatch.from_arrays(columns, _STEP_NAMES)


class DoubleArray:
    """States and their children by dense labels. State 0 is the root; ``cells[i]`` is the state of node i.

    ``parents`` are the numbers of the nodes' parents (-1: the root), which stand before their
    children; ``labels`` are their dense labels, distinct among the children of one parent.
    """

    def __init__(self, parents: np.ndarray, labels: np.ndarray):
        size = len(parents)
        self.base, self.check = np.zeros(2 * size + 2, np.int64), np.full(2 * size + 2, -1, np.int64)
        self.cells = np.zeros(size, np.int64)
        self._used, self._free = np.zeros(2 * size + 2, bool), 1
        self._used[0] = True
        order = np.lexsort((labels, parents))
        bounds = np.flatnonzero(np.diff(parents[order], prepend=-2, append=size))
        for start, stop in zip(bounds, bounds[1:], strict=False):  # by parent: its own cell is set before its children's
            own = order[start:stop]
            state = 0 if parents[own[0]] < 0 else self.cells[parents[own[0]]]
            self.base[state] = base = self._place(labels[own])
            self.cells[own] = base + labels[own]
            self.check[base + labels[own]] = state
            self._used[base + labels[own]] = True

    def _place(self, codes: np.ndarray) -> int:
        """A base whose cells are free for all codes, ascending; the lowest free cell for a single one."""
        while self._free < len(self._used) and self._used[self._free]:
            self._free += 1
        steps = codes - codes[0]
        if len(codes) > 1:
            for cell in (np.flatnonzero(~self._used[self._free : self._free + 8 * TRIES])[:TRIES] + self._free).tolist():
                if cell + steps[-1] < len(self._used) and not self._used[cell + steps].any():
                    return cell - int(codes[0])
            cell = len(self._used) - int(np.argmax(self._used[::-1]))  # behind the last used one
        else:
            cell = self._free
        if (more := cell + int(steps[-1]) + 1 - len(self._used)) > 0:
            more += len(self._used)
            self.base, self.check = np.append(self.base, np.zeros(more, np.int64)), np.append(self.check, np.full(more, -1, np.int64))
            self._used = np.append(self._used, np.zeros(more, bool))
        return cell - int(codes[0])

    def child(self, state: int, label: int) -> int | None:
        cell = int(self.base[state]) + label
        return cell if 0 < cell < len(self.check) and self.check[cell] == state else None

    def levels(self) -> list[np.ndarray]:
        """The states of each depth, from the root down."""
        cells = np.flatnonzero(self.check >= 0)
        cells = cells[np.argsort(self.check[cells], kind="stable")]
        above, found = self.check[cells], [np.zeros(1, np.int64)]
        while True:
            first, last = (np.searchsorted(above, found[-1], side) for side in ("left", "right"))
            count = last - first
            if not count.sum():
                return found
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found.append(np.sort(cells[np.repeat(first, count) + inner]))


_NODE = (
    "node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, is_top boolean"
)
#: What a node brings along: its own conversations' ends, or what shards found below it.
_OWN = ("members", "least", "children", "leaves", "saved")


def _traversed(table: pa.Table) -> pa.Table:
    """The aggregates of all nodes of a shard, by one double array over its subtrees."""
    table = table.sort_by("depth")
    nodes, above = table.column("node").to_pylist(), table.column("parent").to_pylist()
    number = {node: i for i, node in enumerate(nodes)}
    parents = np.array([number.get(p, -1) for p in above], np.int64)
    turns = table.column("turn").fill_null(ROOT).combine_chunks().dictionary_encode()
    labels = turns.indices.to_numpy().astype(np.int64)
    tops = np.flatnonzero(parents < 0)
    labels[tops] = len(turns.dictionary) + np.arange(len(tops))  # tops of different parents may be of equal turns
    trie = DoubleArray(parents, labels)

    def spread(values: np.ndarray, rest: int) -> np.ndarray:
        out = np.full(len(trie.check), rest, np.int64)
        out[trie.cells] = values
        return out

    own = {n: table.column(n).to_numpy() for n in ("words", *_OWN)}
    far = np.iinfo(np.int64).max
    members, least, children, leaves, saved = (spread(own[n], far if n == "least" else 0) for n in _OWN)
    words, levels = spread(own["words"], 0), trie.levels()
    for level in reversed(levels[1:]):
        leaves[level[children[level] == 0]] = 1
        saved[level] += (members[level] - 1) * words[level]
        up = trie.check[level]
        for total, step in ((members, members[level]), (leaves, leaves[level]), (saved, saved[level]), (children, 1)):
            np.add.at(total, up, step)
        np.minimum.at(least, up, least[level])
    cells, up = trie.cells, trie.check[trie.cells]
    columns = [table.column("node"), table.column("parent"), table.column("depth"), least[cells], pa.array(least[up], mask=up == 0)]
    columns += [members[cells], children[cells], leaves[cells], saved[cells], up == 0]
    names = [f.split()[0] for f in _NODE.split(", ")]
    return pa.Table.from_arrays([x if isinstance(x, (pa.ChunkedArray, pa.Array)) else pa.array(x) for x in columns], names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the texts of each node, comma-joined, from rows sorted by node and place."""
    node, state = None, None
    for batch in batches:
        done = []
        for key, text in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], ["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def steps_of(turns: DataFrame, upper_nodes: int = UPPER_NODES, least: int = LEAST) -> DataFrame:
    """Every beginning of every conversation, from (conv_id, place, key, words); see ``rebuilt`` for rows without a key."""
    ordered = cut_lineage(turns).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    members = ordered.mapInArrow(_stepped(frozenset()), _STEP).groupBy("node").agg(F.count(F.lit(1)).alias("members"))
    members = cut_lineage(members)
    steps = members.agg(F.sum("members")).first()[0] or 0
    limit = max(least, -(-steps // upper_nodes))
    upper = members.where(F.col("members") > limit).select("node").collect()  # fewer than upper_nodes rows of 16 bytes
    return cut_lineage(ordered.mapInArrow(_stepped(frozenset(r["node"] for r in upper) | {ROOT}), _STEP))


def _nodes(steps: DataFrame) -> DataFrame:
    """One row for each distinct beginning, with the conversations that end there."""
    nodes = steps.groupBy("node").agg(
        *(F.first(n).alias(n) for n in ("parent", "depth", "turn", "words", "top")),
        F.count_if("ends").alias("members"),
        F.min(F.when(F.col("ends"), F.col("conv_id"))).alias("least"),
    )
    none = F.lit(0).cast("long")
    far = F.lit(2**63 - 1)
    return nodes.select("*", *(none.alias(n) for n in ("children", "leaves", "saved"))).withColumn("least", F.coalesce("least", far))


def prefix_tree(turns: DataFrame, upper_nodes: int = UPPER_NODES, least: int = LEAST, shard_steps: int = SHARD_STEPS) -> DataFrame:
    """All nodes: (node, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns`` has (conv_id, place, key, words). ``node`` and ``parent`` name beginnings; the root's name is empty.
    """
    steps = steps_of(turns, upper_nodes, least)
    nodes = cut_lineage(_nodes(steps))
    shards = -(-nodes.count() // shard_steps) or 1
    below = nodes.where("top IS NOT NULL").withColumn("shard", F.pmod(F.xxhash64("top"), F.lit(shards)))
    lower = cut_lineage(below.groupBy("shard").applyInArrow(_traversed, _NODE))

    found = lower.where("is_top").groupBy(F.col("parent").alias("_parent")).agg(
        F.sum("n_convs").alias("_members"), F.min("conv_id").alias("_least"), F.count(F.lit(1)).alias("_children"),
        F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"),
    )
    upper = nodes.where("top IS NULL").join(found, F.col("node") == F.col("_parent"), "left")
    sums = [(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in _OWN if n != "least"]
    upper = upper.select("node", "parent", "depth", "turn", "words", *sums, F.least("least", "_least").alias("least"))
    # Fewer than upper_nodes rows, so one task and a broadcast hold them.
    upper = cut_lineage(upper.groupBy(F.lit(0).alias("all")).applyInArrow(_traversed, _NODE))

    names = F.broadcast(upper.select(F.col("node").alias("_node"), F.col("conv_id").alias("_conv")))
    lower = lower.join(names, F.col("is_top") & (F.col("parent") == F.col("_node")), "left")
    lower = lower.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_conv")).drop("_node", "_conv")

    run = F.floor(F.col("conv_id") / ID_RUN)
    ends = steps.where("ends").groupBy("node", run.alias("run")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))  # ID_RUN ids at most
    ends = ends.select("node", "run", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    hashes = ends.repartition("node").sortWithinPartitions("node", "run").mapInArrow(_hashed, "node binary, ends_sha256 string")
    out = upper.union(lower).drop("is_top").join(hashes, "node", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
