"""Near-duplicate documents by bottom-k sketches from one hash function.

Each document becomes the set of its 5-word shingles, hashed to 64 bits; its sketch is the
``SKETCH`` smallest values. Documents with equal sets are one class, and only classes are compared.

Inverted lists of retained values generate overlaps. Two sets with a Jaccard similarity of 0.85
share at least ``_least_shared`` of their retained values (for sets within the sketch for certain,
else with a failure probability below 1e-10 per pair), so they meet in a list even if each class
leaves out that many less one of its values. It leaves out those in most sketches: passages that
many documents share make no long lists. What is left of long lists are large groups of near copies:
 1. each list compares its members with a hub only, the member whose values are the most common
    in the corpus, that is the one nearest to the consensus of its group. The union of both
    sketches estimates the similarity, and likely pairs are confirmed on the full sets;
 2. lists of one hub form a group. Groups that still span several components are dealt in pairs
    of blocks to tasks, which compare members outside the largest component with those of other
    components, first by their sketches and then, if enough is shared, by their full sets. A
    task returns only links that join two components.
So pairs within a found component are never looked at, no list of all pairs is ever made, and
every link is confirmed on the full sets, which are computed again for the classes in question.

Defined results: texts without a word (or NULL) have an empty set and no links; a row with a NULL
doc_id takes part, and its component is the smallest doc_id that is not NULL, if any; repeated
rows are equal sets; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.llm.common import WORD, col, free_name, small_batches
from tabulens.llm.graphs import components
from tabulens.session import cut_lineage

WORDS = 5
SKETCH = 48
#: Retained values that two linked sets beyond the sketch's size share at least.
SHARED = 20
#: A pair is looked at in full if its sketches estimate at least this similarity: the bound of meeting in a list.
ESTIMATE = SHARED / SKETCH
#: Percent of the union.
SIMILARITY = 85
#: Words whose hashes a task remembers at once, and texts whose sets it holds; only speed depends on these.
REMEMBERED, TEXTS = 150_000, 256
#: Pairs of one hub that one task verifies, about.
HUB_ROWS = 2_000
#: Members of a group in one block, and their values (8 bytes each), about.
BLOCK, BLOCK_VALUES = 4_096, 1_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingle_set(text: str | None, hashes: dict) -> np.ndarray:
    """The distinct hashed shingles of a text, ascending; the whole sequence is one if it has fewer words."""
    words = text.encode().lower().split() if text else []  # bytes.lower() changes A-Z only
    if not words:
        return np.empty(0, np.int64)
    each = np.array([hashes[w] for w in words], np.uint64)
    width = min(WORDS, len(each))
    count = len(each) - width + 1
    mixed = np.full(count, width, np.uint64)
    for i in range(width):
        mixed = mixed * _MIX + each[i : i + count]
        mixed ^= mixed >> np.uint64(29)
    mixed = np.sort(mixed.view(np.int64))  # sorting is several times as fast here as np.unique, which hashes
    return mixed[np.append(True, mixed[1:] != mixed[:-1])]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for whole in batches:
        for start in range(0, len(whole), TEXTS):  # only the sketches of more texts are held at once
            batch = whole.slice(start, TEXTS)
            sizes, keys, sketches = [], [], []
            for text in batch.column("text"):
                own = shingle_set(text.as_py(), hashes)
                sizes.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                sketches.append(own[:SKETCH].copy())
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "mark", "n", "key", "sketch"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        for start in range(0, len(batch), TEXTS):  # sets are larger than what the next step needs at once
            sets = [shingle_set(x.as_py(), hashes) for x in batch.column("text").slice(start, TEXTS)]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["key", "hashes"])


def _least_shared(n: Column) -> Column:
    return F.least(F.ceil(n * SIMILARITY / 100), F.lit(SHARED)).cast("int")


def estimated(a: Column, b: Column) -> Column:
    """Similarity from the bottom-k sketch of the union."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)


def _inverted(classes: DataFrame) -> DataFrame:
    """(value, c, weight): the lists of retained values with two members or more; weight: how common the member's values are."""
    retained = classes.select("c", F.explode("sketch").alias("value"))
    common = retained.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    counted = retained.join(common, "value", "left").select("c", "value", F.coalesce("df", F.lit(1)).alias("df"))
    own = counted.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("own"))  # at most SKETCH values
    own = own.join(classes.select("c", "n"), "c")
    left = F.slice("own", F.lit(1), F.size("own") - _least_shared(F.col("n")) + 1)
    weight = F.aggregate("own", F.lit(0.0), lambda s, x: s + x["df"]) / F.size("own")
    lists = own.select("c", weight.alias("weight"), F.explode(left).alias("x")).where("x.df > 1")
    return lists.select(F.col("x.value").alias("value"), "c", "weight")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. ``a`` may be the same for many pairs: its set is sent to as many tasks as they need."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).alias("parts"))
    first = sets.join(parts, sets["c"] == parts["a"]).select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "parts", F.col("hashes").alias("ha")
    )
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    second = dealt.join(sets.select(F.col("c").alias("b"), F.col("hashes").alias("hb")), "b")
    both = F.size(F.array_intersect("ha", "hb"))
    joined = second.join(first, ["a", "part"]).select("a", "b", both.alias("both"), (F.size("ha") + F.size("hb") - both).alias("either"))
    return joined.where(F.col("both") * 100 >= F.col("either") * SIMILARITY).select("a", "b")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose sketches estimate enough; what the first member's sketch is sent with is narrow."""
    sketch = classes.select("c", "n", "sketch")
    joined = pairs.join(sketch.toDF("b", "nb", "sb"), "b").join(sketch.toDF("a", "na", "sa"), "a")
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * SIMILARITY
    return joined.where(fits).where(estimated(F.col("sa"), F.col("sb")) >= ESTIMATE).select("a", "b")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (a, i, j) of batches that are sorted by them."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in ("a", "i", "j")], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        bounds = [0, *cuts.tolist(), len(batch)]
        for start, stop in zip(bounds, bounds[1:], strict=False):
            key = tuple(keys[start])
            if last is not None and key != last:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(start, stop - start))
            last = key
    if rest:
        yield pa.Table.from_batches(rest)


class _Group:
    """Members of one pair of blocks, with the number of values that they share."""

    def __init__(self, run: pa.Table, values: str):
        self.c, self.root, self.main, self.block = (run.column(k).to_numpy().copy() for k in ("c", "root", "main", "block"))
        lists = run.column(values).combine_chunks()
        self.ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten().to_numpy()
        _, self.flat = np.unique(flat, return_inverse=True)
        self.mark = np.zeros(int(self.flat.max(initial=0)) + 1, np.int32)
        self.sizes = np.diff(self.ends)
        self.across = run.column("i")[0].as_py() != run.column("j")[0].as_py()

    def shared(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each member outside the main component, what it shares with every member, and whom it is to be compared with."""
        for x in np.flatnonzero(self.root != self.main):
            own = self.flat[self.ends[x] : self.ends[x + 1]]
            self.mark[own] = 1
            counts = np.add.reduceat(self.mark[self.flat], self.ends[:-1])
            self.mark[own] = 0
            other = (self.block != self.block[x]) if self.across else (self.c != self.c[x])
            yield x, counts, other


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members whose sketch shares enough with one of another component."""
    for run in _runs(batches):
        group, near = _Group(run, "sketch"), set()
        for x, counts, other in group.shared():
            enough = np.ceil(ESTIMATE * np.maximum(group.sizes, group.sizes[x]) - 1e-9)
            hits = np.flatnonzero(other & (group.root != group.root[x]) & (counts >= enough))
            if len(hits):
                near.update(group.c[hits].tolist(), [int(group.c[x])])
        yield pa.RecordBatch.from_arrays([pa.array(sorted(near), pa.int64())], ["c"])


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between components, no more than join them."""
    for run in _runs(batches):
        group, a, b = _Group(run, "hashes"), [], []
        for x, counts, other in group.shared():
            similar = counts * 100 >= (group.sizes + group.sizes[x] - counts) * SIMILARITY
            for y in np.flatnonzero(other & similar & (group.root != group.root[x])):
                if group.root[y] != group.root[x]:
                    a.append(group.c[x])
                    b.append(group.c[y])
                    group.root[group.root == group.root[y]] = group.root[x]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _dealt(groups: DataFrame, roots: DataFrame, data: DataFrame, values: Column) -> DataFrame:
    """Groups with several components, in pairs of blocks: (a, i, j, block, c, root, main, and the column of ``data``); ``values``: how many of them a member has."""
    placed = groups.join(roots, groups["c"] == roots["node"], "left").select("a", "c", values.alias("values"), F.coalesce("root", "c").alias("root"))
    placed = cut_lineage(placed)  # narrow rows, needed twice
    sizes = placed.groupBy("a", "root").agg(F.count(F.lit(1)).alias("size"), F.sum("values").alias("values"))
    spread = sizes.groupBy("a").agg(
        F.max(F.struct("size", "root"))["root"].alias("main"),
        F.count(F.lit(1)).alias("parts"),
        F.sum("size").alias("members"),
        F.sum("values").alias("values"),
    )
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("values") / BLOCK_VALUES))
    spread = spread.where("parts > 1 AND members > 2").select("a", "main", blocks.alias("blocks"))
    placed = placed.join(spread, "a").withColumn("block", F.pmod(F.xxhash64("c"), "blocks"))
    dealt = placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("a", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "c", "root", "main")
    return dealt.join(data, "c").repartition("a", "i", "j").sortWithinPartitions("a", "i", "j", "c")


def links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): pairs of classes in one component, enough of them to connect all that confirmed links connect."""
    lists = cut_lineage(_inverted(classes))
    hubs = lists.groupBy("value").agg(F.max(F.struct("weight", "c")).alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    hubs = hubs.select("value", F.col("hub.c").alias("a"))
    groups = lists.join(hubs, "value").select("a", "c").distinct()
    groups = cut_lineage(groups.join(classes.select("c", "n"), "c"))
    likely = cut_lineage(_likely(groups.where("a <> c").select("a", F.col("c").alias("b")), classes))

    screened = _dealt(groups, components(likely), classes.select("c", "sketch"), F.least("n", F.lit(SKETCH))).mapInArrow(_screen, "c long")
    ends = likely.select("a").union(likely.select("b")).union(screened).distinct().toDF("c")
    wanted = cut_lineage(ends.join(classes.select("c", "id", "key"), "c"))
    texts = docs.join(wanted.select(F.col("id").alias("_id")), col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = texts.select("text").mapInArrow(_full_sets, "key binary, hashes array<long>").dropDuplicates(["key"])
    sets = cut_lineage(sets.join(wanted.select("c", "key"), "key").select("c", "hashes"))

    found = cut_lineage(_confirmed(likely, sets))
    close = groups.join(wanted.select("c"), "c", "left_semi").select("a", "c", "n")
    roots = components(found)
    crossed = _dealt(close, roots, sets, F.col("n")).mapInArrow(_cross, "a long, b long")
    # Each node's link to its root connects what the found pairs connect, so that few rounds are left.
    return roots.where("node <> root").toDF("a", "b").union(crossed)


def classes_of(sketched: DataFrame) -> DataFrame:
    """(c, key, id, n, sketch) of each class of equal sets that are not empty; id: its smallest doc_id."""
    same = sketched.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    return cut_lineage(same.withColumn("c", F.monotonically_increasing_id()))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n, key, sketch) of every document; mark: a hash of the text as it stands."""
    small_batches(docs.sparkSession)
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("mark", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("key", T.BinaryType()),
            T.StructField("sketch", T.ArrayType(T.LongType())),
        ]
    )
    return docs.select(col("doc_id").alias("doc_id"), F.xxhash64(col("text")).alias("mark"), col("text").alias("text")).mapInArrow(_sketches, schema)


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n_shingles, root, component_id) of the documents with words, and (doc_id, n_shingles) of the others."""
    sketched = cut_lineage(sketches(docs))
    classes = classes_of(sketched)
    roots = cut_lineage(components(links(classes, docs.select("doc_id", "text"))))
    ids = classes.join(roots, classes["c"] == roots["node"], "left").select("key", "id", F.coalesce("root", "c").alias("root"))
    ids = cut_lineage(ids)
    least = ids.groupBy("root").agg(F.min("id").alias("component_id"))
    named = ids.join(least, "root").select(F.col("key").alias("_key"), "root", "component_id")
    joined = sketched.where("n > 0").join(named, F.col("key") == F.col("_key"))
    return joined.select("doc_id", "mark", F.col("n").alias("n_shingles"), "root", "component_id"), sketched.where("n = 0")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    placed, alone = _placed(docs)
    alone = alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = placed.select("doc_id", "n_shingles", "component_id").union(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component: of those with the smallest doc_id (NULL is the largest) the one with the smallest hash of its text.

    Rows without words stay, every one of them.
    """
    placed, _ = _placed(docs)
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("mark").alias("mark"))
    first = placed.groupBy("root").agg(F.min(rank).alias("first"))
    own, kept_id, kept_mark = (free_name(docs, x) for x in ("_mark", "_kept_id", "_kept_mark"))
    keep = first.select(F.col("first.doc_id").alias(kept_id), F.col("first.mark").alias(kept_mark))
    marked = docs.withColumn(own, F.xxhash64(col("text")))
    wordy = F.coalesce(col("text").rlike(WORD), F.lit(False))
    same = col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_mark))
    kept = marked.where(wordy).join(keep, same, "left_semi").dropDuplicates(["doc_id", own])
    return kept.unionByName(marked.where(~wordy)).drop(own)
