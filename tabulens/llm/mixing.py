"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

The words of a source, its documents in the order of a hash, form one stream. A source with the
target ``t`` gives the first ``t`` words of that stream repeated, cut into blocks of
``block_words`` (the last block may be shorter). The schedule deals all blocks over positions:
the blocks of all sources stand side by side on a line (the cumulative weights, in blocks), and
van der Corput points, taken in their order, hit that line. As many points as the next power of
two hit every block exactly once, so every source gets exactly its blocks, and every stretch of
the schedule holds the sources close to their weights. The rank of a slot among those of its
source has a closed form (a count of residues per bit), so no sort by source is needed and a hot
source is never one task.

Defined results: a NULL text has size 0; a NULL source is a source of its own, after all others;
documents of size 0 are taken with 0 words; repeated rows (also of doc_id) count each for
themselves; an empty table gives an empty result; extra columns are ignored by the query and
carried along by ``mixed_documents``. Ties in the order are broken by doc_id and size, so reruns
agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import col, free_name, word_count
from tabulens.session import cut_lineage

BLOCK_WORDS = 4096
#: A source's target is at most this many times its size.
MOST_REPEATS = 3
#: Documents that one task puts in order, about.
ORDERED_ROWS = 4_000


def targets(sizes: DataFrame, repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) of (source, source_size).

    Weights are 1, 2, 3, repeating, by code point, NULL last. All words are shared by weight; no
    target exceeds ``repeats`` times the size, and what is cut off is shared again by weight.
    Sources in the order of size for weight: those whose limit is reached come first, so the
    final level is the first one that does not exceed the next limit.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("limit_level"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = repeats * F.col("source_size")
    levels = (
        weighed.withColumn("limit_level", cap / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("all_words") - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(rest))
        .withColumn("place", F.row_number().over(order))
        .withColumn("final", F.min(F.when(F.col("level") <= F.col("limit_level"), F.struct("place", "level"))).over(everything)["level"])
    )
    return levels.select(
        "source", "source_size", "weight",
        F.least(F.col("final") * F.col("weight"), cap.cast("double")).alias("target"),
    )


def _reversed_bits(x: Column, bits: int) -> Column:
    """``x`` read backwards as a number of ``bits`` bits: the order of van der Corput points."""
    return F.conv(F.reverse(F.lpad(F.conv(x.cast("string"), 10, 2), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def _below(position: Column, start: Column, stop: Column, bits: int) -> Column:
    """How many of the line's points in [start, stop) the schedule hits before ``position``.

    A set bit of the position stands for all positions that agree above it and have it clear;
    on the line these are the points of one residue class, which a division counts.
    """
    total = F.lit(0).cast("long")
    residue = F.lit(0).cast("long")
    for level in range(bits):
        bit = F.shiftright(position, bits - 1 - level).bitwiseAND(F.lit(1))
        up_to = lambda end, residue=residue, level=level: F.shiftright(end - residue + (2 << level) - 1, level + 1)
        total = total + bit * (up_to(stop) - up_to(start))
        residue = residue + bit * F.lit(1 << level).cast("long")
    return total.cast("long")


def schedule(shares: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(position, source, rank) of every block: ``rank`` counts the blocks of a source, from 0.

    ``shares`` has (source, words): the words to take. Slots are made from ranges, in as many
    tasks as there are partitions.
    """
    blocks = shares.withColumn("blocks", F.ceil(F.col("words") / block_words).cast("long")).where("blocks > 0")
    line = Window.orderBy(F.col("source").asc_nulls_last())
    placed = blocks.withColumn("stop", F.sum("blocks").over(line)).withColumn("start", F.col("stop") - F.col("blocks"))
    placed = cut_lineage(placed)
    total = placed.agg(F.max("stop")).first()[0] or 0
    bits = max(0, (total - 1).bit_length())
    chunk = 65_536
    chunks = placed.select("source", "start", "stop", F.explode(F.sequence(F.col("start"), F.col("stop") - 1, F.lit(chunk))).alias("first"))
    chunks = chunks.repartition(F.col("first"))
    slots = chunks.select(
        "source", "start", "stop",
        F.explode(F.sequence(F.col("first"), F.least(F.col("stop"), F.col("first") + chunk) - 1)).alias("point"),
    )
    slots = slots.withColumn("position", _reversed_bits(F.col("point"), bits))
    return slots.select("position", "source", _below(F.col("position"), F.col("start"), F.col("stop"), bits).alias("rank"))


def _streams(sized: DataFrame) -> DataFrame:
    """Adds ``lo``, the words of the same source before each document, in the order of a hash.

    Documents are cut into ranges of the hash, so that no task orders a whole source; the sums of
    the ranges, a few rows per source, give each range its start.
    """
    ranges = max(1, -(-sized.count() // ORDERED_ROWS))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = sized.withColumn("digest", digest).withColumn(
        "part", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("long")
    )
    starts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_words"))
    by_part = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("part_start", F.coalesce(F.sum("part_words").over(by_part), F.lit(0))).drop("part_words")
    within = Window.partitionBy("source", "part").orderBy("digest", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    here = sized.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = here.alias("h").join(
        starts.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")) & (F.col("h.part") == F.col("s.part"))
    )
    return joined.select("h.row", "h.doc_id", "h.source", "h.size", (F.col("within") + F.col("part_start")).alias("lo"))


def slices(sized: DataFrame, repeats: int = MOST_REPEATS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """What the mix takes: (row, doc_id, source, size, source_size, target, pass, rank, position, first, words).

    ``sized`` has (row, doc_id, source, size), ``row`` unique. One row for each piece of a document
    in a block: ``words`` words from its word ``first`` on, in pass ``pass`` over the source.
    A document of which nothing is taken has one row with NULL in ``position``.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = targets(sizes, repeats).withColumn("words", F.round("target").cast("long"))
    slots = schedule(shares.select("source", "words"), block_words)
    docs = _streams(sized).alias("d").join(shares.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    docs = docs.select("d.*", "source_size", "target", "t.words")
    passes = F.when(
        (F.col("words") > F.col("lo")) & (F.col("size") > 0),
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - F.col("lo") - 1) / F.col("source_size"))),
    )
    docs = docs.withColumn("pass", F.explode_outer(passes)).withColumn("from", F.col("pass") * F.col("source_size") + F.col("lo"))
    docs = docs.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("words")))
    ranks = F.sequence(F.floor(F.col("from") / block_words), F.floor((F.col("to") - 1) / block_words))
    docs = docs.withColumn("rank", F.explode_outer(ranks))
    begin = F.greatest(F.col("from"), F.col("d.rank") * block_words)
    end = F.least(F.col("to"), (F.col("d.rank") + 1) * block_words)
    joined = docs.alias("d").join(
        slots.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.rank") == F.col("s.rank")), "left"
    )
    return joined.select(
        "row", "doc_id", "d.source", "size", "source_size", "target", "pass", "d.rank", "position",
        (begin - F.col("from")).alias("first"),
        F.when(F.col("position").isNotNull(), end - begin).alias("words"),
    )


def _sized(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, size), written once: the texts are read only to count their words."""
    narrow = docs.select("doc_id", "source", word_count(col("text")).alias("size"))
    return cut_lineage(narrow.withColumn("row", F.monotonically_increasing_id()))


def mix(docs: DataFrame, repeats: int = MOST_REPEATS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document: ``taken`` words go into the mix."""
    return scheduled(docs, repeats, block_words).drop("position")


def scheduled(docs: DataFrame, repeats: int = MOST_REPEATS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position) of every document.

    ``taken`` words of it go into the mix, first at ``position`` of the schedule (NULL if none go).
    """
    pieces = slices(_sized(docs), repeats, block_words)
    taken = pieces.groupBy("row", "doc_id", "size", "source_size", "target").agg(
        F.coalesce(F.sum("words"), F.lit(0)).alias("taken"), F.min("position").alias("position")
    )
    return taken.select("doc_id", "size", "source_size", "target", "taken", "position")


def mixed_documents(docs: DataFrame, repeats: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, ordered: bool = False) -> DataFrame:
    """The documents as the mix takes them, with the columns of ``docs``.

    A document is repeated once for each pass that takes it whole. The one document per source at
    which its words end is cut after the last word taken; ``n_chars`` follows the text.
    Documents of size 0 are carried along once. ``ordered`` sorts the rows by range of their first
    position in the schedule, so that every stretch of the output holds the sources close to their
    weights; documents of size 0 come last. Without it the order is none, and the texts move once less.
    """
    row = free_name(docs, "_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    kept = cut_lineage(numbered)
    sized = kept.select(F.col(row).alias("row"), "doc_id", "source", word_count(col("text")).alias("size"))
    pieces = slices(sized, repeats, block_words).where("position IS NOT NULL OR size = 0")
    r, turn, words, size, position = (free_name(docs, x) for x in ("_r", "_pass", "_words", "_size", "_position"))
    turns = pieces.groupBy(F.col("row").alias(r), F.col("pass").alias(turn)).agg(
        F.coalesce(F.sum("words"), F.lit(0)).alias(words), F.first("size").alias(size), F.min("position").alias(position)
    )
    joined = kept.join(turns, F.col(row) == F.col(r))
    gaps = r"[\x20\x09-\x0D]+"
    leading = F.when(col("text").rlike("^" + gaps), 2).otherwise(1)
    after = F.element_at(F.split(col("text"), gaps, (F.col(words) + leading).cast("int")), -1)
    cut = F.left(col("text"), F.length(col("text")) - F.length(after))
    text = F.when(F.col(words) == F.col(size), col("text")).otherwise(cut)
    out = joined.withColumn("text", text)
    if ordered:
        out = out.orderBy(F.col(position).asc_nulls_last(), row, turn)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[col(c) for c in docs.columns])
