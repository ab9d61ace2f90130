"""Quoted fields, read leniently: a quote opens a field only where the field begins, and closes it only where it ends.

Elsewhere a quote is a letter. Files are read in byte ranges that tasks share out: one pass finds
in which state each range leaves a quoted field, these states are carried from range to range, and a second pass
starts every range at its first true record. What a range leaves open is joined to the ranges behind it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The functions below travel to the tasks with their code, so that the package need not be
# installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes that records leave a task at a time.
BATCH_BYTES = 8 << 20
# Kinds of rows: whole records, and parts of those that span ranges.
WHOLE, OPENED, CLOSED, THROUGH = range(4)


def closing(text: str, start: int, delimiter: str) -> int:
    """Index behind the quote that closes a field whose content begins at ``start``; -1 if none does."""
    at = start
    while (at := text.find('"', at)) >= 0:
        if text.startswith('""', at):
            at += 2
            continue
        behind = at + 1
        while behind < len(text) and text[behind] in " \r" and text[behind] != delimiter:
            behind += 1
        if behind == len(text) or text[behind] in (delimiter, "\n"):
            return at + 1
        at += 1
    return -1


def opening(text: str, start: int, delimiter: str) -> int:
    """Index of the next quote with which a field begins; -1 if there is none. ``start`` is not inside quotes."""
    at = start
    while (at := text.find('"', at)) >= 0:
        before = at - 1
        while before >= start and text[before] == " " and delimiter != " ":
            before -= 1
        if before < start or text[before] in (delimiter, "\n"):
            return at
        at += 1
    return -1


def is_open_after(line: str, inside: bool, delimiter: str) -> bool:
    """Whether a quoted field is open at the end of a line, that began inside of one or not."""
    if '"' not in line:
        return inside
    at = closing(line, 0, delimiter) if inside else 0
    while at >= 0:
        quote = opening(line, at, delimiter)
        if quote < 0:
            return False
        at = closing(line, quote + 1, delimiter)
    return True


def record_end(text: str, delimiter: str) -> int:
    """Index of the line break that ends the first record; -1 if the text ends before."""
    at = 0
    while True:
        quote, line = opening(text, at, delimiter), text.find("\n", at)
        if line < 0 or quote < 0 or line < quote:
            return line
        if (at := closing(text, quote + 1, delimiter)) < 0:
            return -1


def split_record(record: str, delimiter: str) -> list[str]:
    """The fields of one record, without leading spaces and enclosing quotes."""
    fields, start = [], 0
    while True:
        begin = start
        while begin < len(record) and record[begin] == " " and delimiter != " ":
            begin += 1
        if record.startswith('"', begin) and (stop := closing(record, begin + 1, delimiter)) >= 0:
            fields.append(record[begin + 1 : stop - 1].replace('""', '"'))
            end = record.find(delimiter, stop)
        else:
            end = record.find(delimiter, start)
            fields.append(record[start : end if end >= 0 else len(record)].lstrip())
        if end < 0:
            return fields
        start = end + 1


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with their file and the byte range of it that a task reads, in order within the range."""
    text = spark.read.option("lineSep", "\n").text(paths)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"), "value")


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        for path, start, line in zip(*(batch.column(n).to_pylist() for n in ("path", "range", "value")), strict=True):
            yield (path, start), line


def _states(delimiter: str):
    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[bool]] = {}  # a few ranges a task
        for key, line in _by_range(batches):
            state = found.setdefault(key, [False, True, False])
            state[:2] = [is_open_after(line, s, delimiter) for s in state[:2]]
            state[2] |= state[0]
        rows = [(*key, *state) for key, state in found.items()]
        if rows:
            names = ["path", "range", "from_outside", "from_inside", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return states


def range_states(spark: SparkSession, paths: str | list[str], delimiter: str) -> DataFrame:
    """(path, range, inside, ends, spans) of ranges with quotes: do they begin and end inside a quoted field, and does any span lines."""
    quoted = _lines(spark, paths).where(F.col("value").contains('"'))
    states = quoted.mapInArrow(_states(delimiter), "path string, range long, from_outside boolean, from_inside boolean, spans boolean")
    listed = states.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("range", "from_outside", "from_inside", "spans"))).alias("all"))
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<boolean>").alias("before"))
    carried = F.aggregate(
        "all",
        start,
        lambda s, x: F.struct(
            F.when(s["inside"], x["from_inside"]).otherwise(x["from_outside"]).alias("inside"), F.array_append(s["before"], s["inside"]).alias("before")
        ),
        lambda s: s["before"],
    )
    each = F.arrays_zip(F.col("all").alias("state"), carried.alias("inside"))
    zipped = listed.select("path", F.explode(each).alias("x"))
    ends = F.when(F.col("x.inside"), F.col("x.state.from_inside")).otherwise(F.col("x.state.from_outside"))
    return zipped.select("path", "x.state.range", "x.inside", ends.alias("ends"), "x.state.spans")


def _assembled(delimiter: str, header: bool, ranges: dict[str, list[tuple[int, bool]]]):
    def inside(path: str, start: int) -> bool:
        """The state of the last range with quotes before this one carries over."""
        state = False
        for other, begins, ends in ranges.get(path, ()):
            if other > start:
                break
            state = begins if other == start else ends
        return state

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, key, held, is_open, kind, first = [], 0, None, [], False, WHOLE, False

        def done(what: int) -> None:
            nonlocal first
            text = "\n".join(held)
            if not (first and what == WHOLE) and (what != WHOLE or text.strip()):
                rows.append((*key, what, text.removesuffix("\r") if what in (WHOLE, CLOSED) else text))
            first = False
            held.clear()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)],
                ["path", "range", "kind", "record"],
            )

        for now, line in _by_range(batches):
            if now != key:
                if held:
                    done(THROUGH if kind == CLOSED else OPENED)
                key, is_open = now, inside(*now)
                kind, first = CLOSED if is_open else WHOLE, header and now[1] == 0
            held.append(line)
            size += len(line)
            is_open = is_open_after(line, is_open, delimiter)
            if not is_open:
                done(kind)
                kind = WHOLE
            if size > BATCH_BYTES and rows:
                yield batch()
                rows, size = [], 0
        if held:
            done(THROUGH if kind == CLOSED else OPENED)
        if rows:
            yield batch()

    return records


def quoted_records(spark: SparkSession, paths: str | list[str], delimiter: str, header: bool, states: DataFrame) -> DataFrame:
    """(record): every record of the files as text, line breaks inside quotes kept; ``states`` are the ranges' states."""
    # One row for each range of a file with quotes; a range is as large as the session reads at once.
    ranges: dict[str, list] = {}
    for r in states.orderBy("path", "range").collect():
        ranges.setdefault(r["path"], []).append((r["range"], r["inside"], r["ends"]))
    parts = _lines(spark, paths).mapInArrow(_assembled(delimiter, header, ranges), "path string, range long, kind int, record string")
    whole = parts.where(F.col("kind") == WHOLE).select("record")
    # At most two parts a range.
    order = F.when(F.col("kind") == OPENED, 1).otherwise(0)
    cut = parts.where(F.col("kind") != WHOLE).select("path", "range", order.alias("order"), "record")
    number = F.sum("order").over(Window.partitionBy("path").orderBy("range", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = cut.withColumn("number", number).groupBy("path", "number")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("range", "order", "record"))), lambda x: x["record"])
    return whole.union(joined.agg(F.array_join(texts, "\n").alias("record")).select("record"))
