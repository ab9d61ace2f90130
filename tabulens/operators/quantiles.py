"""Per-group numeric summaries with exact quantiles that hold for groups of any size.

Two ways to the same long table (keys, column_name, cnt, min, max, avg, sum, q):

* ``exact=False``: ``percentile_approx``, one pass.
* ``exact=True``: values are counted first (map-side, so hot values collapse to one row) and
  range-partitioned by group and value, so that a large group is many tasks. Runs of
  ``CELL_ROWS`` neighbouring rows of a partition are cells; their sizes, one row a cell, give the ranks at
  which every cell begins. Only cells that hold a wanted rank are ranked row by row.

The number of partitions follows the number of values, so that no task counts or sorts more than about
``TASK_ROWS`` of them, whatever the size of the files' splits and the session's shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions.columns import column
from tabulens.session import cut_lineage, partitions_for

# Distinct values that are ranked together: few, since a group up to this size is sorted a second time as a whole.
CELL_ROWS = 2_000
# Cells with a wanted rank that may be broadcast.
BROADCAST_CELLS = 200_000
# Accuracy of the sketches: the rank error is the group size divided by it.
ACCURACY = 10_000

INDEX = "_column"


def summarize(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    keys: Sequence[str] = (),
    exact: bool = True,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Long numeric summary: one row per group and column, ``q`` in the order asked for."""
    columns, keys = list(columns), list(keys)
    probabilities = [float(p) for p in probabilities]
    if not columns:
        raise ValueError("no numeric column to summarize")
    narrow = df.select(*[column(k) for k in keys], *[column(c).cast("double").alias(c) for c in columns])
    if not probabilities or not exact:
        return _one_pass(narrow, columns, probabilities, keys)
    partitions = partitions_for(df.count() * len(columns))
    counted = value_counts(narrow, columns, keys, partitions)
    if partitions > 1:
        counted = cut_lineage(counted, partitions)
    return summarize_counted(counted, columns, probabilities, keys, cell_rows, partitions)


def summarize_counted(
    counted: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    keys: Sequence[str] = (),
    cell_rows: int = CELL_ROWS,
    partitions: int = 1,
) -> DataFrame:
    """The exact summary from rows of ``value_counts``; a group may have a value in several rows.

    ``partitions`` is the number that keeps tasks small, 1 where the session's number will do.
    """
    columns, keys = list(columns), list(keys)
    placed = _placed(counted, [*keys, INDEX], cell_rows, partitions)
    ranked = _by_cells(placed, [*keys, INDEX], [float(p) for p in probabilities], partitions)
    names = F.array(*[F.lit(c) for c in columns])
    return ranked.select(
        *_cols(keys), F.get(names, INDEX).alias("column_name"), "cnt", "min", "max", "avg", "sum", "q"
    )


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """The rows over so many partitions by their hash, as they are for 1: a split of a file may hold too many for one task."""
    return df if partitions == 1 else df.repartition(partitions, F.xxhash64(*_cols(df.columns)))


def value_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), partitions: int = 1) -> DataFrame:
    """The distinct values of each group and column as doubles: ``_column`` (place in the list), ``_v``,
    ``_copies`` (0 for NULL) and ``_rows`` (NULLs included).

    Values meet map-side, so a hot value travels once per task.
    """
    rows = _value_rows(spread(df, partitions), list(columns), list(keys))
    group = _cols([*keys, INDEX, "_v"])
    return rows.groupBy(*group).agg(F.count("_v").alias("_copies"), F.count("*").alias("_rows"))


def _cols(names: Sequence[str]) -> list[Column]:
    return [column(n) for n in names]


def _one_pass(df: DataFrame, columns: list[str], probabilities: list[float], keys: list[str]) -> DataFrame:
    """All aggregates of all columns in one grouped aggregation, then one row per column."""
    rows = []
    for name in columns:
        value = column(name)
        sketch = F.percentile_approx(value, probabilities, ACCURACY) if probabilities else F.lit(None)
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count(value).alias("cnt"),
                F.min(value).alias("min"),
                F.max(value).alias("max"),
                F.avg(value).alias("avg"),
                F.sum(value).alias("sum"),
                sketch.cast("array<double>").alias("q"),
            )
        )
    grouped = df.groupBy(*_cols(keys)).agg(F.array(*rows).alias("_rows"))
    return grouped.select(*_cols(keys), F.inline("_rows"))


def _value_rows(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """One row per value; a number stands for the column, because it sorts faster than a name."""
    pairs = [x for i, c in enumerate(columns) for x in (F.lit(i), column(c))]
    return df.select(*_cols(keys), F.stack(F.lit(len(columns)), *pairs).alias(INDEX, "_v"))


def _position(p: float, total: str) -> str:
    """SQL text of the zero-based, possibly fractional rank of a quantile."""
    return f"({p!r}D * ({total} - 1))"


def _covers_wanted(start: str, end: str, total: str, probabilities: list[float]) -> Column:
    """Whether ranks [start, end) hold a rank next to one of the quantile positions."""
    tests = []
    for p in probabilities:
        position = _position(p, total)
        tests.append(f"(ceil({position}) >= {start} AND floor({position}) < {end})")
    return F.expr(" OR ".join(tests))


def _neighbours(start: str, end: str, total: str, probabilities: list[float]) -> list[Column]:
    """Per quantile the values on both sides of its position, from rows that cover ranks [start, end)."""
    found = []
    for i, p in enumerate(probabilities):
        for side, rounding in (("low", "floor"), ("high", "ceil")):
            rank = f"{rounding}({_position(p, total)})"
            found.append(F.expr(f"max(CASE WHEN {start} <= {rank} AND {rank} < {end} THEN _v END) AS _{side}{i}"))
    return found


def _interpolated(total: str, probabilities: list[float]) -> Column:
    """Linear interpolation between the neighbours of every position."""
    quantiles = []
    for i, p in enumerate(probabilities):
        position, low, high = _position(p, total), f"_low{i}", f"_high{i}"
        mixed = f"(ceil({position}) - {position}) * {low} + ({position} - floor({position})) * {high}"
        quantiles.append(f"CASE WHEN {low} = {high} THEN {low} ELSE {mixed} END")
    return F.expr(f"CASE WHEN {total} > 0 THEN array({', '.join(quantiles)}) END AS q")


def _placed(counted: DataFrame, group: list[str], cell_rows: int, partitions: int = 1) -> DataFrame:
    """The distinct values of each group with their copies, in order over the partitions, and the cell of each.

    Written once: the cells of later branches are those of the same partitions, also after a lost executor.
    """
    narrow = counted.select(*_cols(group), "_v", "_copies")
    # Two short keys sort fastest; groups whose hashes agree lie among each other, each still in order.
    order = [F.xxhash64(*_cols(group)) if len(group) > 1 else column(group[0]), column("_v")]
    ranged = narrow.repartitionByRange(partitions, *order) if partitions > 1 else narrow.repartitionByRange(*order)
    ordered = ranged.sortWithinPartitions(*order)
    # The number of a row has its partition in the upper bits, so no cell spans two.
    cell = F.floor(F.monotonically_increasing_id() / cell_rows)
    return cut_lineage(ordered.withColumn("_cell", cell), partitions)


def placed_values(df: DataFrame, columns: list[str], keys: list[str], cell_rows: int) -> DataFrame:
    """The values of a table, counted and placed."""
    return _placed(value_counts(df, columns, keys), [*keys, INDEX], cell_rows)


def equi_depth(df: DataFrame, name: str, bins: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The values of one column in at most ``bins`` runs of about equal size: ``bin``, ``lo``, ``hi``, ``height``.

    A value goes whole into the run of its first copy, so the runs depend on the values alone. The ranks
    come from the sizes of the cells and, within a cell, from a running sum.
    """
    value = column(name).cast("double")
    narrow = df.select(value.alias("_n")).filter(F.col("_n").isNotNull() & ~F.isnan("_n"))
    placed = _placed(value_counts(narrow, ["_n"]), [INDEX], cell_rows)
    whole = Window.partitionBy(F.lit(0))  # one row a cell
    in_order = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = placed.groupBy("_cell").agg(F.sum("_copies").alias("_size")).select(
        "_cell",
        (F.sum("_size").over(in_order) - F.col("_size")).alias("_before"),
        F.sum("_size").over(whole).alias("_total"),
    )
    running = Window.partitionBy("_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.col("_before") + F.sum("_copies").over(running) - F.col("_copies")
    # Decimals, because the product of a rank and the number of bins may exceed a long.
    run = F.floor(first.cast("decimal(28,0)") * F.lit(bins).cast("decimal(9,0)") / F.col("_total")).cast("int")
    binned = placed.join(cells, "_cell").select(run.alias("bin"), "_v", "_copies")
    return binned.groupBy("bin").agg(
        F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.sum("_copies").alias("height")
    )


def _null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on possibly-NULL keys."""
    right = right.select(*[column(c).alias(f"_r_{c}" if c in on else c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [column(c).eqNullSafe(column(f"_r_{c}")) for c in on])
    return left.join(right, condition, how).drop(*[f"_r_{c}" for c in on])


def _by_cells(placed: DataFrame, group: list[str], probabilities: list[float], partitions: int = 1) -> DataFrame:
    """The summary from placed values; only rows of cells with a wanted rank are moved and sorted again."""
    in_cell = [*group, "_cell"]
    cells = placed.groupBy(*_cols(in_cell)).agg(
        F.sum("_copies").alias("_size"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.sum(F.col("_v") * F.col("_copies")).alias("_sum"),
    )
    whole = Window.partitionBy(*_cols(group))  # one row a cell
    in_order = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = cells.select(
        "*",
        (F.sum("_size").over(in_order) - F.col("_size")).alias("_before"),
        F.sum("_size").over(whole).alias("_total"),
    )
    if partitions > 1:
        ranged = cut_lineage(ranged, partitions)
    holds = (F.col("_size") > 0) & _covers_wanted("_before", "_before + _size", "_total", probabilities)
    wanted = ranged.filter(holds).select(*_cols(in_cell), "_before", "_total")

    running = Window.partitionBy(*_cols(in_cell)).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if partitions > 1 and wanted.count() <= BROADCAST_CELLS:
        wanted = F.broadcast(wanted)
    candidates = _null_safe_join(placed, wanted, in_cell, "inner")
    if partitions > 1:
        candidates = candidates.repartition(partitions, *_cols(in_cell))
    end = F.col("_before") + F.sum("_copies").over(running)
    covered = candidates.select(*_cols(group), "_v", "_total", (end - F.col("_copies")).alias("_from"), end.alias("_to"))
    covered = covered.filter(_covers_wanted("_from", "_to", "_total", probabilities))

    # Cells and covered values meet in one aggregate; each kind of row leaves the other's columns empty.
    both = ranged.drop("_cell", "_before", "_total").unionByName(covered, allowMissingColumns=True)
    summary = both.groupBy(*_cols(group)).agg(
        F.sum("_size").alias("cnt"),
        F.min("_min").alias("min"),
        F.max("_max").alias("max"),
        F.sum("_sum").alias("sum"),
        *_neighbours("_from", "_to", "_total", probabilities),
    )
    return summary.select(*_cols(group), *_summary_fields(probabilities))


def _summary_fields(probabilities: list[float]) -> list[Column]:
    return [
        F.col("cnt"),
        F.col("min"),
        F.col("max"),
        (F.col("sum") / F.nullif(F.col("cnt"), F.lit(0))).alias("avg"),
        F.col("sum"),
        _interpolated("cnt", probabilities),
    ]
