"""The registered queries in plain SQL, for the comparison with another engine."""

from __future__ import annotations


def _q(value: str, p: float, digits: int = 4) -> str:
    return f"round(quantile_cont({value}, {p}), {digits})"


def _round_two(x: str) -> str:
    return f"CASE WHEN abs({x}) < 9e13 THEN sign({x}) * floor(abs({x}) * 100 + 0.5) / 100 + 0.0 ELSE {x} END"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def _numeric_row(table: str, name: str, digits: int = 4) -> str:
    return (
        f"SELECT '{name}' AS column_name, count({name}) AS cnt, round(avg({name}), {digits}) AS avg, "
        f"round(min({name})::DOUBLE, {digits}) AS min, round(max({name})::DOUBLE, {digits}) AS max, "
        f"round(sum({name})::DOUBLE, 2) AS sum, {_q(name, 0.01, digits)} AS quantile001, "
        f"{_q(name, 0.99, digits)} AS quantile099, {_q(name, 0.1, digits)} AS quantile01, "
        f"{_q(name, 0.9, digits)} AS quantile09, {_q(name, 0.5, digits)} AS median FROM {table}"
    )


def _uniq_rows(table: str, names: list[str]) -> str:
    return _union([f"SELECT '{n}' AS column_name, count(DISTINCT {n}) AS uniq FROM {table}" for n in names])


def _wide_stats(names: list[str]) -> str:
    fields = []
    for n in names:
        for method, p in {
            "quantile001": 0.01, "quantile099": 0.99, "quantile01": 0.1, "quantile09": 0.9, "median": 0.5
        }.items():
            fields.append(f"{_q(n, p)} AS {method}__{n}")
        fields += [
            f"round(avg({n}), 4) AS avg__{n}",
            f"max({n})::DOUBLE AS max__{n}",
            f"min({n})::DOUBLE AS min__{n}",
        ]
    return ", ".join(fields)


_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_PART_NUMBERS = ["p_partkey", "p_size", "p_retailprice"]
_PART_TEXTS = ["p_name", "p_brand", "p_type"]
_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_EVENT_NUMBERS = ["event_id", "user_id", "value"]
_ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]

_PROFILE_TABLE = _union(
    [
        "SELECT 'all' AS column_name, count(*) AS cnt, NULL::BIGINT AS uniq, NULL::DOUBLE AS avg, NULL::DOUBLE AS min, "
        "NULL::DOUBLE AS max, NULL::DOUBLE AS quantile001, NULL::DOUBLE AS quantile099, NULL::DOUBLE AS quantile01, "
        "NULL::DOUBLE AS quantile09, NULL::DOUBLE AS median, FALSE AS is_numeric FROM part"
    ]
    + [
        f"SELECT '{n}', NULL, count(DISTINCT {n}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, FALSE FROM part"
        for n in _PART_TEXTS
    ]
    + [
        f"SELECT '{n}', NULL, count(DISTINCT {n}), round(avg({n}), 4), min({n})::DOUBLE, max({n})::DOUBLE, {_q(n, 0.01)}, "
        f"{_q(n, 0.99)}, {_q(n, 0.1)}, {_q(n, 0.9)}, {_q(n, 0.5)}, TRUE FROM part"
        for n in _PART_NUMBERS
    ]
)


def _short(x: str) -> str:
    return f"coalesce(rtrim(rtrim(printf('%.3f', {x}), '0'), '.'), '0')"


_PROFILE_REPORT = (
    "WITH p AS (" + _PROFILE_TABLE + ") SELECT column_name, coalesce(cnt::VARCHAR, '0') AS cnt, "
    "coalesce(uniq::VARCHAR, '0') AS uniq, "
    + ", ".join(
        f"{_short(n)} AS {n}"
        for n in ("avg", "min", "max", "quantile001", "quantile099", "quantile01", "quantile09", "median")
    )
    + ", is_numeric FROM p"
)

# Values of the string columns of part that pass the cardinality gate, counted.
_GATED = (
    "WITH u AS ("
    + _union([f"SELECT '{n}' AS column_name, {n} AS value FROM part" for n in _PART_TEXTS])
    + "), ok AS (SELECT column_name FROM u GROUP BY 1 HAVING count(DISTINCT value) > 1 AND count(DISTINCT value) < 1000), "
    "g AS (SELECT column_name, value, count(*) AS cnt FROM u WHERE value IS NOT NULL "
    "AND column_name IN (SELECT column_name FROM ok) GROUP BY 1, 2)"
)


def _top(rare: bool, where: str = "TRUE") -> str:
    order = "cnt" if rare else "cnt DESC"
    return (
        _GATED
        + f", r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY {order}, value) AS rn FROM g WHERE {where}) "
        "SELECT column_name, value, cnt, round(cnt * 100.0::DOUBLE / (SELECT count(*) FROM part), 4) AS percentage "
        "FROM r WHERE rn <= 10"
    )


def _combos(names: str, order: str, having: str = "", share: bool = True) -> str:
    percentage = ", round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM part), 4) AS percentage" if share else ""
    return (
        f"SELECT count(*) AS cnt, {names}{percentage} FROM part GROUP BY {names} {having} "
        f"ORDER BY {order}, {names} LIMIT 10"
    )


_NUMBERS = (
    "x AS (SELECT doc_id, v FROM (SELECT doc_id, TRY_CAST(n AS DOUBLE) AS v FROM (SELECT doc_id, "
    r"unnest(regexp_extract_all(replace(replace(text, ',', ' '), chr(10), ' '), '-?\d*\.?\d+')) AS n FROM documents)) "
    "WHERE v IS NOT NULL AND NOT isinf(v))"
)

_TEXT_POINTS = {"p01": 0.01, "p025": 0.025, "p10": 0.1, "q1": 0.25, "q3": 0.75, "p90": 0.9, "p975": 0.975, "p99": 0.99}



def _text_quantile(p: float) -> str:
    """Linear interpolation in the ordered list ``s`` of ``cnt`` numbers."""
    at = f"({p}::DOUBLE * (cnt - 1))"
    low, high = f"s[floor({at})::BIGINT + 1]", f"s[ceil({at})::BIGINT + 1]"
    return f"({low} + ({at} - floor({at})) * ({high} - {low}))"


_TEXT_STATS = (
    f"WITH {_NUMBERS}, o AS (SELECT doc_id, count(v) AS cnt, sum(v) / count(v) AS av, list_sort(list(v)) AS s "
    "FROM x GROUP BY doc_id), a AS (SELECT doc_id, cnt, av, s[1] AS mn, s[cnt] AS mx, "
    "(s[(cnt + 1) // 2] + s[cnt // 2 + 1]) / 2 AS md, "
    + ", ".join(f"{_text_quantile(p)} AS {n}" for n, p in _TEXT_POINTS.items())
    + f" FROM o), b AS (SELECT doc_id, cnt, {_round_two('av')} AS average, {_round_two('md')} AS median, "
    f"{_round_two('mn')} AS min, {_round_two('mx')} AS max, "
    + ", ".join(f"{_round_two('a.' + n)} AS {n}" for n in _TEXT_POINTS)
    + f" FROM a) SELECT *, {_round_two('(q3 - q1)')} AS iqr FROM b"
)

_OUTSIDE = (
    f"WITH {_NUMBERS}, q AS (SELECT doc_id, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM x GROUP BY 1), "
    f"f AS (SELECT doc_id, {_round_two('a')} AS q1, {_round_two('b')} AS q3 FROM q), "
    "o AS (SELECT x.doc_id, v FROM x JOIN f USING (doc_id) "
    "WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) "
)

_FORMATS = {
    "hour": "%Y-%m-%d %H:%M:%S",
    "day": "%Y-%m-%d %H:%M:%S",
    "week": "%Y-%m-%d",
    "month": "%Y-%m-%d",
    "year": "%Y-%m-%d",
}


def _bucket(date: str, unit: str) -> str:
    return f"strftime(date_trunc('{unit}', {date}), '{_FORMATS[unit]}')"


def _rollup(table: str, date: str, unit: str, values: list[str], digits: int, with_sum: bool = False, nudge: str = "") -> str:
    measures = ("min", "max", "median", "avg", *(("sum",) if with_sum else ()))
    fields = ", ".join(f"round({m}({v})::DOUBLE{nudge}, {digits}) AS {m}__{v}" for v in values for m in measures)
    return f"SELECT {_bucket(date, unit)} AS datetime, count(*) AS cnt, 'info' AS common, {fields} FROM {table} GROUP BY 1"


def _all_sums(table: str, date: str, value: str, total: str) -> str:
    return _union(
        [
            f"SELECT '{date}__{u}' AS rollup, {_bucket(date, u)} AS datetime, count(*) AS cnt, {total} AS sum_value "
            f"FROM {table} GROUP BY 2"
            for u in _FORMATS
            if u != "week"
        ]
    )


def _spans(table: str, date: str, units: dict[str, int]) -> str:
    return _union(
        [
            f"SELECT {rank} AS rk, '{u}' AS unit, count(DISTINCT date_trunc('{u}', {date})) AS n FROM {table}"
            for u, rank in units.items()
        ]
    )


def _cell(section: str, name: str, item: str, measure: str, value: str, source: str) -> str:
    return f"SELECT '{section}' AS section, {name} AS name, {item} AS item, '{measure}' AS measure, ({value})::DOUBLE AS value FROM {source}"


def _full_profile(table: str, numbers: list[str], texts: list[str], date: str | None = None) -> str:
    """The whole profile as one long table; the texts are those that pass the cardinality gate."""
    quantiles = {"quantile001": 0.01, "quantile099": 0.99, "quantile01": 0.1, "quantile09": 0.9, "median": 0.5}
    cells = [_cell("columns", "'all'", "NULL::VARCHAR", "cnt", "count(*)", table), _cell("columns", "'all'", "NULL", "is_numeric", "0", "(SELECT 1)")]
    for n in [*numbers, *texts]:
        facts = {"uniq": f"count(DISTINCT {n})", "is_numeric": f"max({int(n in numbers)})"}
        if n in numbers:
            facts |= {m: f"{m}({n})" for m in ("avg", "min", "max")} | {m: f"quantile_cont({n}, {p})" for m, p in quantiles.items()}
        cells += [_cell("columns", f"'{n}'", "NULL", m, x, table) for m, x in facts.items()]
    share = f"cnt * 100.0::DOUBLE / (SELECT count(*) FROM {table})"
    names = ", ".join(texts)
    joined = " || '|' || ".join(f"coalesce({n}, '\\N')" for n in texts)
    for prefix, order, where in (("frequent", "cnt DESC", "TRUE"), ("rare", "cnt", "cnt > 1")):
        tops = [
            f"(SELECT * FROM (SELECT {n} AS value, count(*) AS cnt FROM {table} WHERE {n} IS NOT NULL GROUP BY 1) "
            f"WHERE {where} ORDER BY {order}, value LIMIT 10)"
            for n in texts
        ]
        cells += [_cell(prefix, f"'{n}'", "value", m, x, t) for n, t in zip(texts, tops) for m, x in {"cnt": "cnt", "percentage": share}.items()]
        if len(texts) > 1:
            both = (
                f"(SELECT * FROM (SELECT {names}, count(*) AS cnt FROM {table} GROUP BY ALL) WHERE {where} ORDER BY {order}, {names} LIMIT 10)"
            )
            cells += [_cell(f"{prefix}_combinations", f"'{'+'.join(texts)}'", joined, m, x, both) for m, x in {"cnt": "cnt", "percentage": share}.items()]
    for u in ("hour", "day", "month", "year") if date else ():
        facts = {"cnt": "count(*)"} | {f"{m}__{n}": f"{m}({n})" for n in numbers for m in ("min", "max", "median", "avg", "sum")}
        name, bucket, grouped = f"'{date}__{u}'", _bucket(date, u), f"{table} GROUP BY 3"
        cells += [_cell("rollups", name, bucket, m, x, grouped) for m, x in facts.items()]
        cells += [_cell("graphs", name, bucket, m, x, grouped) for m, x in {"cnt": "count(*)", "sum_value": f"sum({numbers[0]})"}.items()]
    return f"SELECT section, name, item, measure, round(value + 1e-8, 4) AS value FROM ({_union(cells)}) WHERE value IS NOT NULL"


_FENCES = (
    "WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events), "
    "f AS (SELECT round(q1 - 1.5 * (q3 - q1), 6) AS lo, round(q3 + 1.5 * (q3 - q1), 6) AS hi FROM q) "
)

_CSV_PART = "SELECT " + ", ".join(f"{n}::VARCHAR AS {n}" for n in _PART) + " FROM part"


def _rows(columns: str, rows: list[str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(rows) + f") t({columns})"


def _types(table: str, columns: list[tuple[str, str]]) -> list[str]:
    return [f"('{c}', '{t}', FALSE, '{table}')" for c, t in columns]


_INFERRED = _rows(
    "column_name, type, nullable, table_name",
    _types("customer", [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "bigint"),
                        ("c_acctbal", "double"), ("c_mktsegment", "string")])
    + _types("events", [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
                        ("event_type", "string"), ("value", "double"), ("props", "string")])
    + _types("nation", [("n_nationkey", "bigint"), ("n_name", "string"), ("n_regionkey", "bigint")])
    + _types("orders", [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                        ("o_totalprice", "double"), ("o_orderdate", "date"), ("o_orderpriority", "string")]),
)


def _share(table: str, name: str, text: str, pattern: str, alias: str) -> str:
    test = f"avg(CASE WHEN regexp_full_match(trim({text}), '{pattern}') THEN 1.0 ELSE 0.0 END)"
    return f"SELECT '{name}' AS column_name, round({test}, 4) AS share, {test} >= 0.8 AS {alias}"


_NUMBER_TEXT = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
_DATE_TEXT = r"(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}|\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2})"

def _every_bin(bins: int, filled: str) -> str:
    """All bins with their heights, from those that are filled."""
    return (
        f"SELECT b.bin::INT AS bin, coalesce(f.height, 0)::BIGINT AS height FROM range({bins}) b(bin) LEFT JOIN ({filled}) f ON f.bin = b.bin"
    )


def _adaptive(table: str, name: str, bins: int, where: str = "TRUE") -> str:
    """Runs of equal size, the closest neighbours merged one pair after the other."""
    pair = "list_min(list_transform(range(1, len(s)), lambda i: {'gap': s[i + 1].x - s[i].x, 'i': i})).i"
    centre = "(s[k].x * s[k].y + s[k + 1].x * s[k + 1].y) / (s[k].y + s[k + 1].y)"
    return (
        f"WITH RECURSIVE v AS (SELECT {name}::DOUBLE AS v, count(*) AS c FROM {table} WHERE {name} IS NOT NULL AND {where} GROUP BY 1), "
        "r AS (SELECT v, c, sum(c) OVER (ORDER BY v) - c AS b, sum(c) OVER () AS n FROM v), "
        f"p AS (SELECT (b * {bins * 10}) // n AS bin, min(v) AS lo, max(v) AS hi, sum(c)::DOUBLE AS y FROM r GROUP BY 1), "
        "m AS (SELECT list({'lo': lo, 'hi': hi, 'x': (lo + hi) / 2, 'y': y} ORDER BY lo) AS s FROM p UNION ALL "
        "SELECT list_concat(list_concat(s[:k - 1], [{'lo': s[k].lo, 'hi': s[k + 1].hi, "
        f"'x': {centre}, 'y': s[k].y + s[k + 1].y}}]), s[k + 2:]) FROM (SELECT s, {pair} AS k FROM m WHERE len(s) > {bins})), "
        f"f AS (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM m WHERE len(s) <= {bins}), "
        "e AS (SELECT s[i].lo AS a, coalesce(s[i + 1].lo, s[i].hi) AS z, s[i].y AS height FROM f) "
        "SELECT round(a, 4) AS range_start, round(z, 4) AS range_end, height, round((a + z) / 2, 4) AS mid FROM e"
    )


_LIST_HISTOGRAM = _every_bin(
    10,
    "SELECT least(floor((value - 1) / 199.0::DOUBLE * 10), 9)::INT AS bin, count(*) AS height FROM events "
    "WHERE value BETWEEN 1 AND 200 GROUP BY 1",
)


def all_oracles() -> dict[str, str]:
    """SQL by query name; the approximate queries have none."""
    fine_to_coarse = {"hour": 1, "day": 2, "month": 3, "year": 4}
    coarse_to_fine = {"hour": 4, "day": 3, "month": 2, "year": 1}
    return {
        "csv_dialect": _rows(
            "table_name, delimiter",
            ["('customer', ',')", "('nation', ';')", "('part', chr(9))", "('region', '|')", "('supplier', ',')"],
        ),
        "csv_header": _rows(
            "table_name, has_header, n_columns",
            ["('customer', TRUE, 5::BIGINT)", "('nation', TRUE, 3)", "('part', TRUE, 6)", "('region', TRUE, 2)",
             "('supplier', FALSE, 4)"],
        ),
        "csv_headers_clean": _rows(
            "table_name, headers",
            [
                "('customer', '0001_c_custkey,0002_c_name,0003_c_nationkey,0004_c_acctbal,0005_c_mktsegment')",
                "('nation', '0001_n_nationkey,0002_n_name,0003_n_regionkey')",
                "('part', '0001_part_key,0002_name_part,0003_brand,0004_tip,0005_size,0006_size_1')",
                "('region', '0001_r_regionkey,0002_r_name')",
                "('supplier', '0001_column_1,0002_column_2,0003_column_3,0004_column_4')",
            ],
        ),
        "csv_infer_types": _INFERRED,
        "csv_infer_sample": f"SELECT column_name, type FROM ({_INFERRED}) WHERE table_name = 'orders'",
        "csv_scan": _CSV_PART,
        "csv_scan_gz": _CSV_PART,
        "csv_scan_lz4": _CSV_PART,
        "csv_scan_zip": _CSV_PART,
        "csv_scan_quoted": "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, text FROM conversations",
        "csv_load": 'SELECT row_number() OVER (ORDER BY p_partkey) AS id, p_partkey AS "0001_p_partkey", '
        'p_name AS "0002_p_name", p_brand AS "0003_p_brand", p_type AS "0004_p_type", p_size::BIGINT AS "0005_p_size", '
        'p_retailprice AS "0006_p_retailprice" FROM part',
        "parse_dates": "SELECT o_orderkey, o_orderdate::DATE AS d FROM orders",
        "parse_moments": "SELECT event_id, 'DateTime64' AS kind, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS canonical FROM events",
        "describe_table": _rows(
            "name, type", ["('n_name', 'string')", "('n_nationkey', 'int')", "('n_regionkey', 'int')"]
        ),
        "table_size": "SELECT count(*) AS row_count, 6 AS column_count FROM orders",
        "export_rollups": _all_sums("events", "ts", "user_id", "sum(user_id)::DOUBLE"),
        "rollup_sorted": f"SELECT {_bucket('ts', 'hour')} AS datetime, count(*) AS cnt, 'info' AS common FROM events GROUP BY 1",
        "row_count": "SELECT count(*) AS cnt FROM events",
        "uniq_counts": _uniq_rows("events", ["event_id", "user_id", "event_type", "value", "props"]),
        "uniq_counts_text": _uniq_rows("documents", ["doc_id", "text", "lang", "source", "n_chars"]),
        "uniq_quantiles": f"SELECT {_q('uniq::DOUBLE', 0.5)} AS med, {_q('uniq::DOUBLE', 0.2)} AS p20, "
        f"{_q('uniq::DOUBLE', 0.8)} AS p80 FROM ({_uniq_rows('part', _PART)})",
        "numeric_stats": f"SELECT {_wide_stats(_EVENT_NUMBERS)} FROM events",
        "numeric_sum": "SELECT "
        + ", ".join(
            f"round(sum({n})::DOUBLE, 2) AS sum__{n}, {_q(n, 0.4, 2)} AS quantile04__{n}, {_q(n, 0.6, 2)} AS quantile06__{n}"
            for n in _LINE_NUMBERS
        )
        + " FROM lineitem",
        "profile_long": _union(
            [_numeric_row("lineitem", n) for n in _LINE_NUMBERS]
        ),
        "profile_merge": "SELECT 'all' AS column_name, count(*) AS cnt, NULL::BIGINT AS uniq, NULL::DOUBLE AS avg, "
        "FALSE AS is_numeric FROM part UNION ALL "
        + _union([f"SELECT '{n}', NULL, count(DISTINCT {n}), NULL, FALSE FROM part" for n in _PART_TEXTS])
        + " UNION ALL "
        + _union([f"SELECT '{n}', NULL, count(DISTINCT {n}), round(avg({n}), 4), TRUE FROM part" for n in _PART_NUMBERS]),
        "profile_table": _PROFILE_TABLE,
        "profile_report": _PROFILE_REPORT,
        "column_overview": _union(
            [
                f"SELECT '{n}' AS column_name, '{t}' AS type, count({n}) AS non_null, count(DISTINCT {n}) AS uniq, "
                + (
                    f"min({n})::DOUBLE AS min, max({n})::DOUBLE AS max, round(avg({n}), 4) AS mean, {_q(n, 0.5)} AS median"
                    if n in _PART_NUMBERS
                    else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS median"
                )
                + " FROM part"
                for n, t in zip(_PART, ["bigint", "string", "string", "string", "int", "double"])
            ]
        ),
        "describe_numbers": _union(
            [
                f"SELECT '{n}' AS column_name, count({n}) AS cnt, round(avg({n}), 4) AS mean, round(stddev_samp({n}), 4) AS std, "
                f"min({n})::DOUBLE AS min, {_q(n, 0.25)} AS p25, {_q(n, 0.5)} AS p50, {_q(n, 0.75)} AS p75, "
                f"max({n})::DOUBLE AS max FROM customer"
                for n in ("c_custkey", "c_nationkey", "c_acctbal")
            ]
        ),
        "sample_values": _union(
            [
                f"SELECT '{n}' AS column_name, v AS value FROM (SELECT DISTINCT {n} AS v FROM orders ORDER BY 1 LIMIT 5)"
                for n in ("o_orderstatus", "o_orderpriority")
            ]
        ),
        "missing_values": _union(
            [f"SELECT '{n}' AS column_name, count(*) - count({n}) AS missing FROM part" for n in _PART]
        ),
        "top_values": _top(rare=False),
        "rare_values": _top(rare=True, where="cnt > 1"),
        "group_lines": _GATED
        + ", r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rn FROM g "
        ") SELECT column_name, value || ' (' || cnt::VARCHAR || ', ' || "
        "printf('%.2f', cnt * 100.0::DOUBLE / (SELECT count(*) FROM part)) || '%)' AS line FROM r WHERE rn <= 10",
        "top_combos": _combos("p_name, p_brand, p_type", "cnt DESC"),
        "rare_combos": _combos("p_name, p_brand, p_type", "cnt", "HAVING count(*) > 1"),
        "rare_combos_all": _combos("p_brand, p_type, p_name", "cnt", share=False),
        "category_counts": "SELECT event_type AS category, count(*) AS cnt FROM events "
        "WHERE event_type IS NOT NULL AND event_type <> '' GROUP BY 1 ORDER BY cnt DESC, category LIMIT 20",
        "most_least_common": "(SELECT p_name AS value, count(*) AS cnt, 'most_common' AS type FROM part WHERE p_name <> '' "
        "GROUP BY 1 ORDER BY cnt DESC, value LIMIT 5) UNION ALL (SELECT p_name AS value, count(*) AS cnt, "
        "'least_common' AS type FROM part WHERE p_name <> '' GROUP BY 1 ORDER BY cnt, value LIMIT 5)",
        "least_common10": "SELECT count(*) AS cnt, p_brand FROM part GROUP BY p_brand ORDER BY cnt, p_brand LIMIT 10",
        "extreme_values": _GATED
        + ", m AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rn FROM g), "
        "s AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt, value) AS rn FROM g WHERE cnt > 1) "
        "SELECT m.column_name, m.value AS most_frequent, m.cnt AS most_count, s.value AS most_rare, s.cnt AS rare_count "
        "FROM m LEFT JOIN s ON m.column_name = s.column_name AND s.rn = 1 WHERE m.rn = 1",
        "group_summary": "SELECT event_type, count(*) AS quantity, round(sum(value), 2) AS total_value FROM events GROUP BY 1",
        "string_profile": "SELECT *, round(unique_count * 100.0::DOUBLE / total_count, 4) AS unique_percent, "
        "round(empty_count * 100.0::DOUBLE / total_count, 4) AS empty_percent, "
        "round(whitespace_count * 100.0::DOUBLE / total_count, 4) AS whitespace_percent FROM ("
        "SELECT count(*) AS total_count, count(DISTINCT text) AS unique_count, "
        "count(CASE WHEN text = '' THEN 1 END) AS empty_count, count(CASE WHEN trim(text) = '' THEN 1 END) AS whitespace_count, "
        "min(strlen(text))::BIGINT AS min_length, max(strlen(text))::BIGINT AS max_length, "
        "round(avg(strlen(text)), 4) AS avg_length FROM documents)",
        "length_distribution": "SELECT strlen(text)::BIGINT AS str_length, count(*) AS cnt FROM documents WHERE text <> '' "
        "GROUP BY 1 ORDER BY 1 LIMIT 10",
        "numeric_like": _union(
            [
                _share("events", n, f"{n}::VARCHAR", _NUMBER_TEXT, "numeric_like") + " FROM events"
                for n in ("event_id", "ts", "user_id", "event_type", "value", "props")
            ]
        ),
        "date_like": _union(
            [
                _share("orders", n, x, _DATE_TEXT, "date_like") + f", {d} AS all_dates FROM orders"
                for n, x, d in (
                    ("o_orderdate", "strftime(o_orderdate, '%d/%m/%Y')", "TRUE"),
                    *((n, f"{n}::VARCHAR", "FALSE") for n in (*_ORDER_NUMBERS, "o_orderstatus", "o_orderpriority")),
                )
            ]
        ),
        "numeric_detail": "SELECT min(value) AS min_value, max(value) AS max_value, round(avg(value), 4) AS avg_value, "
        "count(value) AS total_count, "
        + ", ".join(
            f"{_q('value', p)} AS {n}"
            for n, p in {"p01": 0.01, "p05": 0.05, "p10": 0.1, "q1": 0.25, "median_value": 0.5, "q3": 0.75,
                         "p90": 0.9, "p95": 0.95, "p99": 0.99}.items()
        )
        + " FROM events",
        "iqr_outliers": _FENCES
        + "SELECT count(*) AS outliers_count, min(value) AS min_outlier, max(value) AS max_outlier FROM events, f "
        "WHERE value < lo OR value > hi",
        "decile_buckets": "WITH q AS (SELECT list_concat([min(value)], quantile_cont(value, "
        "[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) AS b FROM events), "
        "r AS (SELECT i AS bucket, round(b[i], 6) AS lo, round(b[i+1], 6) AS hi FROM q, range(1, 11) t(i)) "
        "SELECT bucket, round((lo + hi) / 2, 4) AS mid, count(value) AS cnt FROM r LEFT JOIN events "
        "ON value >= lo AND value < hi GROUP BY bucket, lo, hi",
        "quantile_histogram": "WITH q AS (SELECT quantile_cont(value, [0.01,0.05,0.1,0.5,0.9,0.95,0.99]) AS b FROM events), "
        "r AS (SELECT round(b[i], 6) AS range_start, round(b[i+1], 6) AS range_end FROM q, range(1, 7) t(i)) "
        "SELECT range_start, range_end, count(value) AS cnt FROM r LEFT JOIN events "
        "ON value >= range_start AND value <= range_end GROUP BY 1, 2",
        "full_profile_part": _full_profile("part", _PART_NUMBERS, _PART_TEXTS),
        "full_profile_events": _full_profile("events", _EVENT_NUMBERS, ["event_type", "props"], "ts"),
        "full_profile_orders": _full_profile("orders", _ORDER_NUMBERS, ["o_orderstatus", "o_orderpriority"], "o_orderdate"),
        "adaptive_histogram": _adaptive("events", "value", 20),
        "adaptive_range_by_start": _adaptive("events", "value", 10, "value BETWEEN 1 AND 100"),
        "adaptive_range_by_height": _adaptive("lineitem", "l_extendedprice", 100, "l_extendedprice BETWEEN 1000 AND 50000"),
        "range_histogram": _every_bin(
            10,
            "SELECT least(floor((value - 1) / 99.0::DOUBLE * 10), 9)::INT AS bin, count(*) AS height "
            "FROM events WHERE value BETWEEN 1 AND 100 GROUP BY 1",
        ),
        "central_histogram": _every_bin(
            100,
            "SELECT least(floor((value - lo) / (hi - lo) * 100), 99)::INT AS bin, count(*) AS height FROM events, "
            "(SELECT round(quantile_cont(value, 0.4), 6) AS lo, round(quantile_cont(value, 0.6), 6) AS hi FROM events) "
            "WHERE value BETWEEN lo AND hi GROUP BY 1",
        ),
        "density": "WITH h AS ("
        + _every_bin(10, "SELECT least(floor(l_quantity / 50.0::DOUBLE * 10), 9)::INT AS bin, count(*) AS height FROM lineitem GROUP BY 1")
        + ") SELECT bin, round(height::DOUBLE / (sum(height) OVER ()::DOUBLE * 5.0::DOUBLE), 6) "
        "AS density FROM h",
        "histogram_bar": f"WITH h AS ({_LIST_HISTOGRAM}) "
        "SELECT bin, height, repeat('█', round((height - min(height) OVER ())::DOUBLE "
        "/ (max(height) OVER () - min(height) OVER ()) * 10)::INT) AS bar FROM h",
        "extract_numbers": f"WITH {_NUMBERS} SELECT doc_id, v AS num FROM x",
        "text_route": f"WITH {_NUMBERS} SELECT has_numbers, count(*) AS cnt FROM (SELECT doc_id IN (SELECT doc_id FROM x) "
        "AS has_numbers FROM documents) GROUP BY 1",
        "text_number_stats": _TEXT_STATS,
        "text_number_outliers": _OUTSIDE + "SELECT doc_id, count(*) AS outliers FROM o GROUP BY 1",
        "text_outlier_values": _OUTSIDE + "SELECT doc_id, v AS outlier FROM o",
        "rollup_hour": _rollup("events", "ts", "hour", _EVENT_NUMBERS, 7, with_sum=True),
        "rollup_day": _rollup("events", "ts", "day", _EVENT_NUMBERS, 7),
        "rollup_month": _rollup("orders", "o_orderdate", "month", _ORDER_NUMBERS, 6),
        "rollup_year": _rollup("orders", "o_orderdate", "year", _ORDER_NUMBERS, 6),
        "rollup_all_measures": _union(
            [
                f"SELECT 'l_shipdate__{u}' AS rollup, * FROM ({_rollup('lineitem', 'l_shipdate', u, _LINE_NUMBERS, 4, True, ' + 1e-8')})"
                for u in ("day", "month", "year")
            ]
        ),
        "rollup_sum_day": f"SELECT {_bucket('ts', 'day')} AS date, count(*) AS cnt, sum(user_id)::DOUBLE AS sum_value "
        "FROM events GROUP BY 1",
        "rollup_all_sums": _all_sums("orders", "o_orderdate", "o_orderkey", "sum(o_orderkey)::DOUBLE"),
        "sketch_distinct": _union(
            [
                f"SELECT '{c}' AS column_name, count({c}) AS cnt, count(DISTINCT {c}) AS uniq, TRUE AS within FROM events"
                for c in ("event_id", "user_id", "value", "props")
            ]
        ),
        "sketch_quantiles": _union(
            [f"SELECT '{c}' AS column_name, p::DOUBLE AS p, TRUE AS within FROM (SELECT unnest([0.01, 0.1, 0.5, 0.9, 0.99]) AS p)" for c in ("event_id", "user_id", "value")]
        ),
        "rollup_sum_week": f"SELECT {_bucket('ts', 'week')} AS date, count(*) AS cnt, sum(user_id)::DOUBLE AS sum_value "
        "FROM events WHERE ts IS NOT NULL GROUP BY 1",
        "rollup_week": f"SELECT {_bucket('ts', 'week')} AS date, count(*) AS cnt FROM events WHERE ts IS NOT NULL GROUP BY 1",
        "rollup_summary": "WITH r AS (SELECT date_trunc('day', ts) AS d, count(*) AS c FROM events WHERE ts IS NOT NULL GROUP BY 1) "
        "SELECT sum(c)::BIGINT AS total_rows, count(*) AS buckets, strftime(min(d), '%Y-%m-%d') AS first_bucket, "
        "strftime(max(d), '%Y-%m-%d') AS last_bucket FROM r",
        "rollup_spans": "SELECT 'ts' AS column_name, u AS unit, count(DISTINCT b) AS row_count, "
        "strftime(min(b), '%Y-%m-%d %H:%M:%S') AS start_date, strftime(max(b), '%Y-%m-%d %H:%M:%S') AS end_date FROM ("
        + _union([f"SELECT '{u}' AS u, date_trunc('{u}', ts) AS b FROM events" for u in fine_to_coarse])
        + ") GROUP BY u",
        "auto_granularity": f"WITH s AS ({_spans('orders', 'o_orderdate', fine_to_coarse)}) "
        "SELECT unit, n FROM s WHERE n BETWEEN 1 AND 20 ORDER BY rk LIMIT 1",
        "auto_rollup": f"SELECT {_bucket('o_orderdate', 'year')} AS date, count(*) AS cnt, "
        "sum(o_orderkey)::DOUBLE AS sum_value FROM orders GROUP BY 1",
        "auto_granularity_pair": f"WITH s AS ({_spans('events', 'ts', coarse_to_fine)}) "
        "SELECT (SELECT unit FROM s WHERE n > 10 ORDER BY rk LIMIT 1) AS coarse_unit, "
        "(SELECT unit FROM s WHERE n <= 10000 ORDER BY rk DESC LIMIT 1) AS fine_unit",
        "bucket_labels": "SELECT DISTINCT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS label, "
        "epoch(date_trunc('month', o_orderdate))::BIGINT AS epoch_s FROM orders",
    }
