"""Secret scans over a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived: an OR over the pattern's
alternatives of an AND over the trigrams of their literal parts. The index holds, for the
trigrams that the rules ask for, the postings (trigram, document) over the lower-cased texts.
Intersecting postings gives each rule its candidates, and only these are verified with the
pattern. A rule with an alternative that has no trigram is checked on every text.

A candidate is named by doc_id, so rows that share a doc_id (or have none) are verified together:
the index only saves work, verification decides.

Defined results: NULL and empty texts have no spans; repeated rows each have their own result; an
empty table gives an empty result; spans are in code points, the end exclusive. Extra columns are
ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import re
from re import _constants as kinds
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import col, free_name


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0  #: what counts for ``least``
    least: int = 1  #: shorter matches are dropped after matching


#: The base rules in their order, and after them the added ones. A scheme of bounded length and a token that begins
#: at a word keep the work on long runs of letters in proportion to their length.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]+"),
    Rule("login_url", r"[a-z][a-z0-9+.]{0,31}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)

MOST_ALTERNATIVES = 64


def _parts(tree) -> list[list[str]]:
    """The alternatives of a parsed pattern; each is its literal runs, a gap between any two."""
    found = [[""]]
    for op, value in tree:
        if op is kinds.LITERAL:
            more = [[chr(value)]]
        elif op is kinds.SUBPATTERN:
            more = _parts(value[3])
        elif op is kinds.BRANCH:
            more = [x for branch in value[1] for x in _parts(branch)]
        elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            low, high, body = value
            inner = _parts(body)
            if (low, high) == (0, 1):
                more = [[""], *inner]
            elif low == 0:
                more = [["", ""]]
            else:
                more = inner if high == 1 else [[*x, *(x if low > 1 else ["", ""])] for x in inner]
        elif op is kinds.AT:
            continue
        else:  # a class or any character
            more = [["", ""]]
        joined = [[*a[:-1], a[-1] + b[0], *b[1:]] for a in found for b in more]
        # Too many alternatives: what follows counts as a gap, which asks for less.
        found = joined if len(joined) <= MOST_ALTERNATIVES else [[*a, ""] for a in found]
    return found


def trigram_query(pattern: str) -> list[list[str]] | None:
    """Sets of lower-case trigrams, one of which every matching text has in full; None if there is no such query."""
    clauses = []
    for runs in _parts(parser.parse(pattern)):
        grams = {run[i : i + 3].lower() for run in runs for i in range(len(run) - 2)}
        if not grams:
            return None
        clauses.append(frozenset(grams))
    return sorted(sorted(c) for c in set(clauses) if not any(other < c for other in clauses))


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc_id), one row per trigram number and document that has it."""
    low = F.lower(col("text"))
    held = F.filter(F.array(*[F.when(F.contains(F.col("_low"), F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]), lambda x: x.isNotNull())
    return docs.select(col("doc_id").alias("doc_id"), low.alias("_low")).select("doc_id", F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rules): for each document that some trigram query finds, the numbers of its rules."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    grams = sorted({g for q in queries.values() for clause in q for g in clause})
    clauses = [(i, n, clause) for i, q in queries.items() for n, clause in enumerate(q)]
    # Which clauses ask for a trigram: fixed by the rules, so it is an array literal.
    wanted = F.array(*[
        F.array(*[F.lit(n) for n, (_, _, clause) in enumerate(clauses) if g in clause]).cast("array<int>") for g in grams
    ]) if grams else F.array().cast("array<array<int>>")
    sizes = F.array(*[F.lit(len(clause)) for _, _, clause in clauses]).cast("array<int>")
    owners = F.array(*[F.lit(i) for i, _, _ in clauses]).cast("array<int>")
    asked = postings(docs, grams).select("doc_id", "gram", F.explode(F.get(wanted, F.col("gram"))).alias("clause"))
    # Intersection: a document is in all postings of a clause if it has as many different trigrams.
    met = asked.groupBy("doc_id", "clause").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == F.get(sizes, F.col("clause")))
    return met.groupBy("doc_id").agg(F.collect_set(F.get(owners, F.col("clause"))).alias("rules"))


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """Spans of a rule: the matches stand between the parts that splitting leaves."""
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), 0), lambda x: F.length(x))
    value = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), rule.group), lambda x: F.length(x))
    kind = "array<struct<start:bigint,number:int,end:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("found"))

    def add(state: Column, match: Column) -> Column:
        begin = state["at"] + match["gap"]
        end = begin + match["whole"]
        span = F.struct(begin.alias("start"), F.lit(number).alias("number"), end.alias("end"))
        found = F.when(match["value"] >= rule.least, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    matches = F.zip_with(
        F.arrays_zip(F.slice(gaps, 1, F.greatest(F.size(whole), F.lit(1))).alias("gap"), whole.alias("whole")), value,
        lambda a, b: F.struct(a["gap"].cast("long").alias("gap"), a["whole"].cast("long").alias("whole"), b.alias("value")),
    )
    found = F.aggregate(F.filter(matches, lambda m: m["whole"].isNotNull()), start, add, lambda state: state["found"])
    return F.when(F.coalesce(text.rlike(rule.pattern), F.lit(False)), found).otherwise(F.array().cast(kind))


def with_spans(docs: DataFrame, name: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the array ``name`` of (start, number of the rule, end), in order."""
    found_id, found_rules = (free_name(docs, x) for x in ("_candidate", "_found_rules"))
    asked = candidates(docs, rules).select(F.col("doc_id").alias(found_id), F.col("rules").alias(found_rules))
    joined = docs.join(asked, col("doc_id").eqNullSafe(F.col(found_id)), "left")
    each = []
    for i, rule in enumerate(rules):
        spans = _spans(col("text"), i, rule)
        if trigram_query(rule.pattern) is not None:
            none = F.array().cast("array<struct<start:bigint,number:int,end:bigint>>")
            spans = F.when(F.array_contains(F.col(found_rules), i), spans).otherwise(none)
        each.append(spans)
    return joined.withColumn(name, F.array_sort(F.concat(*each))).drop(found_id, found_rules)


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kind_names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kind_names, s["number"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = 3) -> DataFrame:
    """(doc_id, n_<kind> of the ``base`` first rules, base_sha256, spans) of every document."""
    found = with_spans(docs.select("doc_id", "text"), "_found", rules)
    spans = F.col("_found")
    base_spans = F.filter(spans, lambda s: s["number"] < base)
    of = lambda i: F.filter(spans, lambda s: s["number"] == i)
    counts = [F.size(of(i)).cast("long").alias(f"n_{rules[i].kind}") for i in range(base)]
    return found.select("doc_id", *counts, F.sha2(_joined(base_spans, rules), 256).alias("base_sha256"), _joined(spans, rules).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span, overlapping ones as one, replaced by ``mark``; ``n_chars`` follows the text."""
    name = free_name(docs, "_spans")
    found = with_spans(docs, name, rules)
    text = col("text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def put(state: Column, span: Column) -> Column:
        before = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        fresh = span["start"] >= state["at"]
        mark_or_none = F.when(fresh, F.concat(before, F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.concat(state["out"], mark_or_none).alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    clean = F.when(F.size(F.col(name)) > 0, F.aggregate(F.col(name), start, put, rest)).otherwise(text)
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[col(c) for c in docs.columns])


def class_pattern(pattern: str) -> str:
    """The pattern with ``(?i:...)`` spelled as classes of ASCII letters, for engines that fold more than ASCII."""
    spell = lambda m: re.sub("[a-z]", lambda x: f"[{x[0].upper()}{x[0]}]", m[1])
    return re.sub(r"\(\?i:(\(.*?\))\)", spell, pattern)
