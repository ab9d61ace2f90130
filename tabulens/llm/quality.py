"""Document quality by weak supervision: rules vote good or bad or abstain, and
expectation-maximisation weighs them.

Each rule has two accuracies: how often it votes good on good documents, and bad on bad ones.
They are estimated without labels from the votes of all documents, which is a table of the
counts of vote patterns (three to the number of rules at most). The posterior probability of
being good decides, in place of a filter that asks for all rules. A bad vote of a rule that
hardly ever errs on good documents weighs much, a good vote of a rule that most documents pass
weighs little.

Defined results: NULL and empty texts have no words, all counts are 0 and the base fails; rows
with a NULL doc_id and repeated rows are judged like any other; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.session import cut_lineage

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
LEAST_WORDS = 10
MOST_REPEATED = 20  #: percent of the words
ROUNDS = 200
#: Accuracies stay within these.
ACCURACY = (0.02, 0.999)
#: The share of good documents in the prior stays within these. It is a limit of the prior alone: in a corpus with fewer
#: good documents the votes of a document still decide, and any number of documents can be found bad.
GOOD_SHARE = (0.3, 0.99)

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_letter_words", "n_symbol_words")
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))


def text_stats(text: str | None) -> tuple[int, ...]:
    """STATS of a text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0, 0, 0, 0, 0)
    windows = list(zip(*[words[i:] for i in range(WINDOW)], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen: dict = {}
        twice = np.zeros(n, bool)
        for i, w in enumerate(windows):
            first = seen.setdefault(w, i)
            if first != i:
                twice[i : i + WINDOW] = True
                twice[first : first + WINDOW] = True
        repeated = int(twice.sum())
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    letters = sum(1 for w in words if len(w.translate(None, _LETTERS)) * 2 < len(w))
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    marked = sum(1 for w in words if len(w.translate(None, SYMBOLS)) < len(w)) if symbols else 0
    return (n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), len(set(words)), letters, marked)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([text_stats(x.as_py()) for x in batch.column("text")], np.int64).reshape(-1, len(STATS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(rows[:, i]) for i in range(len(STATS))]], ["doc_id", *STATS])


def stats(docs: DataFrame) -> DataFrame:
    """(doc_id, STATS) of each document."""
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(s, T.LongType()) for s in STATS]]
    return docs.select("doc_id", "text").mapInArrow(_stats, T.StructType(fields))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def votes() -> list[Column]:
    """1 (good), -1 (bad) or 0 (abstains) of each rule, over STATS. A text without words has no votes."""
    n = F.when(F.col("n_words") > 0, F.col("n_words"))
    lines = F.when(F.col("n_lines") > 1, F.col("n_lines"))
    repeated = F.col("n_repeat_words") / n
    symbols = F.col("n_symbols") / n
    marked = F.col("n_symbol_words") / n
    share = F.col("n_symbols") / F.when(F.col("word_chars") > 0, F.col("word_chars"))
    doubled = F.col("n_dup_lines") / lines
    length = F.col("word_chars") / n
    variety = F.when(n >= 50, F.col("n_distinct") / n)
    letters = F.col("n_letter_words") / n
    return [
        _vote(n, n >= 50, n < 15),
        _vote(repeated, repeated <= 0.1, repeated > 0.2),
        _vote(symbols, symbols <= 0.05, symbols > 0.3),
        _vote(marked, marked <= 0.05, marked > 0.2),
        _vote(share, share <= 0.01, share > 0.05),
        _vote(doubled, doubled <= 0.1, doubled >= 0.5),
        _vote(length, (length >= 3) & (length <= 9), (length < 2.2) | (length > 12)),
        _vote(variety, variety >= 0.3, variety < 0.1),
        _vote(letters, letters >= 0.9, letters < 0.7),
    ]


def estimate(patterns: list[tuple[int, ...]], counts: list[int], rounds: int = ROUNDS) -> np.ndarray:
    """The posterior probability of good for each vote pattern, by expectation-maximisation."""
    if not patterns:
        return np.empty(0)
    v, c = np.array(patterns, float).reshape(len(patterns), -1), np.array(counts, float)
    good, bad = (v > 0).astype(float), (v < 0).astype(float)
    # To begin with: rules are right more often than not, and one bad vote outweighs one good vote.
    on_good, on_bad, share = np.full(v.shape[1], 0.95), np.full(v.shape[1], 0.5), 0.8
    posterior = np.full(len(patterns), share)
    for _ in range(rounds):
        log_good = np.log(share) + good @ np.log(on_good) + bad @ np.log1p(-on_good)
        log_bad = np.log1p(-share) + good @ np.log1p(-on_bad) + bad @ np.log(on_bad)
        posterior = 1 / (1 + np.exp(np.clip(log_bad - log_good, -500, 500)))
        as_good, as_bad = c * posterior, c * (1 - posterior)
        on_good = np.clip((as_good @ good + 1) / (as_good @ (good + bad) + 1.05), *ACCURACY)
        on_bad = np.clip((as_bad @ bad + 0.5) / (as_bad @ (good + bad) + 1), *ACCURACY)
        share = float(np.clip((as_good.sum() + 1) / (c.sum() + 1.25), *GOOD_SHARE))
    return posterior


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior) of every document."""
    code = sum((vote + 1) * F.lit(3**i) for i, vote in enumerate(votes()))
    counted = cut_lineage(stats(docs).withColumn("pattern", code.cast("int")))
    rules = len(votes())
    # As many rows as there are patterns, 3 to the number of rules at most.
    table = [(r["pattern"], r["n"]) for r in counted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()]
    posterior = estimate([tuple(p // 3**i % 3 - 1 for i in range(rules)) for p, _ in table], [n for _, n in table])
    weights = docs.sparkSession.createDataFrame(
        [(p, float(round(w, 12))) for (p, _), w in zip(table, posterior, strict=True)], "pattern int, posterior double"
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    joined = counted.join(F.broadcast(weights), "pattern")
    return joined.select("doc_id", *STATS[:5], failed.alias("base_failed"), (~failed & (F.col("posterior") >= 0.5)).alias("kept"), "posterior")
