"""Toxicity by gradient-boosted trees over dense text features, calibrated by isotonic regression.

The lexicon is learned: words that are far more frequent in toxic than in other training rows.
Features are densities of lexicon words, their nearness to second-person words, capitals,
punctuation and obfuscation. Trees and calibration are fitted on separate parts of a bounded
sample of labelled rows (``SAMPLE``, by a hash of doc_id, so reruns agree); rows whose
crc32(doc_id) mod 5 is 0 are never used. Scoring is one pass over the texts without a shuffle.

Defined results: NULL and empty texts are scored like any other, their features are 0; a row with
a NULL doc_id is scored and not held out; repeated rows have equal scores; without training rows
of both labels every score is the mean label, 0 if there is none; an empty table gives an empty
result; extra columns are ignored by ``scores`` and kept by ``clean``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import TYPE_CHECKING, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import col, free_name, small_batches
from tabulens.session import cut_lineage

if TYPE_CHECKING:
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.ml.regression import IsotonicRegressionModel

#: Labelled rows that are used for fitting, at most.
SAMPLE = 20_000
#: Words of the lexicon, at most.
LEXICON = 400
#: Toxic rows that a lexicon word is in, at least, and the least logarithm of its odds ratio.
LEAST_ROWS, LEAST_ODDS = 5, 1.5
TREES, DEPTH, STEP = 20, 4, 0.2
#: Words between a lexicon word and a second-person word, at most.
NEAR = 5
FOLDS = 5
FEATURES = 16

#: Second-person words of the languages in the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen euch ihr tu te toi ton tes vous votre vos tú ti tus usted ustedes".split()
)
_OTHER = bytes(c for c in range(128) if not chr(c).isalnum())
_SPACED = bytes.maketrans(_OTHER, b" " * len(_OTHER))
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_PUNCTUATION = b".,;:!?\"'()[]{}-"
#: Letters with digits or signs between them, or a letter three times.
_DISGUISED = re.compile(rb"[A-Za-z]+[0-9@$*!]+[A-Za-z]+|[A-Za-z]*([A-Za-z])\1\1[A-Za-z]*")
_PLAIN = bytes.maketrans(b"013457@$!", b"oieastasi")


def normal_words(text: str) -> list[bytes]:
    """Lower-case words, ASCII punctuation taken as space."""
    return text.lower().encode().translate(_SPACED).split()


def text_features(text: str | None, lexicon: dict[bytes, float]) -> list[float]:
    if not text:
        return [0.0] * FEATURES
    raw = text.encode()
    words = normal_words(text)
    n, size = max(1, len(words)), max(1, len(raw))
    found = lexicon.keys() & set(words)
    hits = [i for i, w in enumerate(words) if w in found] if found else []
    second = [i for i, w in enumerate(words) if w in _SECOND] if hits else []
    near = sum(1 for i in hits if bisect_left(second, i - NEAR) < bisect_right(second, i + NEAR))
    weights = [lexicon[words[i]] for i in hits]
    letters = size - len(raw.translate(None, _LETTERS))
    upper = size - len(raw.translate(None, _UPPER))
    disguised = [m.group() for m in _DISGUISED.finditer(raw)]
    plain = [re.sub(rb"(.)\1\1+", rb"\1", w.lower().replace(b"*", b"").translate(_PLAIN)) for w in disguised]
    hidden = sum(1 for w in plain if w in lexicon)
    return [
        len(hits) / n,
        math.log1p(len(hits)),
        float(len(found)),
        sum(weights) / n,
        max(weights, default=0.0),
        near / n,
        near / max(1, len(hits)),
        len(second) / n,
        upper / max(1, letters),
        sum(1 for w in raw.split() if len(w) > 2 and w.isupper()) / n if upper > 3 else 0.0,
        raw.count(b"!") / n,
        raw.count(b"?") / n,
        (size - len(raw.translate(None, _PUNCTUATION))) / size,
        len(disguised) / n,
        math.log1p(hidden),
        math.log1p(len(words)),
    ]


_SECOND = frozenset(w.encode() for w in SECOND_PERSON)


def features(text: Column, lexicon: dict[bytes, float]) -> Column:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(text_features(x, lexicon)) for x in texts])

    return of(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


class Model(NamedTuple):
    lexicon: dict[bytes, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    mean: float


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = sorted(set(normal_words(text or "")))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([label] * len(found), pa.int64())], ["word", "toxic"])


def learned_lexicon(train: DataFrame, toxic: int, clean: int) -> dict[bytes, float]:
    """The words with the largest odds ratio of (text, toxic)."""
    found = train.select("toxic", "text").mapInArrow(_distinct_words, "word binary, toxic long")
    counts = found.groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).where(F.col("t") >= LEAST_ROWS)
    odds = lambda k, total: F.log((k + 0.5) / (F.lit(total) - k + 0.5))
    ratio = odds(F.col("t"), toxic) - odds(F.col("n") - F.col("t"), clean)
    best = counts.select("word", ratio.alias("ratio")).where(F.col("ratio") >= LEAST_ODDS).orderBy(F.desc("ratio"), "word").limit(LEXICON)
    return {bytes(r["word"]): round(r["ratio"], 6) for r in best.collect()}  # LEXICON rows at most


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels.toxic`` from the texts of ``docs``."""
    # Imported on the driver alone: the tasks that compute features would hold it for as long as they live.
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    small_batches(docs.sparkSession)
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # SAMPLE narrow rows at most
    train = cut_lineage(texts)
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4))
    learns = part > 0  # the others calibrate, and teach neither lexicon nor trees
    toxic_row = F.coalesce(F.col("toxic"), F.lit(0))
    counts = train.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(toxic_row), F.lit(0)).alias("t"),
        F.count_if(learns).alias("own_n"), F.coalesce(F.sum(F.when(learns, toxic_row)), F.lit(0)).alias("own_t"),
    ).first()
    n, toxic, own_n, own_toxic = counts
    if not 0 < toxic < n:
        return Model({}, None, None, toxic / n if n else 0.0)
    if 0 < own_toxic < own_n:
        lexicon = learned_lexicon(train.where(learns), own_toxic, own_n - own_toxic)
    else:  # one label only: all rows of so small a sample teach
        lexicon = learned_lexicon(train, toxic, n - toxic)
    rows = train.select(array_to_vector(features(F.col("text"), lexicon)).alias("features"), F.col("toxic").cast("double").alias("label"), part.alias("part"))
    rows = cut_lineage(rows.coalesce(4))  # a bounded sample; few tasks keep the many passes of boosting short
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1, maxBins=64, minInstancesPerNode=5)
    fitted = rows.where("part > 0")
    if fitted.select("label").distinct().count() < 2 or rows.where("part = 0").isEmpty():
        fitted = rows
    model = trees.fit(fitted)
    judged = model.transform(rows.where("part = 0")).select(vector_to_array("probability")[1].alias("raw"), "label")
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label").fit(judged) if not judged.isEmpty() else None
    return Model(lexicon, model, calibration, toxic / n)


def with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with the score under ``name``. A thousandth of the raw score keeps its order within the steps of the calibration."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if model.trees is None:
        return docs.withColumn(name, F.lit(float(model.mean)))
    vector, raw, steps = (free_name(docs, x) for x in ("_features", "_raw", "_steps"))
    judged = docs.withColumn(vector, array_to_vector(features(col("text"), model.lexicon)))
    trees = model.trees.copy()
    trees.setFeaturesCol(vector)
    outputs = [free_name(docs, x) for x in ("_margin", "_chances", "_label")]
    trees.setRawPredictionCol(outputs[0]).setProbabilityCol(outputs[1]).setPredictionCol(outputs[2])
    judged = trees.transform(judged).withColumn(raw, vector_to_array(col(outputs[1]))[1])
    score = col(raw)
    if model.calibration is not None:
        calibration = model.calibration.copy()
        calibration.setFeaturesCol(raw)
        calibration.setPredictionCol(steps)
        judged = calibration.transform(judged)
        score = 0.999 * col(steps) + 0.001 * col(raw)
    return judged.select(*[col(c) for c in docs.columns], score.alias(name))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those scored 0.5 or more."""
    name = free_name(docs, "_score")
    return with_score(docs, fit(docs, labels), name).where(col(name) < 0.5).drop(name)
