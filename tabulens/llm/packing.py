"""Packing token sequences by exact complements, residuals by best fit.

Documents become token ids with an end id; only documents beyond the capacity are cut, into full
pieces after a first one that may be shorter. Packing needs the lengths only: the counts of the
lengths, at most ``capacity`` numbers whatever the corpus, are planned on the driver. The plan
fills the gap beside the longest remaining piece by a length, pair or triple of lengths whose sum
is exactly the gap, as often as the counts allow; where no exact sum is left, the longest piece
that fits goes in and the rest of the gap is tried again. Each pattern of the plan takes a range
of the pieces of its lengths. Pieces are ranked within their length in salted parts, so a length
that a third of all pieces share is many tasks.

Defined results: a NULL text is an empty one, that is the end id alone; repeated rows are packed
each for itself; an empty table gives an empty result; a text with the literal name of a special
token has that token's id, as the tokenizer says; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.llm.common import free_name
from tabulens.session import cut_lineage

CAPACITY = 1024
END_ID = 2
#: Texts whose pieces leave the task at once.
BATCH = 200
#: Fixed value: the pattern of the byte-level tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that one task ranks, about.
RANKED = 100_000


class _Encoder:
    """Token ids of texts, as little-endian 32-bit numbers, for a byte-level BPE tokenizer file.

    The ranks of the file's own vocabulary give the same ids as the tokenizer several times as
    fast. A text that spells a special token is left to the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = tuple(special)
        letters = sorted(pre_tokenizers.ByteLevel.alphabet(), key=ord)
        # The alphabet's letters below 256 stand for themselves, the others for the remaining bytes in order.
        own = [c for c in letters if ord(c) < 256]
        rest = iter(sorted(set(range(256)) - {ord(c) for c in own}))
        byte_of = {c: ord(c) for c in own} | {c: next(rest) for c in letters if ord(c) >= 256}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def _pieces(path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _Encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for first in range(0, len(batch), BATCH):
                part = batch.slice(first, BATCH)
                rows, numbers, starts, ids = [], [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    own = (encode(text) if text else b"") + end
                    total = len(own) // 4
                    stops = range((total - 1) % capacity + 1, total + 1, capacity)
                    begin = 0
                    for number, stop in enumerate(stops):
                        rows.append(row)
                        numbers.append(number)
                        starts.append(begin)
                        ids.append(own[4 * begin : 4 * stop])
                        begin = stop
                lengths = [len(x) // 4 for x in ids]
                columns = [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])

    return cut


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids) of (doc_id, text); ids: little-endian unsigned 32-bit numbers."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, end_id), schema)


def _exact(gap: int, left: np.ndarray) -> Iterator[tuple[int, ...]]:
    """Lengths, pairs and triples of available lengths whose sum is the gap, long pieces first."""
    if left[gap]:
        yield (gap,)
    high = np.arange(gap - 1, (gap - 1) // 2, -1)
    for a in high[(left[high] > 0) & (left[gap - high] > 0)].tolist():
        yield a, gap - a
    for a in range(gap - 2, (gap + 2) // 3 - 1, -1):
        if left[a]:
            rest = gap - a
            middle = np.arange(min(a, rest - 1), (rest - 1) // 2, -1)
            for b in middle[(left[middle] > 0) & (left[rest - middle] > 0)].tolist():
                yield a, b, rest - b


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths, how often) that use every piece once; no sum exceeds the capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    patterns = []

    def fitting(pattern: list[int]) -> int:
        return min(int(left[x]) // n for x, n in Counter(pattern).items())

    for longest in range(capacity, 0, -1):
        while left[longest]:
            pattern = [longest]
            while gap := capacity - sum(pattern):
                exact = next((p for c in _exact(gap, left) if fitting(p := [*pattern, *c])), None)
                if exact:
                    pattern = exact
                    break
                free = left[: gap + 1].copy()
                for used, n in Counter(pattern).items():
                    if used <= gap:
                        free[used] -= n
                fits = np.flatnonzero(free > 0)
                if not len(fits):
                    break
                pattern.append(int(fits[-1]))
            times = fitting(pattern)
            for x, n in Counter(pattern).items():
                left[x] -= n * times
            patterns.append((sorted(pattern, reverse=True), times))
    return patterns


def _places(patterns: list[tuple[list[int], int]], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, pieces per sequence), by length and rank."""
    taken, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for pattern, times in patterns:
        offset = 0
        for length, n in Counter(pattern).items():
            rows.append((length, taken[length], sequence, offset, n))
            taken[length] += n * times
            offset += length * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` with sequence_id and offset; ``cut`` has ``length`` and any other columns."""
    cut = cut_lineage(cut)
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    places = _places(plan(counts, capacity), capacity)
    salts = max(1, -(-sum(counts.values()) // RANKED)) * 16
    salt, rank, ahead = (free_name(cut, x) for x in ("_salt", "_rank", "_ahead"))
    dealt = cut.withColumn(salt, F.pmod(F.xxhash64(*cut.columns), F.lit(salts)))
    sizes = dealt.groupBy("length", salt).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", salt, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(ahead))
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy(*cut.columns)))
    ranked = ranked.join(starts, ["length", salt]).withColumn(rank, F.col(rank) - 1 + F.col(ahead)).select(*cut.columns, rank)
    width = 44  # bits of a rank
    names = list(cut.columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (places[:, 0] << width) | places[:, 1]
        for batch in batches:
            length, position = (batch.column(x).to_numpy() for x in ("length", rank))
            found = places[np.searchsorted(keys, (length << width) | position, "right") - 1] if len(batch) else np.empty((0, 5), np.int64)
            index = position - found[:, 1]
            sequence = found[:, 2] + index // found[:, 4]
            offset = found[:, 3] + index % found[:, 4] * length
            kept = [batch.column(c) for c in batch.schema.names if c != rank]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): the ids stay where they were cut, their checksums travel."""
    cut = pieces(docs, tokenizer, capacity, end_id)
    return pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)
