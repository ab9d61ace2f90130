"""Repeated passages by a count-min prefilter: windows of words that an earlier document has already.

Documents are dealt by a hash of their content into blocks, each about ``block_windows`` windows,
and windows by their own hash into shards, each with a count-min sketch of its own whose width
follows ``shard_windows``; so a larger corpus has more blocks and shards, not fuller sketches.
 1. Every block sketches its windows, once per document. A block's sketch is sent as the cells
    that it counts in, two bytes and a bit for each cell.
 2. A shard merges the sketches of all blocks and answers each block which of its cells count
    two or more. The cells overestimate, so every repeated window is among them.
 3. Only windows that all rows of the sketch estimate to be repeated are grouped exactly, by a
    128-bit digest of their words. A block sends each digest once, with its first document, so
    a passage that a third of all documents share is one entry a block.
 4. The exact groups answer each block which of its digests an earlier document of another
    block has. With these and its own first documents a block drops the words that windows of
    earlier documents cover.

Defined results: a NULL text has no words; texts shorter than a window lose nothing; a row with a
NULL doc_id loses nothing and takes nothing from others; rows of one doc_id are one document, so
they take nothing from each other, and each is returned; an empty table gives an empty result;
extra columns are ignored. Rows that are equal in doc_id and text share a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabulens.llm.common import col

#: Words of a window.
WIDTH = 13
#: Rows of a sketch, and cells of a row for each window that a shard expects.
DEPTH, CELLS = 2, 8
#: Windows of a block of documents and of a shard of windows, about.
BLOCK_WINDOWS, SHARD_WINDOWS = 1_000_000, 4_000_000
#: Bytes of a word and the space behind it, about; only the number of blocks and shards rests on it.
WORD_BYTES = 6
#: Bytes of a text that are hashed at a time; only memory depends on it.
CHUNK = 1 << 19

#: Odd numbers: the base of the hashes, one that mixes them, and one for each row of a sketch.
_BASE, _MIX = 0xD1342543DE82EF95, np.uint64(0x9E3779B97F4A7C15)
_ROWS = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class _Hasher:
    """64-bit hashes of runs of bytes, each in constant time from running sums over the whole text."""

    def __init__(self):
        self.letters = np.array([xxhash.xxh64_intdigest(bytes([i])) for i in range(256)], np.uint64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def __call__(self, text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(text) + 1:
            size = max(2 * len(self.powers), len(text) + 1)
            self.powers, self.inverses = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(self.letters[np.frombuffer(text, np.uint8)] * self.powers[: len(text)], out=sums[1:])
        mixed = (sums[ends] - sums[starts]) * self.inverses[starts]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _MIX
        return mixed ^ (mixed >> np.uint64(29))


class _Words:
    """All words of a block of texts, in one run of bytes, and its windows: where they are, their rows and hashes."""

    def __init__(self, texts: pa.ChunkedArray, width: int):
        # bytes.split cuts at exactly the six characters between words; one space replaces them, a line feed parts texts
        self.texts = [b" ".join(t.as_py().encode().split()) if t.is_valid else b"" for t in texts]
        self.all, self.width = b"\n".join(self.texts), width
        letters = np.frombuffer(self.all, np.uint8)
        cuts = np.flatnonzero((letters == 32) | (letters == 10))
        starts, ends = np.append(0, cuts + 1), np.append(cuts, len(letters))
        rows = np.append(0, np.cumsum(letters[cuts] == 10))
        real = ends > starts  # a text without words leaves an empty one
        self.starts, self.ends, self.rows = starts[real], ends[real], rows[real]
        self.sizes = np.bincount(self.rows, minlength=len(self.texts))
        count = max(0, len(self.rows) - width + 1)
        self.at = np.flatnonzero(self.rows[:count] == self.rows[width - 1 :][:count])
        self.row = self.rows[self.at]
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        hasher, parts, i = _Hasher(), [np.empty(0, np.uint64)], 0
        starts, ends = self.starts[self.at], self.ends[self.at + self.width - 1]
        while i < len(starts):  # as many windows as begin in the next bytes, one at least
            stop = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK)))
            first = int(starts[i])
            parts.append(hasher(self.all[first : int(ends[stop - 1])], starts[i:stop] - first, ends[i:stop] - first))
            i = stop
        return np.concatenate(parts)

    def digests(self, windows: np.ndarray) -> list[bytes]:
        digest, every = xxhash.xxh3_128_digest, self.all
        starts, ends = self.starts[self.at[windows]], self.ends[self.at[windows] + self.width - 1]
        return [digest(every[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def covered(self, windows: np.ndarray) -> np.ndarray:
        """Whether each word lies in one of the windows."""
        steps = np.zeros(len(self.rows) + 1, np.int64)
        steps[self.at[windows]] += 1  # each window begins at a word of its own
        steps[self.at[windows] + self.width] -= 1
        return np.cumsum(steps[:-1]) > 0


class _Sketch:
    """The shape of the sketches: ``shards`` of ``DEPTH`` rows with ``cells`` cells each."""

    def __init__(self, shards: int, cells: int):
        self.shards, self.cells = shards, cells

    def places(self, windows: np.ndarray, row: int) -> np.ndarray:
        """The cell of each window over all shards: a shard's cells follow those of the shard before."""
        shard = ((windows >> np.uint64(32)) * np.uint64(self.shards)) >> np.uint64(32)
        mixed = windows * _ROWS[row]
        mixed ^= mixed >> np.uint64(29)
        cell = ((mixed * _MIX) >> np.uint64(32)) % np.uint64(self.cells)
        return (shard * np.uint64(self.cells) + cell).astype(np.int64)

    def bounds(self, places: np.ndarray) -> np.ndarray:
        """Where each shard begins in ascending places."""
        return np.searchsorted(places, np.arange(self.shards + 1, dtype=np.int64) * self.cells)


def _split(cells: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending cells as the low and the high halves of their steps; the high ones are mostly zero and compress."""
    steps = np.diff(cells, prepend=0)
    return (steps & 0xFFFF).astype("<u2").tobytes(), (steps >> 16).astype("<u2").tobytes()


def _joined(low: bytes, high: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(low, "<u2").astype(np.int64) + (np.frombuffer(high, "<u2").astype(np.int64) << 16))


_MESSAGE = "block long, shard int, row int, low binary, high binary, more binary"
_ANSWER = "block long, shard int, row int, bits binary"


def _sketched(shape: _Sketch, width: int):
    def sketch(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        words = _Words(table.column("text"), width)
        usable = table.column("doc_id").is_valid().to_numpy()[words.row]  # one without an id is compared with nothing
        windows, rows = words.hashes[usable], words.row[usable]
        order = np.argsort(windows, kind="stable")
        windows, rows = windows[order], rows[order]
        again = (windows[1:] == windows[:-1]) & (rows[1:] == rows[:-1])
        windows = windows[np.append(np.ones(min(1, len(windows)), bool), ~again)]  # once per document
        out = {"shard": [], "row": [], "low": [], "high": [], "more": []}
        for row in range(DEPTH):
            places = np.sort(shape.places(windows, row))
            heads = np.flatnonzero(np.diff(places, prepend=-1))
            places, counts = places[heads], np.diff(heads, append=len(places))
            bounds = shape.bounds(places)
            for shard in np.flatnonzero(np.diff(bounds)).tolist():
                part = slice(bounds[shard], bounds[shard + 1])
                low, high = _split(places[part] - shard * shape.cells)
                for name, value in zip(out, (shard, row, low, high, np.packbits(counts[part] > 1).tobytes()), strict=True):
                    out[name].append(value)
        columns = [pa.array([block] * len(out["row"]), pa.int64()), pa.array(out["shard"], pa.int32()), pa.array(out["row"], pa.int32())]
        columns += [pa.array(out[n], pa.binary()) for n in ("low", "high", "more")]
        return pa.Table.from_arrays(columns, ["block", *out])

    return sketch


def _merged(cells: int):
    def merge(table: pa.Table) -> pa.Table:
        """Which cells of each block's sketch count two or more in the sketches of all blocks."""
        seen, more = np.zeros(cells, bool), np.zeros(cells, bool)
        low, high, again = (table.column(n) for n in ("low", "high", "more"))
        for i in range(len(table)):
            own = _joined(low[i].as_py(), high[i].as_py())
            twice = np.unpackbits(np.frombuffer(again[i].as_py(), np.uint8), count=len(own)).astype(bool)
            more[own[seen[own] | twice]] = True
            seen[own] = True
        bits = [np.packbits(more[_joined(low[i].as_py(), high[i].as_py())]).tobytes() for i in range(len(table))]
        return pa.Table.from_arrays([table.column("block"), table.column("shard"), table.column("row"), pa.array(bits, pa.binary())], ["block", "shard", "row", "bits"])

    return merge


def _repeated(windows: np.ndarray, answers: pa.Table, shape: _Sketch) -> np.ndarray:
    """Whether every row of the sketch estimates the window to be repeated."""
    out = np.ones(len(windows), bool)
    found = {(r["row"], r["shard"]): r["bits"] for r in answers.select(["row", "shard", "bits"]).to_pylist()}
    for row in range(DEPTH):
        places, inverse = np.unique(shape.places(windows, row), return_inverse=True)
        bounds, more = shape.bounds(places), np.zeros(len(places), bool)
        for shard in np.flatnonzero(np.diff(bounds)).tolist():
            count = bounds[shard + 1] - bounds[shard]
            more[bounds[shard] : bounds[shard + 1]] = np.unpackbits(np.frombuffer(found[row, shard], np.uint8), count=count)
        out &= more[inverse]
    return out


def _ranked(values: list) -> np.ndarray:
    """Numbers in the order of the values; the numbers themselves where the values are whole."""
    ranks = np.array(values)
    if ranks.dtype.kind not in "iu":
        place = {v: i for i, v in enumerate(sorted(set(values)))}
        ranks = np.array([place[v] for v in values], np.int64)
    return ranks


def _grouped(digests: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct digests in order, the group of each row, and the smallest rank of each group."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    ordered = digests[order]
    begins = np.append(np.ones(min(1, len(ordered)), bool), (ordered[1:] != ordered[:-1]).any(1))
    group = np.empty(len(ordered), np.int64)
    group[order] = np.cumsum(begins) - 1
    least = np.minimum.reduceat(ranks[order], np.flatnonzero(begins)) if len(ordered) else ranks
    return ordered[begins], group, least


class _Likely:
    """The windows of a block that are estimated to be repeated, by digest, each with its first document in the block."""

    def __init__(self, texts: pa.Table, answers: pa.Table, shape: _Sketch, width: int):
        self.words, ids = _Words(texts.column("text"), width), texts.column("doc_id").to_pylist()
        named = np.array([i is not None for i in ids])
        self.ids, ranks = ids, np.zeros(len(ids), np.int64)
        ranks[named] = _ranked([i for i in ids if i is not None])
        usable = np.flatnonzero(named[self.words.row])
        self.windows = usable[_repeated(self.words.hashes[usable], answers, shape)]
        rows = self.words.row[self.windows]
        self.docs = ranks[rows]
        digests = np.frombuffer(b"".join(self.words.digests(self.windows)), "<u8").reshape(-1, 2)
        self.digests, self.group, self.first = _grouped(digests, self.docs)
        self.row = np.zeros(len(self.first), np.int64)
        self.row[self.group[self.docs == self.first[self.group]]] = rows[self.docs == self.first[self.group]]

    def bounds(self, shards: int) -> np.ndarray:
        """Where the digests of each shard begin."""
        shard = ((self.digests[:, 0] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))


def _candidates(shape: _Sketch, shards: int, width: int, schema: pa.Schema):
    def candidates(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """The digests that are likely repeated, for each shard, with the first document of the block that has them."""
        if not len(texts):
            return schema.empty_table()
        likely = _Likely(texts, answers, shape, width)
        bounds = likely.bounds(shards)
        own = np.flatnonzero(np.diff(bounds)).tolist()
        parts = [slice(bounds[s], bounds[s + 1]) for s in own]
        columns = [[texts.column("block")[0].as_py()] * len(own), own, [likely.digests[p].tobytes() for p in parts]]
        columns.append([[likely.ids[r] for r in likely.row[p].tolist()] for p in parts])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return candidates


def _elsewhere(table: pa.Table) -> pa.Table:
    """Which digests of a block an earlier document of another block has."""
    parts = [np.frombuffer(x, "<u8").reshape(-1, 2) for x in table.column("digests").to_pylist()]
    ranks = _ranked(pc.list_flatten(table.column("first")).to_pylist())
    _, group, least = _grouped(np.concatenate(parts), ranks)
    earlier = np.split(least[group] < ranks, np.cumsum([len(x) for x in parts])[:-1])
    columns = [table.column("block"), table.column("shard"), pa.array([-1] * len(parts), pa.int32()), pa.array([np.packbits(x).tobytes() for x in earlier], pa.binary())]
    return pa.Table.from_arrays(columns, ["block", "shard", "row", "bits"])


def _dropped(shape: _Sketch, shards: int, width: int, schema: pa.Schema):
    def drop(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """The texts without the words of windows that an earlier document has."""
        if not len(texts):
            return schema.empty_table()
        exact = pc.equal(answers.column("row"), -1)
        likely = _Likely(texts, answers.filter(pc.invert(exact)), shape, width)
        words, group = likely.words, likely.group
        bounds, elsewhere = likely.bounds(shards), np.zeros(len(likely.first), bool)
        own = answers.filter(exact)
        for shard, bits in zip(own.column("shard").to_pylist(), own.column("bits").to_pylist(), strict=True):
            count = bounds[shard + 1] - bounds[shard]
            elsewhere[bounds[shard] : bounds[shard + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=count)
        # An earlier document of another block, or one of this block.
        gone = words.covered(likely.windows[elsewhere[group] | (likely.first[group] < likely.docs)])
        removed = np.bincount(words.rows[gone], minlength=len(texts))
        bounds, kept = np.append(0, np.cumsum(words.sizes)), words.texts
        for row in np.flatnonzero(removed).tolist():
            own = gone[bounds[row] : bounds[row + 1]].tolist()
            kept[row] = b" ".join([w for w, g in zip(kept[row].split(b" "), own, strict=True) if not g])
        columns = [texts.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(words.sizes), pa.array(removed)]
        return pa.Table.from_arrays(columns, schema=schema)

    return drop


def _schema(**kinds: str | T.DataType) -> T.StructType:
    schema = T.StructType()
    for name, kind in kinds.items():
        schema.add(name, kind)
    return schema


def without_repeats(
    docs: DataFrame, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS, shard_windows: int = SHARD_WINDOWS
) -> DataFrame:
    """(doc_id, text, n_words, n_removed): the words that no earlier document's window covers, joined by one space."""
    total = docs.agg(F.sum(F.octet_length(col("text")))).first()[0] or 0  # one number: how many blocks and shards
    windows = total // WORD_BYTES + 1
    shape = _Sketch(-(-windows // shard_windows), CELLS * shard_windows)
    kind = docs.schema["doc_id"].dataType

    block: Column = F.pmod(F.xxhash64(col("doc_id"), col("text")), F.lit(-(-windows // block_windows)))
    texts = docs.select(block.alias("block"), col("doc_id").alias("doc_id"), col("text").alias("text"))

    messages = texts.groupBy("block").applyInArrow(_sketched(shape, width), _MESSAGE)
    answers = messages.groupBy("shard", "row").applyInArrow(_merged(shape.cells), _ANSWER)

    found_as = _schema(block="long", shard="integer", digests="binary", first=T.ArrayType(kind))
    exact_shards = -(-windows // block_windows)
    found = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _candidates(shape, exact_shards, width, to_arrow_schema(found_as)), found_as
    )
    elsewhere = found.groupBy("shard").applyInArrow(_elsewhere, _ANSWER)

    out = _schema(doc_id=kind, text="string", n_words="long", n_removed="long")
    answers = answers.union(elsewhere)
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_dropped(shape, exact_shards, width, to_arrow_schema(out)), out)
