"""Tokens of two tokenizers over the same bytes: which overlap, and the smallest groups that end together.

 1. Texts are encoded once by both tokenizers. Runs between a character and a space behind it are
    encoded by themselves and remembered, because no token of either tokenizer spans such a place.
 2. The ends of a text's A and B tokens are two ascending lists. Merge-path partitioning cuts
    their merge into pieces of equal work: a binary search along each diagonal finds how many ends
    of either list lie before it. Pieces do not depend on each other, and a long text's
    pieces are dealt to different tasks, by a hash of their content into blocks.
 3. Every end in the merge closes one overlap of an A and a B token, a link; an end of both
    closes a group. Blocks count their id pairs and send them to shards by the B id; a shard adds
    up the pairs, finds the highest of each B id and answers each block about its own pairs.
 4. Blocks learn the counts of their links. What a piece leaves open at its borders is
    stitched to groups, in the order of the pieces, without holding a text's pieces at once.

Defined results: texts that are NULL or empty, or whose joined tokens of A or B are not a space
and the text, have no tokens and zeros; repeated rows count each for itself; names of special tokens
are plain text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.llm.common import col
from tabulens.llm.packing import _Encoder

#: Ends of a piece, bytes of text of a block, and blocks whose pairs a shard adds up, about.
PIECE, BLOCK_BYTES, SHARD_BLOCKS = 1 << 16, 2 << 20, 32
#: Texts that are encoded at a time, runs that are remembered, and the longest of them; only speed depends on these.
TEXTS, REMEMBERED, LONGEST = 128, 100_000, 48
#: Bits of an id.
BITS = 24
#: White space before a space: no run may begin at that space.
SPACED = re.compile(r"[\s\x1c-\x1f\x85] ")


class Tokenizers:
    """A byte-level BPE file (A) and a sentencepiece model (B): ids of a space and a text, and bytes of ids."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = _Encoder(a_path).ranked
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_lengths = np.array([len(p) for p in self.b_bytes], np.int64)
        known = {i: len(token) for token, i in self.a._mergeable_ranks.items()}
        self.a_lengths = np.array([known.get(i, 0) for i in range(max(known) + 1)], np.int64)
        self._apart = all("▁" not in p.lstrip("▁") for p in pieces)
        self._runs: dict[str, tuple[bytes, bytes] | None] = {}

    def _whole(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of texts, each behind a space; None where the joined tokens are not that."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            same = b"".join([self.b_bytes[i] for i in b]) == b" " + text.encode()
            out.append((array("I", self.a.encode_ordinary(" " + text)).tobytes(), array("I", b).tobytes()) if same else None)
        return out

    def _split(self, text: str) -> list[str]:
        """The text cut at spaces behind a character that is not white space, without these spaces."""
        if not self._apart:
            return [text]
        if text[0] != " " and not SPACED.search(text):
            return text.split(" ")
        runs: list[str] = []
        for part in text.split(" "):
            # A run ends where white space does not: else the next part belongs to it.
            if runs and (not part or not runs[-1] or runs[-1][-1].isspace()):
                runs[-1] += " " + part
            else:
                runs.append(part)
        return runs

    def __call__(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        split = [self._split(t) if t else [] for t in texts]
        known = self._runs
        if len(known) > REMEMBERED:
            known.clear()
        new = list({r for runs in split for r in runs if r not in known})
        known.update(zip(new, self._whole(new), strict=True))
        out = []
        for text, runs in zip(texts, split, strict=True):
            ids = [known[r] for r in runs]
            if None in ids:
                whole = self._whole([text])[0]
                ids = [] if whole is None else [whole]
            out.append(tuple(np.frombuffer(b"".join([x[i] for x in ids]), np.uint32) for i in (0, 1)))
        for run in new:
            if len(run) > LONGEST:
                del known[run]
        return out


def merge_path(a: np.ndarray, b: np.ndarray, diagonal: int) -> tuple[int, int]:
    """How many of the ascending ends ``a`` and ``b`` are among the first ``diagonal`` of their merge, an equal end of b with that of a."""
    low, high = max(0, diagonal - len(b)), min(diagonal, len(a))
    while low < high:
        middle = (low + high) // 2
        if a[middle] <= b[diagonal - middle - 1]:
            low = middle + 1
        else:
            high = middle
    j = diagonal - low
    return low, j + int(0 < low and j < len(b) and b[j] == a[low - 1])


def pieces_of(a: np.ndarray, b: np.ndarray, piece: int) -> Iterator[tuple[slice, slice, int, int, int]]:
    """For each piece of the merge: its A and B tokens, the bytes of the first ones before it, and its own bytes."""
    start, i, j, total = 0, 0, 0, len(a) + len(b)
    for diagonal in [*range(piece, total, piece), total]:
        i_next, j_next = merge_path(a, b, diagonal)
        stop = int(max(a[i_next - 1] if i_next else 0, b[j_next - 1] if j_next else 0))
        if stop == start and total:
            continue
        tokens = [slice(k, int(np.searchsorted(ends, stop)) + 1) for ends, k in ((a, i), (b, j))]
        skips = [start - int(ends[k - 1]) if k else 0 for ends, k in ((a, i), (b, j))]
        yield *tokens, *skips, stop - start
        start, i, j = stop, i_next, j_next


def _pieces(a_path: str, b_path: str, piece: int, schema: pa.Schema):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(a_path, b_path)
        narrow = ["<u2" if len(x) <= 1 << 16 else "<u4" for x in (tokenizers.a_lengths, tokenizers.b_lengths)]
        for batch in batches:
            for first in range(0, len(batch), TEXTS):
                part = batch.slice(first, TEXTS)
                rows, numbers, counts, a_ids, b_ids, a_skips, b_skips, sizes = ([] for _ in range(8))
                for row, (a, b) in enumerate(tokenizers(part.column("text").to_pylist())):
                    a_ends, b_ends = np.cumsum(tokenizers.a_lengths[a]), np.cumsum(tokenizers.b_lengths[b])
                    own = list(pieces_of(a_ends, b_ends, piece))
                    for number, (a_slice, b_slice, a_skip, b_skip, size) in enumerate(own):
                        a_ids.append(a[a_slice].astype(narrow[0]).tobytes())
                        b_ids.append(b[b_slice].astype(narrow[1]).tobytes())
                        for values, value in zip((rows, numbers, counts, a_skips, b_skips, sizes), (row, number, len(own), a_skip, b_skip, size), strict=True):
                            values.append(value)
                kept = [part.column(n).take(pa.array(rows, pa.int64())) for n in ("uid", "mark", "doc_id")]
                columns = [*kept, numbers, counts, a_ids, b_ids, a_skips, b_skips, sizes]
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return encode


class _Block:
    """All pieces of a block side by side, as if they were one text."""

    def __init__(self, table: pa.Table, lengths: tuple[np.ndarray, np.ndarray]):
        sizes = table.column("size").to_numpy()
        self.stops = np.cumsum(sizes)  # where each piece ends
        total = int(self.stops[-1])
        self.a, self.a_real, a_ends = self._side(table, "a", "a_skip", lengths[0], sizes)
        self.b, self.b_real, b_ends = self._side(table, "b", "b_skip", lengths[1], sizes)
        # A token behind the border of a piece ends at the border here, but really in a later piece.
        marks = [np.zeros(total + 1, bool) for _ in range(4)]
        for mark, ends in zip(marks, (a_ends, b_ends, a_ends[self.a_real], b_ends[self.b_real]), strict=True):
            mark[ends] = True
        self.ends = np.flatnonzero(marks[0] | marks[1])
        self.cut = marks[2][self.ends] & marks[3][self.ends]
        # The tokens over the bytes before each end: as many ended before it.
        self.link_a, self.link_b = (ids[(np.cumsum(m) - m)[self.ends]] for ids, m in ((self.a, marks[0]), (self.b, marks[1])))
        self.a_ends, self.b_ends = a_ends[self.a_real], b_ends[self.b_real]
        self.links = np.searchsorted(self.ends, np.append(0, self.stops), "right")  # where each piece's links begin
        parted = marks[2] & marks[3]
        parted[self.stops] = True
        #: Where fragments end, that is groups, or what a piece has of one; and the fragment of each token.
        self.fragments = np.flatnonzero(parted)
        of = np.cumsum(parted) - parted
        self.a_of, self.b_of = of[self.a_ends], of[self.b_ends]

    def _side(self, table: pa.Table, ids: str, skip: str, lengths: np.ndarray, sizes: np.ndarray):
        kind = "<u2" if len(lengths) <= 1 << 16 else "<u4"
        own = [np.frombuffer(x, kind) for x in table.column(ids).to_pylist()]
        counts = np.array([len(x) for x in own])
        tokens = np.concatenate(own).astype(np.int64)
        ends, first = np.cumsum(lengths[tokens]), np.cumsum(counts) - counts
        before = np.append(0, ends)[first] + table.column(skip).to_numpy()
        ends -= np.repeat(before, counts)
        limit = np.repeat(sizes, counts)
        return tokens, ends <= limit, np.minimum(ends, limit) + np.repeat(self.stops - sizes, counts)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per piece the sum over its links."""
        running = np.append(0, np.cumsum(values))
        return running[self.links[1:]] - running[self.links[:-1]]

    def pairs(self, shards: int) -> np.ndarray:
        """A number for the pair of each link: shard of the B id, B id, A id."""
        return (((self.link_b % shards) << BITS | self.link_b) << BITS) | self.link_a

    def texts(self, digits: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Groups as text, `a1,a2|b1;` each, and per fragment where its A and its B part end.

        A part of a fragment may be empty.
        """
        a_of, b_of = self.a_of, self.b_of
        a_count, b_count = (np.bincount(x, minlength=len(self.fragments)) for x in (a_of, b_of))
        a_stop, b_stop = np.cumsum(a_count), np.cumsum(b_count)
        ids = np.zeros(len(a_of) + len(b_of), np.int64)
        a_at, b_at = np.arange(len(a_of)) + (b_stop - b_count)[a_of], np.arange(len(b_of)) + a_stop[b_of]
        ids[a_at], ids[b_at] = self.a[self.a_real], self.b[self.b_real]
        table, size = digits
        out = np.empty((len(ids), table.shape[1] + 1), np.uint8)
        out[:, :-1], out[:, -1] = table[ids], ord(",")
        a_last, b_last = (a_stop + b_stop - b_count - 1)[a_count > 0], (a_stop + b_stop - 1)[b_count > 0]
        out[a_last, -1], out[b_last, -1] = ord("|"), ord(";")
        shown = np.arange(out.shape[1]) >= (table.shape[1] - size[ids])[:, None]
        stops = np.append(0, np.cumsum(size[ids] + 1))
        return out[shown].tobytes(), stops[a_stop + b_stop - b_count], stops[a_stop + b_stop]


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below ``most``, right-aligned, and how many there are."""
    width = len(str(most))
    numbers = np.arange(most)
    table = np.stack([numbers // 10**i % 10 for i in reversed(range(width))], 1).astype(np.uint8) + ord("0")
    return table, np.maximum(1, np.searchsorted(10 ** np.arange(width), numbers, "right"))


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte: all lowest bytes first; the high ones are mostly zero and compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def _runs_of(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin in ascending ones."""
    return np.flatnonzero(np.diff(ordered, prepend=-1))


def _counted(lengths, shards: int):
    def count(table: pa.Table) -> pa.Table:
        """The id pairs of a block with their links, for each shard."""
        pairs = np.sort(_Block(table, lengths).pairs(shards))
        heads = _runs_of(pairs)
        pairs, counts = pairs[heads], np.diff(heads, append=len(pairs))
        bounds = np.searchsorted(pairs, np.arange(shards + 1) << (2 * BITS))
        own = np.flatnonzero(np.diff(bounds)).tolist()
        parts = [slice(bounds[s], bounds[s + 1]) for s in own]
        steps = [_planes(np.diff(pairs[p], prepend=s << (2 * BITS))) for s, p in zip(own, parts, strict=True)]
        block = table.column("block")[0].as_py()
        columns = [pa.array([block] * len(own), pa.int64()), pa.array(own, pa.int32()), pa.array(steps, pa.binary())]
        return pa.Table.from_arrays([*columns, pa.array([_planes(counts[p]) for p in parts], pa.binary())], ["block", "shard", "pairs", "counts"])

    return count


def _added(table: pa.Table) -> pa.Table:
    """What each block wants to know of its pairs: their links in all blocks, and whether their B id has more with another A id."""
    pairs = [np.cumsum(_unplanes(x)) for x in table.column("pairs").to_pylist()]
    every, counts = np.concatenate(pairs), np.concatenate([_unplanes(x) for x in table.column("counts").to_pylist()])
    order = np.argsort(every, kind="stable")
    heads = _runs_of(every[order])
    known, totals = every[order][heads], np.add.reduceat(counts[order], heads)
    ids = _runs_of(known >> BITS)
    best = totals == np.repeat(np.maximum.reduceat(totals, ids), np.diff(ids, append=len(known)))
    said = 2 * totals + best
    answers = [_planes(said[np.searchsorted(known, p)]) for p in pairs]
    return pa.Table.from_arrays([table.column("block"), table.column("shard"), pa.array(answers, pa.binary())], ["block", "shard", "answers"])


def _aligned(lengths, shards: int, schema: pa.Schema):
    def align(table: pa.Table, answers: pa.Table) -> pa.Table:
        """One row for each piece: its counts, and the text of its groups where it ends a text, else what is left to stitch."""
        if not len(table):
            return schema.empty_table()
        block = _Block(table, lengths)
        answers = answers.sort_by("shard").column("answers").to_pylist()
        said = np.concatenate([np.empty(0, np.int64), *map(_unplanes, answers)])
        found = said[np.unique(block.pairs(shards), return_inverse=True)[1]]
        text, a_stops, b_stops = block.texts(_digits(max(map(len, lengths))))
        bounds = np.searchsorted(block.fragments, np.append(0, block.stops), "right")  # where each piece's fragments begin
        real = [np.diff(np.searchsorted(e, np.append(0, block.stops), "right")) for e in (block.a_ends, block.b_ends)]
        groups = block.sums(block.cut)
        shas, parts, counts = [], [], table.column("pieces").to_pylist()

        def part(fragment: int) -> tuple[bytes, bytes]:
            start = b_stops[fragment - 1] if fragment else 0
            return text[start : max(start, a_stops[fragment] - 1)], text[a_stops[fragment] : max(a_stops[fragment], b_stops[fragment] - 1)]

        for i, count in enumerate(counts):
            first, stop, has = bounds[i], bounds[i + 1], int(groups[i])
            begin, end = (b_stops[x - 1] if x else 0 for x in (first, stop))
            if count == 1:
                shas.append(hashlib.sha256(text[begin : end - 1]).hexdigest() if end > begin else "")
                parts.append((None,) * 5)
                continue
            shas.append(None)
            opened = part(stop - 1) if stop - first > has else (b"", b"")
            closed = part(first) if has else (b"", b"")
            body = text[b_stops[first] : b_stops[first + has - 1]] if has else None
            parts.append((*closed, body, *opened))
        columns = [table.column(n) for n in ("uid", "doc_id", "piece", "pieces")]
        columns += [*real, groups, np.diff(block.links), block.sums(found & 1), block.sums(found >> 1), shas, *zip(*parts, strict=True)]
        arrays = [c if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
        return pa.Table.from_arrays(arrays, schema=schema)

    return align


_SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _stitched(schema: pa.Schema):
    """Rows of pieces, sorted by text and piece, to rows of texts: the hash runs on, only an open group is kept."""

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sha, begun, pending = None, None, False, ([], [])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["piece"] == 0:
                    sums, sha, begun, pending = [0] * len(_SUMS), hashlib.sha256(), False, ([], [])
                sums = [s + r[n] for s, n in zip(sums, _SUMS, strict=True)]
                if r["body"] is not None:
                    closed = [b",".join([*held, *([own] if own else [])]) for held, own in zip(pending, (r["closed_a"], r["closed_b"]), strict=True)]
                    sha.update((b";" if begun else b"") + closed[0] + b"|" + closed[1])
                    sha.update(b";" + r["body"][:-1] if r["body"] else b"")
                    begun, pending = True, ([], [])
                for held, own in zip(pending, (r["open_a"], r["open_b"]), strict=True):
                    held.extend([own] if own else [])
                if r["piece"] == r["pieces"] - 1:
                    rows.append((r["doc_id"], *sums, r["sha"] if r["pieces"] == 1 else sha.hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return stitch


def _schema(text: str, kind: T.DataType) -> T.StructType:
    fields = [x.split() for x in text.split(", ")]
    schema = T.StructType()
    for name, of in fields:
        schema.add(name, kind if of == "id" else of)
    return schema


def aligned(
    docs: DataFrame, a_path: str, b_path: str, piece: int = PIECE, block_bytes: int = BLOCK_BYTES, shard_blocks: int = SHARD_BLOCKS
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    from pyspark.sql.pandas.types import to_arrow_schema

    tokenizers = Tokenizers(a_path, b_path)
    lengths = tokenizers.a_lengths, tokenizers.b_lengths
    total = docs.agg(F.sum(F.octet_length(col("text")))).first()[0] or 0  # one number: how many blocks and shards
    blocks = total // block_bytes + 1
    shards = min(len(lengths[1]), -(-blocks // shard_blocks))
    kind = docs.schema["doc_id"].dataType

    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.xxhash64(col("doc_id"), col("text")).alias("mark"), col("doc_id").alias("doc_id"), col("text").alias("text")
    )
    pieces_as = _schema("uid long, mark long, doc_id id, piece integer, pieces integer, a binary, b binary, a_skip long, b_skip long, size long", kind)
    cut = rows.mapInArrow(_pieces(a_path, b_path, piece, to_arrow_schema(pieces_as)), pieces_as)
    cut = cut.select(F.pmod(F.xxhash64("mark", "piece"), F.lit(blocks)).alias("block"), *[n for n in pieces_as.names if n != "mark"])

    counted = cut.groupBy("block").applyInArrow(_counted(lengths, shards), "block long, shard int, pairs binary, counts binary")
    answers = counted.groupBy("shard").applyInArrow(_added, "block long, shard int, answers binary")
    found_as = _schema(
        "uid long, doc_id id, piece integer, pieces integer, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "sha string, closed_a binary, closed_b binary, body binary, open_a binary, open_b binary", kind,
    )
    found = cut.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_aligned(lengths, shards, to_arrow_schema(found_as)), found_as)
    out = _schema("doc_id id, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string", kind)
    return found.repartition("uid").sortWithinPartitions("uid", "piece").mapInArrow(_stitched(to_arrow_schema(out)), out)
