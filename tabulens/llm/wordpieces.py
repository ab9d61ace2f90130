"""Token counts of greedy longest-match word pieces, by a linear automaton.

The vocabulary is a trie of pieces, those that continue a word under a suffix root. Each node has
a failure link, the node of what remains of its string after the pieces that greedy matching takes
off its front, and the number of those pieces, computed once. A word is then one pass over its
characters: where the trie has no edge, the popped count is added and the failure link followed,
and no piece is ever built. A word that greedy matching cannot cut is one unknown piece.

Words are runs of letters, digits and marks, and every other visible character is a word of its
own. The automaton has as many nodes as the vocabulary has prefixes; the vocabulary is bounded by
its file and is sent with the tasks. Counts of words are remembered, up to ``REMEMBERED`` of them.

Defined results: NULL and empty texts count 0; NULL or repeated doc_ids are rows like any other; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

REMEMBERED = 400_000
_WORDS = re.compile(r"\w+|[^\w\s]")


class Automaton:
    """Longest-match counts for a vocabulary of (piece, continues a word)."""

    def __init__(self, pieces: Iterable[tuple[str, bool]]):
        self.edges: list[dict[str, int]] = [{}, {}]  # 0 begins a word, 1 continues it
        final = set()
        for piece, continues in pieces:
            node = int(continues)
            for character in piece:
                if character not in self.edges[node]:
                    self.edges[node][character] = len(self.edges)
                    self.edges.append({})
                node = self.edges[node][character]
            if piece:
                final.add(node)
        size = len(self.edges)
        self.fail, self.popped = [-1] * size, [0] * size
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for character, child in self.edges[node].items():
                queue.append(child)
                if child in final:  # the whole string is one piece
                    self.fail[child], self.popped[child] = 1, 1
                    continue
                back, count = self.fail[node], self.popped[node]
                while back >= 0 and character not in self.edges[back]:
                    count += self.popped[back]
                    back = self.fail[back]
                if back >= 0:
                    self.fail[child], self.popped[child] = self.edges[back][character], count

    def count(self, word: str) -> int:
        """Pieces of a word, 0 if greedy matching cannot cut it."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node, total = 0, 0
        for character in word:
            while (child := edges[node].get(character)) is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = child
        while node != 1:  # what is left in the trie comes apart in whole pieces or not at all
            total += popped[node]
            node = fail[node]
            if node < 0:
                return 0
        return total


def sentencepiece_vocabulary(path: str) -> list[tuple[str, bool]]:
    """The pieces of a sentencepiece model; those without the mark of a word's begin continue one."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [model.id_to_piece(i) for i in plain]
    return [(p.removeprefix("▁"), not p.startswith("▁")) for p in pieces if "▁" not in p[1:] and p != "▁"]


@cache
def _automaton(vocabulary: tuple[tuple[str, bool], ...]) -> Automaton:
    return Automaton(vocabulary)


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = self.automaton.count(word)
        return found


def _counter(vocabulary: tuple[tuple[str, bool], ...]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(_automaton(vocabulary))
        for batch in batches:
            words, pieces, unknown = [], [], []
            for text in batch.column("text").to_pylist():
                own = [counts[w] for w in _WORDS.findall(text or "")]
                missing = own.count(0)
                words.append(len(own))
                pieces.append(sum(own) + missing)
                unknown.append(missing)
            columns = [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (words, pieces, unknown)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_pieces", "n_unknown"])

    return count


def token_counts(docs: DataFrame, vocabulary: Iterable[tuple[str, bool]]) -> DataFrame:
    """(doc_id, n_words, n_pieces, n_unknown) of (doc_id, text); an unknown word is one piece."""
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("n_words", "n_pieces", "n_unknown")]
    return docs.select("doc_id", "text").mapInArrow(_counter(tuple(vocabulary)), T.StructType(fields))
