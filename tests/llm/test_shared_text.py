"""Repeated passages, prefix trees and token alignment against brute force, and on the edges."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulens.llm import alignment, prefixtrie, substrings
from tabulens.llm.queries import llm_queries, tokenizer_path

SCHEMA = "doc_id long, text string, block long, `Text.size` long, _row string"
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture
def docs(spark):
    loop = " ".join(["again and again the same words come back"] * 8)
    texts = [
        (5, f"alpha beta {PASSAGE} gamma"), (3, f"one\ttwo  {PASSAGE}\n three"), (9, PASSAGE), (9, PASSAGE), (None, f"{PASSAGE} unnamed"),
        (7, None), (8, ""), (10, " \n\t "), (11, "too short"), (12, loop), (13, f"before {loop} after"), (14, f"{PASSAGE} shared0 {PASSAGE}"),
        (2, " ".join(f"shared{i}" for i in range(48, 60)) + " é ü"), (20, " ".join(f"w{i % 97}x{i % 7}" for i in range(20_000))),
        (21, "tail " + " ".join(f"w{i % 97}x{i % 7}" for i in range(5, 3_000))), (22, "x" * 5_000 + " " + "y" * 3_000),
    ]
    return spark.createDataFrame([(i, t, 1, 2, "r") for i, t in texts], SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def kept_words(rows: list[tuple]) -> list[tuple]:
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, words in split:
        for p in range(len(words) - 12):
            if i is not None:
                first[tuple(words[p : p + 13])] = min(first.get(tuple(words[p : p + 13]), i), i)
    out = []
    for i, words in split:
        gone = set()
        for p in range(len(words) - 12):
            if i is not None and first[tuple(words[p : p + 13])] < i:
                gone.update(range(p, p + 13))
        out.append((i, b" ".join(w for p, w in enumerate(words) if p not in gone).decode(), len(words), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"block_windows": 400, "shard_windows": 300}, {"block_windows": 2_000, "shard_windows": 7}])
def test_repeated_passages(docs, sizes):
    found = substrings.without_repeats(docs, **sizes)
    assert found.columns == ["doc_id", "text", "n_words", "n_removed"]
    wanted = kept_words([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted((tuple(r) for r in found.collect()), key=str) == wanted
    assert sum(r[3] for r in wanted) > 1_000


def test_repeated_passages_of_no_documents(empty):
    assert substrings.without_repeats(empty).collect() == []


def test_windows_hash_alike_wherever_they_stand(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(substrings, "CHUNK", 50)
    words = substrings._Words(pa.chunked_array([pa.array([PASSAGE, None, "x " + PASSAGE + " y", "", "a b"])]), 13)
    assert words.sizes.tolist() == [60, 0, 62, 0, 2]
    assert np.array_equal(words.hashes[:48], words.hashes[49:97]) and len(set(words.hashes.tolist())) == 50


def test_a_sketch_loses_no_repeated_window(spark):
    """However small its cells: then everything counts as repeated, and the exact grouping decides."""
    texts = [(i, " ".join(f"v{(i * 31 + j) % 89}" for j in range(60))) for i in range(40)] + [(50, PASSAGE), (51, PASSAGE)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = substrings.without_repeats(docs, block_windows=100, shard_windows=1)
    assert sorted((tuple(r) for r in found.collect()), key=str) == kept_words(texts)


def tree(conversations: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in sorted(conversations, key=lambda r: (r[1] is not None, r[1] or 0)):
        if c is not None:
            own[c].append((role or "", text or ""))
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in sorted(paths.items()):
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for node, of in members.items():
        below = [n for n in members if n[: len(node)] == node]
        childless = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode().split()) for n in below if n)
        children = sum(len(n) == len(node) + 1 for n in below)
        parent = members[node[:-1]][0] if node else None
        out.append((of[0], len(node), parent, len(of), children, len(childless), saved, sha(",".join(map(str, ends[node])))))
    return sorted(out, key=str)


@pytest.fixture
def conversations():
    rng = np.random.default_rng(7)
    rows = []
    for c in [*range(0, 75), 101, 119, 140, 145, 163]:
        for turn in range(int(rng.integers(1, 6))):
            rows.append((c, turn, ["user", "assistant"][turn % 2], f"say {rng.integers(0, 2)} " * int(rng.integers(1, 3))))
    rows += [(200, None, None, "late"), (200, 1, "user", None), (200, 0, "", ""), (201, 3, "user", "a b"), (None, 0, "user", "lost")]
    rows += [(300, turn, "user", f"t{turn}") for turn in range(120)] + [(301, turn, "user", f"t{turn}") for turn in range(120)]
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("sizes", [{}, {"least": 1, "shard_steps": 20}, {"least": 6, "shard_steps": 40}, {"least": 1_000, "shard_steps": 100_000}])
def test_prefix_tree(spark, conversations, sizes, monkeypatch):
    monkeypatch.setattr(prefixtrie, "ID_RUN", 16)
    table = spark.createDataFrame([(*r, 1) for r in conversations], "conv_id long, turn long, role string, text string, place long")
    found = prefixtrie.prefix_tree(prefixtrie.rebuilt(prefixtrie.keyed(table)), **sizes).select(COLUMNS).collect()
    assert sorted((tuple(r) for r in found), key=str) == tree(conversations)


def test_prefix_tree_of_no_conversations(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixtrie.prefix_tree(prefixtrie.rebuilt(prefixtrie.keyed(table))).collect() == []


def test_repeated_turns_and_ties_are_turns_of_their_own(spark):
    rows = [(20, 1, "user", "a"), (20, 1, "user", "a"), (20, 1, "user", "b")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = [prefixtrie.prefix_tree(prefixtrie.keyed(t)).agg(F.max("depth"), F.count("*")).first() for t in (table, table.orderBy(F.desc("text")))]
    assert [tuple(r) for r in found] == [(3, 4), (3, 4)]


def test_double_array_finds_every_child():
    rng = np.random.default_rng(3)
    parents, labels, taken = [], [], set()
    for i in range(3_000):
        parent, label = int(rng.integers(-1, max(1, i // 2))) if i else -1, int(rng.integers(0, 400))
        if parent < i and (parent, label) not in taken:
            taken.add((parent, label))
            parents.append(parent)
            labels.append(label)
    valid = [i for i, p in enumerate(parents) if p < i]
    assert len(valid) == len(parents)
    trie = prefixtrie.DoubleArray(np.array(parents), np.array(labels))
    assert len(set(trie.cells.tolist())) == len(parents)
    state = lambda i: 0 if i < 0 else int(trie.cells[i])
    edges = set(zip(parents, labels, strict=True))
    for i, (p, c) in enumerate(zip(parents, labels, strict=True)):
        assert trie.child(state(p), c) == state(i)
    for p in range(-1, 200):
        for c in range(0, 400, 7):
            assert (trie.child(state(p), c) is not None) == ((p, c) in edges)
    assert sum(map(len, trie.levels())) == len(parents) + 1


TEXTS = [
    "Plain words, and more of them.", "  leading and   double spaces ", "tabs\tand\nlines \n mixed\n\n  in", "naïve café 東京 🎉🎉 مرحبا", "<|endoftext|> is text <s> too </s>",
    "x" * 300, " ", "  ", "\n", "a b 　 c", "it's we'll 12345 67,890.1", "ﬁne ① ½ é", "▁ mark ▁▁", "", None, "the the the the", "the the the the",
]


def brute_alignment(texts: list[tuple]) -> list[tuple]:
    import sentencepiece
    from tokenizers import Tokenizer, pre_tokenizers

    first = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    letters = sorted(pre_tokenizers.ByteLevel.alphabet(), key=ord)
    own = [c for c in letters if ord(c) < 256]
    rest = iter(sorted(set(range(256)) - {ord(c) for c in own}))
    byte = {c: ord(c) if ord(c) < 256 else next(rest) for c in letters}

    def b_bytes(i: int) -> bytes:
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    def spans(ids, of) -> list[tuple]:
        out, at = [], 0
        for i, token in zip(ids, of, strict=True):
            out.append((i, at, at + len(token)))
            at += len(token)
        return out

    rows = []
    for doc, text in texts:
        a, b = [], []
        if text:
            found = first.encode(" " + text, add_special_tokens=False)
            pieces = second.encode(text)
            of = [bytes(byte[c] for c in t) for t in found.tokens], [b_bytes(i) for i in pieces]
            if all(b"".join(x) == (" " + text).encode() for x in of):
                a, b = spans(found.ids, of[0]), spans(pieces, of[1])
        links = []
        for x, i, j in a:
            links += [(x, y) for y, k, m in b if k < j and i < m]
        ends = sorted({j for _, _, j in a} & {j for _, _, j in b})
        groups = [
            ",".join(str(x) for x, _, j in a if lo < j <= hi) + "|" + ",".join(str(y) for y, _, j in b if lo < j <= hi)
            for lo, hi in zip([0, *ends], ends, strict=False)
        ]
        rows.append((doc, len(a), len(b), groups, links))
    counts = Counter(pair for r in rows for pair in r[4])
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted(
        (
            (doc, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha(";".join(groups)) if groups else "")
            for doc, n_a, n_b, groups, links in rows
        ),
        key=str,
    )


@pytest.mark.parametrize("sizes", [{}, {"piece": 5, "block_bytes": 150, "shard_blocks": 2}, {"piece": 16, "block_bytes": 2_000}])
def test_alignment(spark, sizes):
    long = " ".join(f"Wor{i % 37}d tion{i % 11}ing of,th" for i in range(150))
    texts = [*enumerate([*TEXTS, long, long[5:]]), (None, "the nameless the"), (3, "same id")]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in texts], "doc_id long, text string, uid long, piece string")
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    found = alignment.aligned(docs, *paths, **sizes)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_alignment(texts)
    assert alignment.aligned(docs.where("doc_id > 1000"), *paths).collect() == []


def test_alignment_of_the_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 3000").collect()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = alignment.aligned(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), piece=700, block_bytes=60_000)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_alignment([tuple(r) for r in rows])


def test_merge_path_cuts_between_ends():
    rng = np.random.default_rng(1)
    for _ in range(200):
        total = int(rng.integers(1, 60))
        a, b = (np.union1d(rng.choice(np.arange(1, total + 1), rng.integers(0, total)), [total]) for _ in range(2))
        merged = sorted([*a.tolist(), *b.tolist()])
        for diagonal in range(len(merged) + 1):
            i, j = alignment.merge_path(a, b, diagonal)
            taken = sorted([*a[:i].tolist(), *b[:j].tolist()])
            assert taken == merged[: len(taken)] and diagonal <= len(taken) <= diagonal + 1
            assert len(taken) == len(merged) or merged[len(taken) - 1 : len(taken)] != merged[len(taken) : len(taken) + 1] or not taken
        pieces = list(alignment.pieces_of(a, b, 7))
        assert sum(p[4] for p in pieces) == total


def test_queries_have_the_columns_of_their_contracts(spark):
    queries = llm_queries()
    found = {n: queries[n](spark, "/root/testdata/sf0.001") for n in ("op11_substring_dedup", "op12_prefix_trie", "op13_token_alignment")}
    assert found["op11_substring_dedup"].columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert set(found["op12_prefix_trie"].columns) == set(COLUMNS)
    assert found["op13_token_alignment"].columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
