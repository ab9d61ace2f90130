"""The corpus operators against brute force, and on the edges: NULLs, empty and long texts, ties, repeated rows."""

from __future__ import annotations

import hashlib
import io
import math
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulens.llm import graphs, licenses, mixing, neardup, packing, quality, search, secrets, toxicity, warc, wordpieces
from tabulens.llm.queries import tokenizer_path

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(120))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `Text.size` long, _row string"


@pytest.fixture
def docs(spark):
    texts = [
        (1, BASE, "a"), (2, BASE, "a"), (2, BASE, "a"), (3, BASE.replace("word60 ", "other "), "b"), (4, None, "b"), (5, "", "a"),
        (6, " \n\t ", None), (7, "Two words", "c"), (8, "two WORDS", "c"), (None, BASE, "a"), (9, LONG, "a"),
        (10, "token=token=abcdef password: 'abc' AKIA" + "B" * 20 + " " + "0a" * 12 + " TOKEN=\"é", "b"), (11, "<|endoftext|> é  x ", "b"),
    ]
    return spark.createDataFrame([(i, t, "en", s, None, 1, "r") for i, t, s in texts], SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mix(docs, empty):
    found = mixing.mix(docs, block_words=7).collect()
    assert len(found) == 13 and mixing.mix(empty).collect() == []
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs, block_words=64).collect()))
    by_target = Counter()
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_target[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(taken - target) <= 1 for (_, target), taken in by_target.items())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len((r["text"] or "").encode().split()) for r in out.collect()) == sum(r["taken"] for r in found)


def test_mixed_documents_by_position(spark):
    """Every prefix of the ordered mix holds the sources near their weights, hot or not."""
    rows = [(i, f"{BASE} {i}", "a" if i % 6 else "b") for i in range(600)] + [(600, None, "a"), (601, BASE, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = {r["source"]: 0 for r in docs.select("source").distinct().collect()}
    for r in mixing.scheduled(docs, block_words=200).join(docs, "doc_id").collect():
        words[r["source"]] += r["taken"]
        assert (r["position"] is None) == (r["taken"] == 0)
    total, seen, n = sum(words.values()), Counter(), 0
    out = mixing.mixed_documents(docs, block_words=200, ordered=True).collect()
    for r in out[:-1]:
        n += len(r["text"].split())
        seen[r["source"]] += len(r["text"].split())
        assert all(abs(seen[s] - n * w / total) <= 12 * 200 for s, w in words.items())
    assert out[-1]["doc_id"] == 600 and n == total
    assert [r["doc_id"] for r in out] == [r["doc_id"] for r in mixing.mixed_documents(docs, block_words=200, ordered=True).collect()]


def test_mix_keeps_documents_without_words(docs):
    rows = [(r["doc_id"], r["text"]) for r in mixing.mixed_documents(docs).collect()]
    assert [rows.count(x) for x in ((4, None), (5, ""), (6, " \n\t "))] == [1, 1, 1]


def test_schedule_ranks(spark):
    shares = spark.createDataFrame([("a", 57), ("b", 9), (None, 121), ("c", 0)], "source string, words long")
    rows = sorted(mixing.schedule(shares, 2).collect(), key=lambda r: r["position"])
    assert Counter(r["source"] for r in rows) == {"a": 29, "b": 5, None: 61}
    seen = Counter()
    for r in rows:
        assert r["rank"] == seen[r["source"]]
        seen[r["source"]] += 1


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 900), ("b", 10), ("c", 0), (None, 90)], "source string, source_size long")
    target = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert target == {"a": 700.0, "b": 30.0, "c": 0.0, None: 270.0}


def test_token_counts(spark, docs, empty):
    vocabulary = [("a", False), ("ab", False), ("abc", False), ("b", True), ("bc", True), ("c", True), ("cde", True), ("d", True), ("e", False)]
    automaton = wordpieces.Automaton(vocabulary)
    first, rest = {p for p, c in vocabulary if not c}, {p for p, c in vocabulary if c}

    def greedy(word):
        at, count = 0, 0
        while at < len(word):
            fits = [n for n in range(len(word) - at, 0, -1) if word[at : at + n] in (rest if at else first)]
            if not fits:
                return 0
            at, count = at + fits[0], count + 1
        return count

    rng = np.random.default_rng(1)
    for _ in range(3000):
        word = "".join(rng.choice(list("abcde"), rng.integers(1, 9)))
        assert automaton.count(word) == greedy(word), word
    found = wordpieces.token_counts(docs, vocabulary).collect()
    assert len(found) == 13 and {r["n_pieces"] for r in found if r["doc_id"] in (4, 5, 6)} == {0}
    assert wordpieces.token_counts(empty, vocabulary).collect() == []
    real = wordpieces.sentencepiece_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    assert wordpieces.token_counts(docs.where("doc_id = 7"), real).first()["n_pieces"] >= 2


def test_secrets(docs, empty):
    found = {r["doc_id"]: r for r in secrets.scan(docs).collect() if r["doc_id"] is not None}
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for i, row in found.items():
        spans = []
        for number, rule in enumerate(secrets.RULES):
            for m in re.finditer(secrets.class_pattern(rule.pattern), text[i]):
                if len(m.group(rule.group)) >= rule.least:
                    spans.append((m.start(), number, f"{rule.kind}:{m.start()}:{m.end()}", number))
        assert row["spans"] == ",".join(s[2] for s in sorted(spans))
        assert row["base_sha256"] == hashlib.sha256(",".join(s[2] for s in sorted(spans) if s[3] < 3).encode()).hexdigest()
    assert (found[10]["n_assign"], found[10]["n_access"], found[10]["n_hex"]) == (1, 1, 1)
    assert secrets.scan(docs).count() == 13 and secrets.scan(empty).collect() == []
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and "AKIA" not in clean.where("doc_id = 10").first()["text"]
    assert secrets.trigram_query("[0-9a-f]{24,}") is None and secrets.trigram_query("x?AKIA(bd|ce)") == [["abd", "aki", "iab", "kia"], ["ace", "aki", "iac", "kia"]]


def _components(texts: dict[int, str | None]) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_near_duplicates(spark, docs, empty):
    found = neardup.near_duplicates(docs).collect()
    assert len(found) == 13 and neardup.near_duplicates(empty).collect() == []
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == _components(texts)
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [1]
    kept = [r["doc_id"] for r in neardup.deduplicated(docs).collect()]
    assert sorted(kept) == [1, 4, 5, 6, 7, 9, 10, 11]


def test_near_duplicates_in_groups(spark, monkeypatch):
    """Chains of edited copies beside a passage that all share, in small blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = np.random.default_rng(3)
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = []
    for g in range(4):
        words = [f"g{g}w{i}" for i in range(100)]
        for _ in range(25):
            words = list(words)
            for k in rng.integers(0, 100, int(rng.integers(0, 4))):
                words[int(k)] = f"e{len(rows)}_{k}"
            rows.append((len(rows), " ".join(words) + " " + passage))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == _components(dict(rows))


def test_links_far_below_their_estimate(spark):
    """A copy whose appended words fill much of its sketch: similar, but the sketches share few values."""
    words = [f"w{i}" for i in range(700)]
    longer = list(words)
    for i in range(100):
        pool = [f"x{i}y{k}" for k in range(80 if i < 25 else 1)]
        longer.append(min(pool, key=lambda w: neardup.shingle_set(" ".join([*longer[-4:], w]), neardup._Hashes())[0]))
    rows = [(1, " ".join(words)), (2, " ".join(longer))]
    a, b = (neardup.shingle_set(t, neardup._Hashes()) for _, t in rows)
    shared = len(set(a[: neardup.SKETCH]) & set(b[: neardup.SKETCH]))
    assert neardup.SHARED <= shared <= 28 and len(set(a) & set(b)) >= 0.85 * len(set(a) | set(b))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {1}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60) if i % 20] + [(100, 100), (3, 45)]
    found = dict(graphs.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 1 if i <= 20 or i > 40 else 21 for i in range(1, 61)}


@pytest.mark.parametrize("held", [200_000, 7])
def test_components_of_few_edges_take_few_tasks(spark, monkeypatch, held):
    """A path, stars, a ring and copies of edges, with and without shuffled steps; few edges need no shuffle."""
    monkeypatch.setattr(graphs, "EDGES", held)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)] + [(300 + i, 300 + (i + 1) % 9) for i in range(9)] * 2
    context, group, name = spark.sparkContext, f"components-{held}", "spark.sql.adaptive.coalescePartitions.enabled"
    context.setJobGroup(group, "components")
    spark.conf.set(name, "false")
    found = dict(graphs.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect())
    spark.conf.unset(name)
    context.setLocalProperty("spark.jobGroup.id", None)
    assert found == {n: n // 100 * 100 for e in edges for n in e}
    tracker = context.statusTracker()
    infos = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    tasks = sum(x.numTasks for x in infos if x)
    assert tasks <= 40 if held > len(edges) else tasks > 40, tasks


def test_search(spark, docs):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"t{int(x)}" for x in rng.zipf(1.4, int(rng.integers(1, 40))) % 200)) for i in range(400)] + [(7, "t1 t2"), (400, None), (401, "")]
    table = spark.createDataFrame(rows, "id long, text string")
    queries = table.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    got = {}
    for r in search.top_k(table, queries, 5).collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    words = [(i, Counter((t or "").split())) for i, t in rows]
    n, mean = len(rows), sum(sum(w.values()) for _, w in words) / len(rows)
    df = Counter(t for _, w in words for t in w)
    for q, wanted in [(i, w) for i, w in words if i % 20 == 0]:
        best = []
        for i, w in words:
            size = sum(w.values())
            score = sum(
                times * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * w[t] * 2.2 / (w[t] + 1.2 * (0.25 + 0.75 * size / mean))
                for t, times in wanted.items() if w[t]
            )
            if score:
                best.append((-round(score, 9), i))
        assert [(pytest.approx(s, abs=1e-8), i) for s, i in sorted(best)[:5]] == sorted(got.get(q, []))
    assert search.top_k(table.limit(0), queries, 5).collect() == []


@pytest.mark.parametrize("wide", [1, 4, 10_000])
def test_block_max_wand_reads_no_more_than_pivots(monkeypatch, wide):
    """All splits into wide and narrow lists find what a full scan finds, with a threshold from before, too."""
    monkeypatch.setattr(search, "WIDE", wide)
    rng = np.random.default_rng(3)
    rows = [np.r_[rng.zipf(1.3, int(rng.integers(1, 300))) % 500, np.ones(int(rng.integers(0, 3)), int)] for _ in range(700)]
    rows += [rows[11]] * 30
    lengths = np.array([len(r) for r in rows])
    index = search.Index(lengths, np.concatenate(rows), lengths.mean())
    df = np.bincount(np.concatenate([np.unique(r) for r in rows]), minlength=500)
    for query in (rows[3], rows[11], rows[400], np.array([1]), np.array([499, 10_000])):
        term, times = np.unique(query[query < 500], return_counts=True)
        weight = times * np.log1p((len(rows) - df[term] + 0.5) / (df[term] + 0.5))
        exact = np.zeros(len(rows))
        for t, w in zip(term, weight, strict=True):
            tf = np.array([(r == t).sum() for r in rows])
            exact += w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths / lengths.mean()))
        wanted = np.sort(exact[exact > 0])[::-1]
        found, scores, level = index.best(term, weight, 10)
        assert np.allclose(np.sort(scores)[::-1][:10], wanted[:10]) and np.allclose(scores, exact[found])
        assert {*np.flatnonzero(exact > wanted[min(9, len(wanted) - 1)] + 1e-6)} <= {*found}
        again, _, same = index.best(term, weight, 10, level)
        assert {*again} == {*found} and same == level
        assert len(index.best(term, weight, 10, 2.0**60)[0]) == 0


def test_task_of_many_shards_returns_its_k_best(monkeypatch):
    """Neither the rows that a task returns nor their order follow its shards; copies that tie are cut by id."""
    rng = np.random.default_rng(9)
    rows = [rng.zipf(1.3, int(rng.integers(1, 60))) % 300 for _ in range(400)] + [np.arange(30)] * 200
    ids = pa.array([None, *rng.permutation(5_000)[: len(rows) - 1].tolist()], pa.int64())
    batch = pa.record_batch([ids, pa.array([r.tolist() for r in rows], pa.list_(pa.int64()))], ["id", "terms"])
    weighed = [(q, *np.unique(rows[q], return_counts=True)) for q in (3, 77, 450)]
    names, number = np.unique(np.concatenate([t for _, t, _ in weighed]), return_inverse=True)
    ends = np.r_[0, np.cumsum([len(t) for _, t, _ in weighed])]
    sent = SimpleNamespace(value=(np.array([3, 77, 450]), ends, names, number, np.concatenate([w for *_, w in weighed]).astype(float)))
    got = []
    for shard, block in ((1_000_000, 1_024), (1_000_000, 50), (500, 1_024), (500, 5)):
        monkeypatch.setattr(search, "SHARD_TERMS", shard)
        monkeypatch.setattr(search, "BLOCK_ROWS", block)
        got.append([tuple(r.values()) for b in search._searcher(10, 30.0, sent)(iter([batch])) for r in b.to_pylist()])
    assert all(g == got[0] for g in got) and len(got[0]) == 30
    copies = sorted(x for x in ids.to_pylist()[400:])
    assert [i for q, i, _ in got[0] if q == 450] == copies[:10]


@pytest.mark.parametrize("read", [1, 250, 1 << 30])
def test_a_shard_is_indexed_once_for_all_blocks_of_queries(monkeypatch, read):
    """However many blocks the queries come in, each shard of rows is indexed once; all ways to read wide lists find what a full scan finds."""
    rng = np.random.default_rng(11)
    rows = [rng.zipf(1.3, int(rng.integers(1, 80))) % 300 + 1_000 * int(rng.integers(0, 3)) for _ in range(900)]
    ids = rng.permutation(5_000)[: len(rows)]
    batch = pa.record_batch([pa.array(ids, pa.int64()), pa.array([r.tolist() for r in rows], pa.list_(pa.int64()))], ["id", "terms"])
    lengths, made, index = np.array([len(r) for r in rows]), [], search.Index
    monkeypatch.setattr(search, "Index", lambda *a: made.append(1) or index(*a))
    monkeypatch.setattr(search, "SHARD_TERMS", int(lengths.sum()) // 3 + 100)
    monkeypatch.setattr(search, "BLOCK_ROWS", 50)
    monkeypatch.setattr(search, "READ", read)
    sent, wanted = [], []
    for block in (range(0, 900, 90), range(5, 900, 90), range(0)):
        weighed = [(q, *np.unique(rows[q], return_counts=True)) for q in block]
        names, number = np.unique(np.concatenate([np.empty(0, int), *(t for _, t, _ in weighed)]), return_inverse=True)
        ends = np.cumsum([0, *(len(t) for _, t, _ in weighed)])
        sent.append(SimpleNamespace(value=(np.array([q for q, *_ in weighed], int), ends, names, number, np.concatenate([np.empty(0), *(w for *_, w in weighed)]))))
        for q, term, weight in weighed:
            scores = []
            for i, r in zip(ids.tolist(), rows, strict=True):
                tf = (r == term[:, None]).sum(1)
                if score := float((weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(r) / 30.0))).sum()):
                    scores.append((-round(score, 9), i))
            wanted += [(q, i, pytest.approx(-s, abs=1e-8)) for s, i in sorted(scores)[:10]]
    found = [tuple(r.values()) for b in search._searcher(10, 30.0, *sent)(iter([batch])) for r in b.to_pylist()]
    assert len(made) == 3 and found == wanted


def test_search_of_documents(spark, monkeypatch):
    """All documents are met by every twentieth one; in small shards and blocks, copies tie in the order of their ids."""
    from tabulens.llm.queries import llm_queries

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = llm_queries()["op5_topk_search"](spark, folder).collect()
    ids = {r["doc_id"] for r in docs.collect()}
    assert {r["query_doc_id"] for r in found} == {i for i in ids if i % 20 == 0} and {r["doc_id"] for r in found} <= ids
    monkeypatch.setattr(search, "SHARD_TERMS", 2_000)
    monkeypatch.setattr(search, "QUERY_TERMS", 500)
    assert sorted(found) == sorted(llm_queries()["op5_topk_search"](spark, folder).collect())
    copies = spark.createDataFrame([(i, f"{BASE} {LONG[:9000]}") for i in range(60)] + [(None, BASE), (99, "word1")], "id long, text string")
    got = search.top_k(copies, copies.where("id = 40").withColumnRenamed("id", "query_id"), 10).orderBy("rank").collect()
    assert [r["id"] for r in got] == list(range(10)) and len({r["score"] for r in got}) == 1


def test_warc(spark, tmp_path):
    rows = [(3, "u3", "same\r\n\r\nWARC/1.1\r\n"), (1, None, "same\r\n\r\nWARC/1.1\r\n"), (2, "a\r\nb", None), (4, "u", ""), (5, "u", "ünique"), (5, "u", "ünique"), (None, "u", "ünique"), (6, "u", LONG)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_id string")
    found = sorted(warc.archived(pages).collect(), key=str)
    assert len(found) == len(rows)
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in found} >= {
        (1, "response", None), (3, "revisit", 1), (2, "response", None), (4, "revisit", 2), (6, "response", None), (None, "revisit", 5)
    }
    assert Counter(r["record_type"] for r in found if r["page_id"] == 5) == {"response": 1, "revisit": 1}
    for r in found:
        html = dict((i, h) for i, _, h in rows)[r["page_id"]] or ""
        assert r["payload_bytes"] == len(html.encode())
        assert r["payload_digest"] == __import__("base64").b32encode(hashlib.sha1(html.encode()).digest()).decode()
    assert warc.archived(pages.limit(0)).collect() == []
    raw = warc.read_archives(spark, warc.write_pages(pages, str(tmp_path / "raw"))).collect()
    assert Counter(r["payload"] for r in raw) == Counter(h or "" for _, _, h in rows)
    kept = warc.deduplicate(spark, str(tmp_path / "raw"), str(tmp_path / "kept"))
    records = warc.read_archives(spark, kept).withColumn("original_uri", F.lit(None).cast("string")).withColumn("original_date", F.col("date"))
    nowhere = F.when(F.col("page_key") == "3", "00000000-0000-0000-0000-000000000000").otherwise(F.col("refers_to_record"))
    astray = records.withColumn("original_record", nowhere)
    found = warc.resolved(spark, warc._write(astray, str(tmp_path / "astray"))).collect()
    assert {(r["page_id"], r["refers_to"]) for r in found if r["record_type"] == "revisit"} >= {(3, None), (4, 2), (None, 5)}
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\na\r\n\r\n\r\n"
    assert list(warc.parse_records(io.BytesIO(record * 2)))[1][1] == b"a\r\n"


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    found = packing.packed(docs, path).collect()
    assert packing.packed(empty, path).collect() == []
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
    by_doc = Counter()
    for r in packing.pieces(docs, path).collect():
        if r["doc_id"] in (9, 11):
            by_doc[r["doc_id"]] += r["length"]
            assert r["piece"] == 0 or r["length"] == 1024
            text = next(x["text"] for x in docs.where(f"doc_id = {r['doc_id']}").collect())
            ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
            assert ids[r["start"] : r["start"] + r["length"]].tobytes() == bytes(r["ids"])
    assert len([r for r in found if r["doc_id"] == 4]) == 1


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(2)
    counts = Counter(int(x) for x in rng.integers(1, 1025, 20_000))
    patterns = packing.plan(counts)
    used = Counter()
    for pattern, times in patterns:
        assert sum(pattern) <= 1024
        for x in pattern:
            used[x] += times
    assert used == counts
    assert sum(t for _, t in patterns) <= 1.01 * math.ceil(sum(k * n for k, n in counts.items()) / 1024)


def test_toxicity(spark, empty):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(600):
        words = [f"n{int(x)}" for x in rng.integers(0, 60, 40)]
        bad = i % 3 == 0
        if bad:
            words[5:5] = ["you", f"vile{int(rng.integers(0, 4))}!"]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*rows, (700, None), (701, ""), (None, "vile1")], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.scores(docs, known).collect()}
    held = [r for i, r in found.items() if i is not None and i < 600 and r["held_out"]]
    assert held and np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in held]) > 0.95
    assert len(found) == 603 and all(0 <= r["score"] <= 1 for r in found.values())
    assert {r["score"] for r in toxicity.scores(docs, known.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.scores(empty, known.limit(0)).collect() == []


def test_near_hits_of_long_texts():
    """Hits next to second-person words are counted one by one, however many there are."""
    words = ["you", *["n"] * 20] * 400 + ["n", *["vile"]] * 300 + ["vile", "a", "b", "c", "d", "you", "a", "vile"]
    hits, second = ([i for i, w in enumerate(words) if w == x] for x in ("vile", "you"))
    near = sum(1 for i in hits if any(abs(i - j) <= toxicity.NEAR for j in second))
    found = toxicity.text_features(" ".join(words), {b"vile": 2.0})
    assert len(hits) * len(second) >= 100_000 and 0 < near < 10
    assert found[5:7] == [near / len(words), near / len(hits)]


def test_licenses(docs, empty, spark):
    line = licenses.TEMPLATES["Apache-2.0"]
    rows = [(1, f"the under license {BASE}\n{line}\nmore the"), (2, f"{line}\n{BASE}\n{line}"), (3, BASE), (4, None), (5, "Licensed under the Apache thing")]
    found = {r["doc_id"]: (r["license"], r["coverage"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: ("Apache-2.0", 1.0), 2: ("Apache-2.0", 1.0), 3: (None, None), 4: (None, None), 5: (None, None)}
    assert licenses.scan(docs).count() == 13 and licenses.scan(empty).collect() == []
    pairs = licenses.align("x a b y c d".split(), "a b c z d".split())
    assert pairs == [(1, 0), (2, 1), (4, 2), (5, 4)]


def test_licenses_without_unique_words():
    """Texts that use the words of a license again, with the positions of the whole text."""
    known = {name: licenses.license_words(t) for name, t in licenses.TEMPLATES.items()}
    mit, text = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["MIT-text"]
    found = lambda t: {f[0]: f[1:] for f in licenses.licenses_of(t, known)}
    assert found(f"Foo. {mit}\n{mit}")["MIT"] == (1.0, 5, 1, 5)
    assert found(f"same\nsame\n{mit}")["MIT"] == (1.0, 5, 2, 6)
    assert found(f"{BASE} under the license mit released {BASE} {mit} released mit the license under")["MIT"] == (1.0, 5, 245, 249)
    size = len(known["MIT-text"])
    wrapped = text.replace(" software ", "\nsoftware ")
    assert found(f"a\n{text}\nb\n{wrapped}")["MIT-text"] == (1.0, size, 1, size)
    edited = text.replace("persons", "people").replace("free of charge", "at no charge")
    assert found(f"{edited}\n{edited} more")["MIT-text"][0] >= 0.95
    assert "MIT" not in found("license mit the under released") and "MIT" not in found(f"released under {BASE} the mit license under released")
    for name, template in licenses.TEMPLATES.items():
        assert found(f"{template} {LONG} {template}")[name][0] == 1.0


def test_known_licenses():
    """Published notices are found, whole, with no variant above them."""
    known = {name: licenses.license_words(t) for name, t in licenses.TEMPLATES.items()}
    for name in ("AGPL-3.0-notice", "MPL-2.0-notice", "BSD-2-Clause-text", "CC-BY-SA-4.0-notice", "Unlicense-text", "LGPL-2.1-notice"):
        found = {f[0]: f[1] for f in licenses.licenses_of(f"{BASE}\n{licenses.TEMPLATES[name]}\n{BASE}", known)}
        assert found[name] == 1.0
    for name, line in licenses.LINES.items():
        assert [f[0] for f in licenses.licenses_of(f"{BASE}\n{line}\n{BASE}", known)] == [name]


def test_common_words():
    rng = np.random.default_rng(7)
    for _ in range(300):
        a, b = (list(rng.choice(list("abcd"), rng.integers(0, 12))) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        pairs = licenses._common(a, b)
        assert len(pairs) == table[-1, -1] and all(a[i] == b[j] for i, j in pairs)
        assert all(x < y and t < u for (x, t), (y, u) in zip(pairs, pairs[1:], strict=False))


def test_quality(spark, docs, empty):
    found = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert quality.judge(empty).collect() == [] and len(quality.judge(docs).collect()) == 13
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for i, r in found.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text[i])
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        times = Counter(windows)
        repeated = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
        lines = [x for x in text[i].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text[i])), len(lines) - len(set(lines)), len(repeated))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (len(words) < 10 or 100 * len(repeated) > 20 * len(words))
        assert not (r["kept"] and r["base_failed"])


def test_votes_find_the_bad_group():
    rng = np.random.default_rng(6)
    good = rng.random(5000) < 0.8
    votes = np.where(good[:, None], rng.random((5000, 5)) < 0.97, rng.random((5000, 5)) < 0.3) * 2 - 1
    patterns, where = np.unique(votes, axis=0, return_inverse=True)
    posterior = quality.estimate([tuple(p) for p in patterns], np.bincount(where.ravel()).tolist())
    assert np.mean((posterior[where.ravel()] >= 0.5) == good) > 0.97


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0 and docs.count() > 0
