"""Joins, searches, the piece codec and the pipeline against brute force."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from adpace.llm import block_search, common, jaccard_join, piece_codec, registry
from tests.llm.data import documents, folder, texts
from tests.oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", registry.statements())
def test_against_sql(spark, name):
    assert differences(connect(SF_DIR), registry.statements()[name], registry.queries()[name](spark, SF_DIR)) is None


# --- Jaccard join ---------------------------------------------------------------------


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def brute_components(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, (doc_id, _) in zip(group, rows):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    return Counter((i, len(s), least.get(g)) for g, s, (i, _) in zip(group, sets, rows))


def near_copies():
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 900)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**9)}"
        rows.append((500 + i, " ".join(words)))
    return rows


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_components(spark, monkeypatch, width, percent):
    monkeypatch.setattr(jaccard_join, "BLOCK", 40)
    rows = texts() + near_copies()
    got = jaccard_join.jaccard_components(documents(spark, rows), width, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, width, percent)


@pytest.mark.parametrize("large", [48, 4, 1 << 30])
def test_every_link_once(spark, monkeypatch, large):
    monkeypatch.setattr(jaccard_join, "BLOCK", 40)
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    rows = texts() + near_copies() + [(900, near_copies()[0][1])]
    docs = documents(spark, rows)
    sets = {frozenset(shingles(t, 4)) for _, t in rows} - {frozenset()}
    want = Counter()
    overlap = Counter()
    for x in sets:
        for y in sets:
            if x != y and 100 * len(x & y) >= 85 * len(x | y):
                want[x] += 1
                overlap[len(x & y)] += 1
    assert max(want.values()) > 2
    links, members = jaccard_join.jaccard_links(docs)
    found = links.collect()
    assert len({(r.a, r.b) for r in found}) == len(found) == sum(want.values()) // 2
    assert Counter(r.overlap for r in found) == Counter({k: v // 2 for k, v in overlap.items()})
    counts = jaccard_join.jaccard_link_counts(docs).collect()
    assert Counter((r.doc_id, r.n_links) for r in counts) == Counter((i, want[frozenset(shingles(t, 4))]) for i, t in rows)
    assert Counter((r.doc_id, r["class"] and r["class"].hex()) for r in members.collect()) == Counter((r.doc_id, r["class"]) for r in counts)


def test_one_of_each_component_stays(spark):
    docs = documents(spark, texts())
    out = jaccard_join.keep_one(docs, 5, 80)
    assert out.schema == docs.schema
    want = Counter(i for i, n, c in brute_components(texts(), 5, 80).elements() if i is not None and i == c)
    got = Counter(r.doc_id for r in out.collect())
    assert {i for i in got if i is not None} == set(want) and all(n == 1 for i, n in got.items() if i is not None)
    assert got[None] == 2
    assert jaccard_join.keep_one(documents(spark, []), 5, 80).count() == 0


def test_trie_and_walk_find_the_same_links():
    rng = random.Random(2)
    for _ in range(80):
        percent = rng.choice([80, 85, 60])
        base = rng.sample(range(1, 400), rng.choice([6, 20, 60]))
        sets = {tuple(sorted((set(base) - set(rng.sample(base, rng.randint(0, 3)))) | set(rng.sample(range(400, 500), rng.randint(0, 4))))) for _ in range(20)}
        members = [np.array(s, dtype=np.uint64) for s in sorted(sets)]
        names = [str(i).encode() for i in range(len(members))]
        trie = jaccard_join.Trie(names, members)
        for probe in members:
            want = {n for n, m in zip(names, members) if 100 * len(np.intersect1d(probe, m)) >= percent * len(np.union1d(probe, m))}
            assert set(trie.linked_with(probe, percent)) == want
            assert {n for n, _ in jaccard_join.overlaps(probe, zip(names, members), percent)} == want


# --- block search -----------------------------------------------------------------------


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(block_search, "STRIP", 7)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)], 0) for i in range(150)]
    rows += [(200 + i, rows[5][1], 0) for i in range(30)] + [rows[20], (20, rows[20][1], 9)]
    rows += [(300, None, 0), (320, [0.0] * 8, 0), (340, [None] + [1.0] * 7, 0), (None, rows[0][1], 0), (360, [float("nan")] * 8, 0)]
    rows += [(380, [float("inf")] * 8, 0), (400, [1.0, 2.0], 0), (401, [3.0, 1.0], 0), (420, [], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS block", "2 AS score").repartition(3)
    found = block_search.nearest(table, F.col("vec_id") % 20 == 0, k=6, query_block=5, candidate_block=40).collect()
    vectors = {i: np.array(v, dtype=np.float32).astype(float) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    want = set()
    for q in (i for i in vectors if i % 20 == 0):
        scores = []
        for c, v in vectors.items():
            if c != q and len(v) == len(vectors[q]):
                total = 0.0
                for x, y in zip(vectors[q], v):
                    total += x * y
                scores.append((-total, c))
        want |= {(q, rank, c, -s) for rank, (s, c) in enumerate(sorted(scores)[:6], 1)}
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert block_search.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# --- piece codec ------------------------------------------------------------------------

needs_model = pytest.mark.skipif(not os.path.exists(piece_codec.MODEL_PATH), reason="no vocabulary file")


def full_search(text, v):
    text = piece_codec.MARK + text.replace(" ", piece_codec.MARK)
    best = [(0.0, -1)] + [None] * len(text)
    for at in range(len(text)):
        for end in range(at + 1, min(len(text), at + v.longest) + 1):
            score = v.scores.get(text[at:end], v.worst if end == at + 1 else None)
            if score is not None and (best[end] is None or best[at][0] + score > best[end][0]):
                best[end] = (best[at][0] + score, at)
    pieces, end = [], len(text)
    while end:
        pieces.append(text[best[end][1] : end])
        end = best[end][1]
    return [i for p in reversed(pieces) for i in ([v.ids[p]] if p in v.ids else [v.bytes_[b] for b in p.encode()])]


@needs_model
def test_codec():
    v = piece_codec.load()
    encoder = piece_codec.Encoder(v, memory=50)
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a", "the", " ", "  ", "▁", "\n", "é", "日", "🙂", "xx", "ing", "\x00"]) for _ in range(rng.randint(0, 90)))
        ids = encoder.encode(text)
        assert piece_codec.decode(ids, v) == text
        if text and piece_codec.MARK not in text:
            assert ids == full_search(text, v)
    texts_ = ["".join(rng.choice(["ab", "the", " ", "▁", "é", "日🙂", "ing"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    together = piece_codec.Encoder(v, memory=40).encode_all(texts_)
    assert [piece_codec.unpacked_ids(x) for x in together] == [encoder.encode(t) for t in texts_]
    long = "".join(rng.choice("abcdefghij") for _ in range(3000))
    parts = list(encoder.commits(piece_codec.MARK + long))
    assert [i for p in parts for i in p] == full_search(long, v) and len(parts) > 30


@needs_model
def test_codec_round_trip_of_documents(spark):
    out = piece_codec.decode_ids(piece_codec.encode_documents(documents(spark))).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((i, t or "") for i, t in texts())


# --- pipeline -----------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    rows = [(i, t) for i, t in texts() if i is not None]
    labels = spark.createDataFrame([(i, int(i != 43), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    sf_dir = folder(spark, tmp_path, documents=documents(spark, rows), labels=labels)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = out
    ids = {r.doc_id for r in docs.collect()}
    assert 43 not in ids and 1 not in ids and {30, 36, 7} <= ids and len(ids & {10, 11, 12, 13}) == 1
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.collect()} == ids


def test_shingle_tasks_take_a_batch_in_parts(spark, monkeypatch):
    """A batch is bounded in rows only, so its sets and paths must not all be in memory at once."""
    monkeypatch.setattr(common, "PART", 1 << 12)
    asked = []
    sets = jaccard_join.Shingler.sets
    monkeypatch.setattr(jaccard_join.Shingler, "sets", lambda self, texts: asked.append(sum(map(len, texts))) or sets(self, texts))

    class Local:
        """A table whose task runs here, on one batch."""

        sparkSession = spark

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            rows = near_copies()
            batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
            return pa.Table.from_batches(run(iter([batch])))

    full = np.full(jaccard_join.TABLE_BITS // 8, 255, np.uint8)
    rows = jaccard_join.indexed(Local(), 5, 80, (full, np.zeros_like(full)))
    assert rows.column("doc_id").to_pylist() == [i for i, _ in near_copies()]
    assert jaccard_join.low_shingles(Local(), 5, 80).num_rows > 0
    assert len(asked) > 20 and max(asked) <= 1 << 12


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_components_when_the_bit_tables_are_full(spark, monkeypatch, width, percent):
    monkeypatch.setattr(jaccard_join, "BLOCK", 40)
    monkeypatch.setattr(jaccard_join, "DENSE", -1)
    rows = texts() + near_copies()
    got = jaccard_join.jaccard_components(documents(spark, rows), width, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, width, percent)


def test_full_bit_tables_let_no_other_sets_into_the_index(spark, monkeypatch, tmp_path):
    """Sets that share nothing stay out, however many shingles the corpus shares, and so do copies of them."""
    monkeypatch.setattr(jaccard_join, "TABLE_BITS", 1 << 15)
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randint(0, 10**12)}" for _ in range(n))
    long = text(60_000)
    alone = [text(400) for _ in range(40)]
    rows = list(enumerate([long, f"{long} end", *alone, *alone]))
    docs = documents(spark, rows)
    tables = jaccard_join.bit_tables(docs, 5, 80)
    assert np.unpackbits(tables[0]).mean() > 0.3
    members, sets = jaccard_join.indexed_sets(docs, 5, 80, f"{tmp_path}/join")
    assert sorted(r.n for r in sets.collect()) == [59_996, 59_997]
    assert sorted(r.doc_id for r in members.collect()) == list(range(82))
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, 5, 80).collect()}
    assert got == {0: 0, 1: 0} | {i: 2 + (i - 2) % 40 for i in range(2, 82)}
