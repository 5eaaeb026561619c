"""LM scoring against a brute-force scorer of the same model, and its base against plain counts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from adpace.llm import lm_scoring as lm
from tests.llm.data import documents, texts


def words(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [w for w in lower.encode().split() if w] + [b"\n"]


def spark_hash(token: bytes) -> int:
    return np.int64(np.uint64(xxhash.xxh64_intdigest(token, seed=42)))


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


@pytest.fixture(scope="module", params=[1 << 16, 7])
def scored(spark, request):
    saved, lm.FREQUENT = lm.FREQUENT, request.param  # a few frequent tokens, so that both ways are taken
    rows = texts() + [(70, "the cat sat on the mat " * 30), (71, "The Cat sat on the mat " * 20), (72, "unseen words here")]
    docs = documents(spark, rows)
    model = lm.fit(docs, epochs=1)
    found = {(r.doc_id, r.n_tokens): r for r in lm.score(docs, model).collect()}
    lm.FREQUENT = saved
    return rows, model, found


def test_base_against_counts(scored):
    rows, model, found = scored
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    assert model.train_tokens == n and model.distinct == v
    assert len(found) == len({(i, len(words(t))) for i, t in rows})
    for i, t in rows:
        tok = words(t)
        r = found[(i, len(tok))]
        assert r.held_out == held(i)
        assert r.n_known == sum(counts[w] > 0 for w in tok)
        assert r.train_tokens == n
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)


def test_score_against_brute_force(scored):
    rows, model, found = scored
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    per_class = Counter()
    distinct = Counter()
    for w, c in counts.items():
        k = int(np.uint64(spark_hash(w)) % np.uint64(lm.CLASSES))
        per_class[k] += c
        distinct[k] += 1
    assert [tuple(x) for x in model.classes] == [(per_class[k], distinct[k]) for k in range(lm.CLASSES)]
    weights, bias = model.weights.astype(np.float64), model.bias.astype(np.float64)
    for i, t in rows[:40]:
        tok = words(t)
        hashes = np.array([spark_hash(w) for w in tok], dtype=np.int64)
        starts = np.zeros(len(tok), dtype=bool)
        starts[0] = True
        feats, classes = lm.features(hashes, starts)
        total = 0.0
        for w, f, k in zip(tok, feats, classes):
            logits = bias + weights[f[0]] + weights[f[1]] + weights[f[2]]
            p = math.exp(logits[k]) / np.exp(logits).sum()
            q = (counts[w] + 0.1) / (per_class[k] + 0.1 * (distinct[k] + 1))
            total += math.log10(p) + math.log10(q)
        assert found[(i, len(tok))].score == pytest.approx(total, rel=1e-5, abs=1e-4)


def test_model_beats_base_on_its_training_text(scored):
    rows, model, found = scored
    train = [r for r in found.values() if not r.held_out]
    assert sum(r.score for r in train) > sum(r.base_score for r in train)


def test_empty_table(spark):
    empty = documents(spark, []).limit(0)
    model = lm.fit(empty, epochs=1)
    assert model.train_tokens == 0 and lm.score(empty, model).count() == 0


def test_features_by_slices_equal_features_of_the_whole_batch():
    rng = np.random.default_rng(4)
    hashes = rng.integers(-(2**63), 2**63 - 1, size=20_000, dtype=np.int64)
    starts = rng.random(20_000) < 0.001
    starts[0] = True
    rows, classes = lm.features(hashes, starts)
    for part in lm._pieces(len(hashes), 777):
        r, c = lm._piece_features(hashes, starts, part)
        assert (r == rows[part]).all() and (c == classes[part]).all()


def test_only_the_hashes_of_rare_tokens_leave_the_scoring_tasks(spark, monkeypatch):
    """Texts become hashes once; what meets counts by a join is the hashes a task cannot look up."""
    monkeypatch.setattr(lm, "FREQUENT", 3)
    rows = lm.tokenised(documents(spark, texts()))
    model = lm.fit_tokens(rows)
    frequent = set(model.frequent[0].tolist())
    assert len(frequent) == 3
    want = Counter((i, tuple(h for w in words(t) if (h := int(spark_hash(w))) not in frequent)) for i, t in texts())
    assert Counter((r.doc_id, tuple(r.rare)) for r in lm.class_scores(rows, model).collect()) == want
