"""The pipeline's first stages, and the language model's training and document scores, against slow versions."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import common, crf, quality

DATA = "/root/testdata/sf0.001"


def test_quality_stage_is_the_sql_verdict(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = sorted(r[0] for r in con.sql(f"select doc_id from ({quality.oracle_sql()}) where kept").fetchall())
    docs = common.table(spark, DATA, "documents")
    kept = corpus_pipeline.quality_rules(spark, docs, DATA)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == want


def slow_posterior(model: crf.Model, words: list[str]) -> np.ndarray:
    """Marginals from all paths' messages, word by word, in logarithms."""
    scores, n = model.scores(words), len(words)
    labels = len(model.labels)
    add = lambda x: np.logaddexp.reduce(x, axis=0)
    forward, backward = np.zeros((n, labels)), np.zeros((n, labels))
    before = np.zeros(labels)  # the blocked version starts every chain from equal weights, moved once
    for t in range(n):
        forward[t] = add(before[:, None] + model.moves) + scores[t]
        before = forward[t]
    for t in range(n - 2, -1, -1):
        backward[t] = add((model.moves + scores[t + 1] + backward[t + 1]).T)
    both = forward + backward
    return np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None])


def test_language_stage_and_scores_match_slow_marginals(spark):
    docs = common.table(spark, DATA, "documents").limit(60)
    docs = common.materialise(docs, "some")
    model = crf.train(docs.where(~common.in_fold(docs.doc_id, 4, 2)), 30)
    want = {}
    for r in docs.collect():
        words = common.letter_words(r.text)
        if not words:
            want[r.doc_id] = ("und", 0.0)
            continue
        mass = slow_posterior(model, words).mean(0)
        want[r.doc_id] = (model.labels[int(mass.argmax())], min(1.0, float(mass.max())))
    got = {r.doc_id: (r.lang_pred, r.score) for r in crf.languages(docs, per_language=30).collect()}
    assert set(got) == set(want)
    for k, (lang, score) in want.items():
        assert got[k][0] == lang and got[k][1] == pytest.approx(score, abs=1e-4)
    kept = {r.doc_id for r in crf.language_filter(docs, per_language=30).collect()}
    assert kept == {k for k, (lang, score) in want.items() if lang != "und" and score >= crf.LEAST_SHARE}


def test_gradients_are_those_of_the_likelihood():
    rng = np.random.default_rng(3)
    scores, moves = rng.standard_normal((2, 4, 3)), rng.standard_normal((3, 3))
    gold, mask = rng.integers(0, 3, (2, 4)), np.array([[1, 1, 1, 1], [1, 1, 1, 0]], bool)

    def loss(s: np.ndarray, m: np.ndarray) -> float:
        total = 0.0
        for row in range(2):
            n = int(mask[row].sum())
            alpha = s[row, 0] + np.logaddexp.reduce(m, axis=0)  # from equal weights before the first word
            path = s[row, 0, gold[row, 0]] + np.logaddexp.reduce(m[:, gold[row, 0]])
            for t in range(1, n):
                alpha = np.logaddexp.reduce(alpha[:, None] + m, axis=0) + s[row, t]
                path += m[gold[row, t - 1], gold[row, t]] + s[row, t, gold[row, t]]
            total += np.logaddexp.reduce(alpha) - path
        return total

    word, move = crf._gradients(scores, gold, mask, moves)
    step = 1e-5
    for at in np.ndindex(scores.shape):
        moved = [scores.copy(), scores.copy()]
        moved[0][at] += step
        moved[1][at] -= step
        assert word[at] == pytest.approx((loss(moved[0], moves) - loss(moved[1], moves)) / (2 * step), abs=1e-4)
    assert abs(move.sum()) < 1e-9  # expected and observed moves are equally many
