"""Quality learns from every labelled row."""

import numpy as np
import pytest

from deltaspan.llm import quality


def test_all_labelled_rows_are_learnt_from(spark, monkeypatch):
    monkeypatch.setattr(quality, "MIN_PAIRS", 100)
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["ab", "cde", "f!", "| g"], int(rng.integers(1, 60)), p=[0.4, 0.4, 0.1, 0.1] if i % 3 else [0.1, 0.1, 0.4, 0.4])) for i in range(6_300)]
    rows = [(i, t, int(i % 3 > 0)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    given = quality.labelled(docs, labels, "quality", lambda c: c >= 0)
    # More rows than the 6,000 that a sample once held.
    assert given.count() == 6_300
    pairs = quality.paired(given, {0: 2_100, 1: 4_200}).collect()
    raw = {i: np.array(quality.features(t)).tobytes() for i, t, _ in rows}
    assert {bytes(r.good_) for r in pairs} == {raw[i] for i, _, y in rows if y} and {bytes(r.bad_) for r in pairs} == {raw[i] for i, _, y in rows if not y}
    model = quality.fit_rows(given)
    x = np.array([quality.features(t) for t in texts])
    y = np.array([v for _, _, v in rows])
    assert model.mean == pytest.approx(x.mean(0)) and model.std == pytest.approx(x.std(0) + 1e-6)
    score = model.scores(x)
    assert model.threshold == pytest.approx(min(np.quantile(score, 1 / 3, method="midpoint"), np.quantile(score[y == 1], 0.01, method="lower")))
    assert (model.slope, model.offset) == pytest.approx(quality.platt(quality.expand(x, model.mean, model.std) @ model.weights, y), rel=1e-4)
    assert quality.fit_rows(given.limit(0)).scores(np.zeros((1, quality.N_RAW)))[0] == pytest.approx(0.5)
