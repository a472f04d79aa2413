"""op4's probing: what is looked at, what is found, and what products in single precision may not lose."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from tessera.llm import mih


def frame(x, first=0):
    return pd.DataFrame({"vec_id": np.arange(first, first + len(x)), "embedding": list(x)})


def test_probing_looks_at_few_rows_and_finds_the_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((20000, 32)).astype(np.float32).astype(float)
    fine = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    codes = mih.fitted(replace(mih.learn(x[::10], 256), width=8), fine, fine.where("vec_id % 20 = 0"), 10, 0.98)
    asked = np.arange(0, 20000, 400)
    assert mih.looked_at(codes, x[asked], x) < 0.6
    compared, compare = [], mih.Best.compare
    monkeypatch.setattr(mih.Best, "compare", lambda self, mine, asks, rows, numbers, own=False: (compared.append(len(asks) * len(numbers)), compare(self, mine, asks, rows, numbers, own))[1])
    found = mih.search(frame(x).iloc[asked], frame(x), codes, 10)
    assert sum(compared) < 0.6 * len(asked) * len(x)
    inner = x[asked] @ x.T
    inner[np.arange(len(asked)), asked] = -np.inf
    hits = sum(len(set(np.argsort(-inner[n])[:10]) & set(found[found.query_id == q].vec_id)) for n, q in enumerate(asked))
    assert hits >= 0.95 * 10 * len(asked)
    assert (found.score == [mih.exact_product(x[a].tolist(), x[b].tolist()) for a, b in zip(found.query_id, found.vec_id, strict=True)]).all()


@pytest.mark.parametrize("scale", [1.0, 1e13])
def test_rows_that_single_precision_cannot_tell_apart(scale):
    rng = np.random.default_rng(9)
    base = rng.standard_normal(16)
    x = np.concatenate([base + 1e-9 * rng.standard_normal((300, 16)), rng.standard_normal((300, 16)) * 10.0 ** rng.integers(-3, 4, (300, 1)), -base[None], np.zeros((1, 16)) + 1e-200]) * scale
    codes = replace(mih.learn(x[:600], 64), width=4)  # every value is probed
    found = mih.search(frame(x).iloc[::20], frame(x), codes, 15)
    for q, g in found.groupby("query_id"):
        want = sorted((-mih.exact_product(x[q].tolist(), v.tolist()), k) for k, v in enumerate(x) if k != q)[:15]
        assert list(zip(-g.score, g.vec_id, strict=True)) == want


def test_sums_are_rounded_once():
    rng = np.random.default_rng(10)
    a, b = rng.standard_normal((2, 3000, 24)) * 10.0 ** rng.integers(-8, 9, (2, 3000, 24))
    b[:1000, -1] = -(a[:1000, :-1] * b[:1000, :-1]).sum(1) / a[:1000, -1]  # nearly nothing is left
    a[1000:1100, 1:] = b[1000:1100, 1:] = 2.0**-27
    a[1000:1100, 0] = b[1000:1100, 0] = 1.0
    assert (mih.exact_products(a, b) == [mih.exact_product(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]).all()
