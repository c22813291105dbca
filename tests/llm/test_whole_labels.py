"""Quality rules learn from every label."""

import numpy as np

from arcweave.llm import gbt, quality


def test_all_labels_are_learned_from(spark, monkeypatch):
    """More labels than the 4,000 that were once taken: each is counted."""
    n = 4600
    docs = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 25 + id % 9), i -> concat(if(id % 5 = 0, 'AB', 'ab'), id * i % 97))) AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 5 <> 0 AS int) AS quality")
    seen, fit = [], gbt.fit
    monkeypatch.setattr(gbt, "fit", lambda x, *a, **k: (seen.append(len(x)), fit(x, *a, **k))[1])
    found = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    held = labels.selectExpr("pmod(xxhash64(doc_id), 4) = 3 AS held").where("held").count()
    assert seen == [n - held] and n - held > 3000
    assert sum(found[i] == (i % 5 != 0) for i in found) > 0.98 * n
    assert {r.doc_id for r in quality.keep(docs, labels).collect()} == {i for i, kept in found.items() if kept}


def test_codes_and_limits():
    x = np.sort(np.abs(np.random.default_rng(1).normal(size=(500, len(quality.FEATURES)))), axis=0)
    assert (np.diff(quality.codes(x).astype(int), axis=0) >= 0).all()
    counts = np.bincount([3] * 10 + [7] * 10 + [9] * 20, minlength=16)
    assert list(quality.limits(counts, 4)) == [3, 7, 9]


def test_bins_give_the_trees_of_values():
    r = np.random.default_rng(2)
    x = r.integers(0, 40, (600, 3)).astype(float)
    y = (x[:, 0] + r.normal(size=600) * 3 > 20).astype(float)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])) for j in range(3)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(3)], axis=1).astype(np.uint8)
    assert np.allclose(gbt.fit(x, y).margin(x), gbt.fit(binned, y, cuts=cuts).margin(x))
