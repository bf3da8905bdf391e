"""Long runs of repeated windows, and license labels, against brute force."""

import random

import pytest

from voxcohort.llm import license_scan, substring_dedup
from voxcohort.llm.license_scan import PHRASES, TEMPLATES

from . import brute


@pytest.mark.parametrize("most", [2, 3, 20, 1 << 24])
def test_runs_of_any_length(spark, docs, small, most):
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.remove(docs, most=most).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert got == brute.window_dedup(small) and any(n > 100 for _, n, _ in got.values())


def test_labels_and_scores(spark):
    r = random.Random(8)
    rows = ["licensed under the gnu under the gnu under the gnu general", None, "", "nothing here", "Apache License, Version 2.0 by CC-BY-NC"]
    for label, t in TEMPLATES:
        w = t.split()
        rows += [t, t.upper() + " and more " + t, " ".join(w[: len(w) * 3 // 4]), " ".join(w[len(w) // 2 :]), " ".join(w[:6] + w[3:])]
        odd = list(w)
        for _ in range(1 + len(w) // 15):
            odd.insert(r.randrange(len(odd)), "odd")
        rows += [" ".join(odd), " ".join(x for x in w if r.random() > 0.1), " ".join(f"{x} pad pad" if i % 4 == 3 else x for i, x in enumerate(w))]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.labels, x.score) for x in license_scan.scan(d).collect()}
    want = {i: brute.license_labels(t, TEMPLATES, PHRASES) for i, t in enumerate(rows)}
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1]) for i in got) and got[0][0] == "" and len({x for x, _ in got.values()}) > 10
