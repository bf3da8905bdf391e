"""What operators leave behind, and how many jobs and tasks small tables take."""

import random
from pathlib import Path

import numpy as np
import pytest

from voxcohort.llm import components, ngram_join, sketch
from voxcohort.session import shared_folder


@pytest.fixture
def wide(spark):
    """Many shuffle partitions, none of them put together."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_near_duplicates_leave_no_tables(spark, docs):
    tables = lambda: set(Path(shared_folder(spark)).rglob("*.parquet"))
    before = tables()
    rows = ngram_join.join(docs)
    kept = ngram_join.first_of_each(docs)
    assert rows.count() == docs.count() > kept.count() > 0
    assert tables() == before


def test_sketch_is_fetched_in_few_jobs(wide):
    """As many jobs as what is fetched has parts, not one for each shuffle partition."""
    h = np.arange(1, 5001, dtype=np.uint64)
    wide.sparkContext.setJobGroup("sketch", "sketch")
    got = sketch.merged(wide.range(4).repartition(4), lambda b: iter([h] * b.num_rows), 16)
    jobs = wide.sparkContext.statusTracker().getJobIdsForGroup("sketch")
    wide.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got(h).all()
    assert len(jobs) <= 8


def _least(links):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up if top(x) != x}


@pytest.mark.parametrize("per_part", [20_000, 60])
def test_components_in_partitions_of_links(wide, monkeypatch, per_part):
    """Equal to union by hand, however many links a partition holds; few links take few partitions."""
    monkeypatch.setattr(components, "LINKS", per_part)
    r = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(90)]
    got = components.components(wide.createDataFrame(links, "a long, b long").repartition(7))
    assert {x["node"]: x["root"] for x in got.collect()} == _least(links)
    assert got.rdd.getNumPartitions() <= 1 + len(links) // per_part
    none = components.components(wide.createDataFrame([(1, 1)], "a long, b long"))
    assert none.collect() == []
