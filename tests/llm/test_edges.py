"""Nulls anywhere, empty tables, repeated rows and columns whose names the operators use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxcohort.llm import decontaminate, language_id, license_scan, lm_score, ngram_join, packing, quality_rules, substring_dedup, suffix_dedup, token_file
from voxcohort.llm.common import held_out
from voxcohort.llm.tokens import default_vocabulary
from voxcohort.session import scratch_path

CLASH = ("rid", "rep", "key", "root", "score", "lang_pred", "kept", "part", "h", "n", "sig", "chunk", "_id", "label", "item_id", "held_out", "n_words", "draw", "b", "_n", "_row")


@pytest.fixture(scope="module")
def odd(spark, small):
    """The small table with repeated rows, null ids and columns of clashing names."""
    rows = [(i, t, "en" if i % 2 else None, None, None) for i, t in small[:25] + small[-8:]]
    rows += rows[:5] + [(None, small[3][1], "en", "s", 1), (None, None, None, None, None), (None, "one more text without an id", "de", None, 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    return d.withColumns({c: F.lit(7) for c in CLASH})


def items(spark):
    return spark.createDataFrame([(1, "some item that is nowhere. it is not."), (None, None)], "item_id long, text string")


def run_all(spark, d):
    def files():
        path = scratch_path(spark, "edge")
        token_file.write_tokens(d, path, default_vocabulary())
        return token_file.read_tokens(spark, path)

    none = spark.createDataFrame([], "doc_id long")
    return {
        "ngram_join": ngram_join.join(d),
        "language_id": language_id.learn_and_predict(d, ~held_out("doc_id", 5)),
        "substring_dedup": substring_dedup.remove(d),
        "suffix_dedup": suffix_dedup.remove(d),
        "lm_score": lm_score.score(d, held_out("doc_id", 10)),
        "quality_rules": quality_rules.judge(d, none),
        "token_file": files(),
        "packing": packing.pack(d),
        "license_scan": license_scan.scan(d),
    }


def test_every_row_is_answered(spark, odd):
    n = odd.count()
    for name, out in run_all(spark, odd).items():
        rows = out.collect()
        assert (len(rows) if name != "packing" else len({(r["doc_id"], r["sequence_id"], r["offset"]) for r in rows if r["piece"] == 0})) == n, name
        assert sum(r["doc_id"] is None for r in rows) >= 3, name
    assert decontaminate.remove(odd, items(spark)).count() == n
    assert decontaminate.find(odd, items(spark)).count() == 0


def test_empty_table(spark, odd):
    for name, out in run_all(spark, odd.limit(0)).items():
        assert out.collect() == [], name
    assert decontaminate.find(odd, items(spark).limit(0)).count() == 0
    assert decontaminate.remove(odd.limit(0), items(spark)).count() == 0


def test_stages_on_odd_rows(spark, odd, tmp_path):
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    d, columns = odd, odd.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        if name != "packing":
            assert out.columns == columns and out.dtypes == odd.dtypes, name
        out.write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
    assert d.count() > 0
    kept = spark.read.parquet(f"{tmp_path}/ngram_join")
    assert kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count() == 0
    assert kept.where("text is null").count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), str(tmp_path)).collect() == [], name


def test_language_stage_without_labels(spark, small):
    """The rows that stay do not depend on whether there is a label to learn from."""
    d = spark.createDataFrame([(i, t, "en") for i, t in [*small, (900, "ы"), (901, "12 ½ 3")]], "doc_id long, text string, lang string").repartition(3)
    kept = lambda x: sorted(tuple(r)[:2] for r in corpus_pipeline.language(spark, x, "").collect())
    want = kept(d)
    assert 0 < len(want) < d.count()
    assert kept(d.withColumn("lang", F.lit(None).cast("string"))) == want
    assert kept(d.withColumn("lang", F.when(F.col("doc_id") == 1, "en"))) == want  # a label on a text without trigrams


def test_long_text_is_taken_whole(spark):
    text = "alpha beta gamma delta " * 250_000 + "under the mit license"
    d = spark.createDataFrame([(1, text, "en"), (2, "short one", "en")], "doc_id long, text string, lang string")
    assert license_scan.scan(d).where("doc_id = 1").first()["first_word"] == 1_000_000
    assert ngram_join.join(d).where("doc_id = 1").first()["n_shingles"] == 8
    assert substring_dedup.remove(d).where("doc_id = 1").first()["n_words"] == 1_000_004
    assert suffix_dedup.remove(d).where("doc_id = 1").first()["n_removed"] > 5_000_000
    assert lm_score.score(d, F.lit(False)).where("doc_id = 1").first()["n_tokens"] == 1_000_005
