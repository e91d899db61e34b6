import itertools
import zlib

import numpy as np
import pytest

from chaintally.llm import common, crf_quality as crf, queries
from conftest import TESTDATA
from llm_cases import AWKWARD, awkward, table


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    starts = np.array([0, 3, 3, 8, 9])
    field = crf.Field(rng.normal(size=3 * crf.OWN + 1), rng.normal(size=(2, 2)))
    own = rng.normal(size=(9, crf.OWN))
    odds = crf.neighbours(own, starts) @ field.weights
    found = field.marginals(own, starts)
    for a, b in zip(starts[:-1], starts[1:]):
        total, good = 0.0, np.zeros(b - a)
        for labels in itertools.product((0, 1), repeat=b - a):
            weight = np.exp(sum(odds[a + i] * y for i, y in enumerate(labels)) + sum(field.move[x, y] for x, y in zip(labels, labels[1:])))
            total += weight
            good += weight * np.array(labels)
        if b > a:
            assert np.allclose(found[a:b], good / total)


def test_neighbours_stay_in_their_document():
    x = crf.neighbours(np.arange(4.0)[:, None] * np.ones((1, crf.OWN)) + 1, np.array([0, 2, 2, 4]))
    assert x[:, crf.OWN].tolist() == [0, 1, 0, 3] and x[:, 2 * crf.OWN].tolist() == [2, 0, 4, 0]


def test_features_of_slices_equal_whole(monkeypatch):
    kinds, text = crf.character_classes(), "ab CD!\n\n## x 12\n" * 50 + "end"
    whole = crf.features(text, kinds)
    monkeypatch.setattr(crf, "TOGETHER", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, crf.features(text, kinds)))


def test_held_out_documents_are_told_apart(spark):
    root = f"{TESTDATA}/sf0.01"
    rows = queries.op1_quality(spark, root).join(spark.read.parquet(f"{root}/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    assert min(r["score"] for r in rows) >= 0 and max(r["score"] for r in rows) <= 1


@pytest.mark.parametrize("labels", [[], [(1, 1), (9, 0), (None, 1), (14, 0), (14, 1), (8, None), (13, 7)]])
def test_awkward_rows(spark, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    docs = awkward(spark)
    found = crf.score(docs, known)
    assert found.columns == docs.columns and found.count() == len(AWKWARD)
    scores = {r["doc_id"]: r["score"] for r in found.filter("doc_id IS NOT NULL").collect()}
    assert scores[2] == scores[3] == scores[4] == 0 and all(0 <= s <= 1 for s in scores.values())
    assert scores[5] == scores[6] == scores[7]
    kept = crf.keep_good(docs, known)
    assert kept.columns == docs.columns and kept.filter("text IS NULL OR doc_id = 3").count() == 0
    if not labels:
        assert scores[1] == 1


def test_empty_table(spark):
    known = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert table(crf.digest(awkward(spark, []), known)) == []


def test_labels_of_held_out_documents_are_not_learned(spark):
    root = f"{TESTDATA}/sf0.001"
    docs, known = (spark.read.parquet(f"{root}/{n}.parquet") for n in ("documents", "labels"))
    turned = known.withColumn("quality", crf.F.when(crf.held_out("doc_id"), 1 - crf.F.col("quality")).otherwise(crf.F.col("quality")))
    assert table(crf.digest(docs, known)) == table(crf.digest(docs, turned))


def test_texts_reach_python_in_short_batches_and_the_setting_is_put_back(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    monkeypatch.setattr(crf, "stored", lambda df, name="t", stored=crf.stored: seen.append((name, spark.conf.get(key, None))) or stored(df, name))
    before, known = spark.conf.get(key, None), spark.createDataFrame([(1, 1), (9, 0)], "doc_id long, quality int")
    crf.digest(awkward(spark), known)
    crf.keep_good(awkward(spark), known)
    assert spark.conf.get(key, None) == before
    assert seen == [("quality-scores", str(common.TEXTS)), ("quality-kept", str(common.TEXTS))]


def test_lines_are_counted_in_labelled_texts_only(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "good\n" * i) for i in range(1, 9)] + [(3, "a"), (4, None)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(1, 7)], "doc_id long, quality int")
    counted = spark.sparkContext.accumulator(0)
    find = crf.F.udf(lambda text: counted.add(1) or (text or "").count("\n"), "int")
    monkeypatch.setattr(crf.F, "regexp_count", lambda text, _: find(text))
    labelled = [i for i in range(1, 7) if zlib.crc32(str(i).encode()) % crf.FOLDS != crf.HELD_OUT]
    found = crf.sample(docs, known, most_lines=5)
    assert [(len(own), label) for own, label in found] == [(1 if i == 3 else i, i % 2) for i in labelled if i < 5]
    assert counted.value <= sum(i in labelled for i in [*range(1, 9), 3, 4])
