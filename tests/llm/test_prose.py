import os

import numpy as np
import pytest

from crateforge.llm import prose as p
from crateforge.llm.prose_holdout import HOLDOUT, TEST

COMMON = "the a of in and is it to was my i his her for with on at never le la les des une et que el los en y der die das und mit am ist".split()


@pytest.fixture(scope="module")
def common(spark):
    return spark.createDataFrame([("en", w, i) for i, w in enumerate(COMMON)], "lang string, word string, word_rank int")


def test_statistics_of_edges(spark, common):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "the river is old. " * 3000, "x"), (4, "the river is old. " * 3000, "x"), (5, "a|b\n1|2", "x")], "doc_id bigint, text string, n_words string")
    rows = {r.doc_id: r for r in p.document_statistics(docs, common).collect()}
    assert rows[1].blank and rows[2].blank and rows[3].blank and rows[3].n_words == 0
    assert rows[4].stop_share == 0.5 and not rows[4].blank
    out = {r.doc_id: r.is_prose for r in p.judged(docs, common).collect()}
    assert out[1] is None and out[3] is None and out[5] is False
    assert p.judged(docs.limit(0), common).count() == 0


def test_trees_separate_the_holdout():
    c = frozenset(COMMON)
    x, y = np.array([p.statistics(t, c) for t, _ in HOLDOUT]), np.array([lab for _, lab in HOLDOUT], float)
    t = p.Trees().fit(x, y).calibrate(x, y)
    assert (((t.probability(x) > 0.5) == y).mean()) > 0.95


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_held_out_documents_are_told_and_probabilities_are_calibrated(spark):
    words = spark.read.parquet(f"{DATA}/common_words.parquet")
    common = p.common_set(words)
    trees = p.fitted(p.document_statistics(spark.read.parquet(f"{DATA}/documents.parquet"), words), common)
    assert not {t for t, _ in TEST} & {t for t, _ in HOLDOUT}
    prob = trees.probability(np.array([p.statistics(t, common) for t, _ in TEST]))
    y = np.array([lab for _, lab in TEST])
    assert ((prob > 0.5) == y).mean() >= 0.95
    assert p.calibration_error(prob, y) < 0.08


def test_calibration_error():
    assert p.calibration_error([0.0, 1.0], [0, 1]) == 0 and p.calibration_error([0.9, 0.9], [0, 0]) > 0.8 and p.calibration_error([], []) == 0
