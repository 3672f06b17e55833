from __future__ import annotations

import numpy as np

from logsift.llm import quality, queries

SF_DIR = "/root/testdata/sf0.01"


def test_sizes_are_those_of_the_chunks():
    sizes = quality.Sizes(b"", b"")
    whole, least, most, ratio, log = sizes.features(b"abc " * 1000)
    assert whole == least == most == 0 and 0 < ratio < 0.2 and log == np.log(4000)
    assert sizes.features(None) == sizes.features(b"") == (0.0,) * 5


def test_dictionary_of_few_samples_is_the_samples():
    assert quality._dictionary([b"few words"]) == b"few words"
    assert quality._dictionary([]) == b""


def test_calibration_recovers_probabilities():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(4000) < p).astype(float)
    model = quality.Model(b"", b"", *quality._calibrate(x, y, np.ones(4000)))
    assert np.abs(model.scores(x) - p).mean() < 0.05


def test_odd_rows_and_no_labels(spark, documents, odd_rows):
    docs = documents(odd_rows)
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        model = quality.fit(docs, given)
        scores = [r.s for r in docs.select(quality.score(docs.text, model).alias("s")).collect()]
        assert len(scores) == len(odd_rows) and all(0 <= s <= 1 for s in scores)


def test_held_out_accuracy(spark):
    found = queries.text_quality(spark, SF_DIR)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality is not null")
    rows = found.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert found.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
