import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import licenses, toxicity

CALM = "the weather today is mild and the garden looks green near the river".split()


def sentences(n, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = list(rng.choice(CALM, 12))
        toxic = i % 4 == 0
        if toxic:
            words.insert(int(rng.integers(12)), str(rng.choice(["grublish", "snarfing", "snarfed"])))
        if i % 4 in (0, 1):  # a group named in toxic texts and, less often, in calm ones
            words.insert(3, "muslim" if toxic or i % 12 == 1 else "christian")
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = sentences(800)
    docs = [(i, t, "en") for i, t, _ in rows] + [(5000, None, "en"), (5001, "", "en"), (None, "mild", "en"), (5002, "garden " * 40_000, "en")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame([(i, y) for i, _, y in rows] + [(77, None), (None, 1)], "doc_id long, toxic int"), rows


def test_toxicity(spark, tables):
    docs, labels, rows = tables
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(rows) + 4
    for i, _, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == y
    assert got[5000].predicted == got[5001].predicted == got[5002].predicted == 0 and got[None].held_out is False


def test_group_names_do_not_raise_scores():
    rows = sentences(800)

    def model(weight):
        raw = [np.frombuffer(t.encode(), np.uint8) for _, t, _ in rows]
        feats = [np.unique(toxicity._features(r, np.array([0, len(r)]))[0]) for r in raw]
        return toxicity.fit(feats, np.array([y for *_, y in rows], float), counterfactual=weight)

    def change(m):
        out = []
        for name in ("muslim", "christian"):
            raw = np.frombuffer(f"the {name} garden is green".encode(), np.uint8)
            out.append(np.log(m.scores(raw, np.array([0, len(raw)]))[0]))
        return abs(out[0] - out[1])

    assert change(model(5.0)) < 0.3 * change(model(0.0))


def test_toxicity_without_labels(spark, tables):
    docs, labels, _ = tables
    got = toxicity.toxicity(docs, labels.where("false"))
    assert got.where("score between 0 and 1").count() == docs.count()
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0
    assert toxicity.without_toxic(docs, labels).columns == docs.columns


@pytest.fixture(scope="module")
def model():
    return licenses.Model()


@pytest.mark.parametrize(("family", "text"), [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts])
def test_templates_are_found(model, family, text):
    found, p, sure = model.classify("Copyright 2019 Some Author. " + text.capitalize() + ".")
    assert sure and found == family and p > 0.5


@pytest.mark.parametrize("text", licenses.ORDINARY + ["the committee met and discussed the plan", "", "license " * 30])
def test_prose_is_unknown(model, text):
    assert not model.classify(text)[2]


def test_license_scan(spark):
    rows = [
        (1, "Some words first.\nReleased under the MIT License.\nMore words."), (2, "All rights reserved."), (3, "plain prose only"), (4, None), (5, ""),
        (6, "word " * 3000 + "licensed under the Apache License, Version 2.0. " + "word " * 3000),
        (7, "Licensed under CC BY-NC 4.0.\nAll rights reserved."), (7, "a fishing license is required in this state"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("families", F.lit("clash"))
    got = sorted((r.doc_id, tuple(r.families), r.n_notices) for r in licenses.license_scan(df).collect())
    assert got == [
        (1, ("mit",), 1), (2, ("proprietary",), 1), (3, (), 0), (4, (), 0), (5, (), 0), (6, ("apache-2.0",), 1), (7, (), 0), (7, ("cc-by-nc-4.0", "proprietary"), 2),
    ]
    assert licenses.license_scan(df.where("false")).count() == 0
