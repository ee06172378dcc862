import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise import __main__ as cli
from lanewise.operators import artifacts, distill, semantic
from lanewise.plans.route import prepare, route


def test_semantic_layer(spark):
    df = prepare(spark.createDataFrame([("1", "my ssn is 123-45-6789"), ("2", "payroll secret sauce"), ("3", "nice day")], "request_id string, text string"))
    weights = spark.createDataFrame([("payroll", 3.0), ("secret", 2.0)], "token string, weight double")
    got = {r.request_id: r.semantic for r in semantic.assess(df, weights, -2.0, mode="enforce").collect()}
    assert (got["2"].fired, got["2"].enforced, got["2"].disagreement, got["2"].sensitivity_floor) == (True, True, "semantic_only", "confidential")
    assert got["1"].disagreement == "semantic_miss" and got["3"].disagreement is None
    shadow = semantic.assess(df, weights, -2.0)
    assert not any(r.semantic.enforced for r in shadow.collect())
    stats = semantic.assess_stats(shadow).first()
    assert (stats.n, stats.fire_rate, stats.disagreement_rate) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert semantic.assess(df, None).where("semantic.score is not null").count() == 0


def test_request_cache(spark):
    words = " ".join(f"w{i}" for i in range(20))
    rows = [(1, words, 0.0, False), (2, words.upper() + "  ", 10.0, False), (3, words + " extra", 20.0, False), (4, "other", 30.0, False), (5, words, 9000.0, False), (6, words, 9001.0, True)]
    df = spark.createDataFrame(rows, "id long, text string, ts double, fired boolean")
    got = {(r.id, r.served_from, r.how) for r in semantic.request_cache(df, fired="fired").collect()}
    assert got == {(2, 1, "exact"), (3, 2, "near")}


def test_outcomes_skip_blocked(spark):
    df = route(spark.createDataFrame([("1", "my ssn is 123-45-6789"), ("2", "hello")], "request_id string, text string"))
    assert [(r.request_id, r.completed_p) for r in semantic.outcomes(df, F.lit("done")).collect()] == [("2", 0.9)]


def test_artifacts(tmp_path):
    model = distill.Student({"a": ("x", "y")}, 3, 2)
    x = np.ones((2, 3))
    for path in (tmp_path / "dir", tmp_path / "m.zip"):
        artifacts.save(model, path)
        assert np.allclose(artifacts.load(path).predict(x)["a"], model.predict(x)["a"])
    assert artifacts.payload(model) == artifacts.payload(model)
    (tmp_path / "dir" / "b2.npy").write_bytes(b"changed")
    with pytest.raises(artifacts.ArtifactError):
        artifacts.load(tmp_path / "dir")


def test_cli(spark, tmp_path, capsys):
    cli.main(["route", "--text", "my ssn is 123-45-6789", "--output", str(tmp_path / "log.json")])
    assert "gate.force-local" in capsys.readouterr().out
    cli.main(["log-stats", "--input", str(tmp_path / "log.json")])
    assert "| tier | local | 1 |" in capsys.readouterr().out
    cli.main(["backtest"])
    out = capsys.readouterr().out
    assert "| cheap |" in out and "pii_fake" in out
    cli.main(["explain", "--input", str(tmp_path / "log.json"), "--id", "cli"])
    assert "cli" in capsys.readouterr().out
