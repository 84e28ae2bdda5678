"""Specifications, paths, options and schedules."""

import math
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from seqloom.functions import schedules as S
from seqloom.operators.corrupt import geometric_p
from seqloom.operators.metrics import EVALUATIONS, EvalConfig
from seqloom.sources import specs


def test_specs():
    assert specs.parse_spec("ds[train:5_000]") == ("ds", {"train": 5000})
    assert specs.parse_spec("a=1,b=2") == (None, {"a": "1", "b": "2"})
    assert specs.parse_spec(" org/name [lang:py, test:10]") == ("org/name", {"lang": "py", "test": 10})
    assert specs.parse_spec("plain") == ("plain", {})
    with pytest.raises(ValueError):
        specs.parse_spec("x[no_colon]")
    assert [n for n, _ in specs.split_specs("a[x:1] | b + c[y:2,z:3]")] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        specs.split_specs(" ")


def test_paths(tmp_path, monkeypatch):
    monkeypatch.delenv("DATA_HOME", raising=False)
    assert specs.resolve_path("some/where", "DATA_HOME") == "some/where"
    monkeypatch.setenv("DATA_HOME", str(tmp_path))
    (tmp_path / "set").mkdir()
    assert specs.resolve_path("set", "DATA_HOME") == str(tmp_path / "set")
    assert specs.resolve_path("/absolute", "DATA_HOME") == "/absolute"
    with pytest.raises(FileNotFoundError):
        specs.resolve_path("missing", "DATA_HOME")


def test_small_helpers():
    assert specs.name_matches("org/alpaca-v2", "alpaca") and specs.name_matches("x", ["y", "x"]) and not specs.name_matches("a", "b")
    assert specs.token_list("[1;2]") == [1, 2] == specs.token_list([1, 2]) and specs.token_list(None) == [] == specs.token_list("")
    assert geometric_p("cart[geo_p:0.5]") == 0.5 and geometric_p("cart") == 0.3
    assert "masked" in EVALUATIONS


def test_options_merge():
    @dataclass
    class Source:
        batch_size: int = 4
        steps: int = 8
        other: str = "x"

    got = specs.merge_options(EvalConfig, Source(), steps=16, temperature=None, unknown=3)
    assert (got.batch_size, got.steps, got.temperature) == (4, 16, 0.0)


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_schedules(spark):
    assert one(spark, S.alpha("LINEAR")(0.5)) == 0.5
    assert one(spark, S.alpha("cosine")(0.5)) == pytest.approx(1 - math.sqrt(2) / 2)
    assert one(spark, S.alpha("linear").reverse_mask_prob(0.25, 0.75)) == pytest.approx(1 / 3)
    for name, make in (*S.ALPHAS.items(), *S.KAPPAS.items()):
        ends = [one(spark, make(t)) for t in (0.0, 1.0)]
        assert ends == pytest.approx([1, 0] if name in S.ALPHAS and make is S.ALPHAS[name] else [0, 1]), name
    for bad in (-0.1, 1.1):
        with pytest.raises(Exception):
            one(spark, S.alpha("linear")(bad))
        with pytest.raises(Exception):
            one(spark, S.kappa("cubic")(bad))
    with pytest.raises(Exception):
        one(spark, S.alpha("linear").reverse_mask_prob(0.5, 0.5))
    with pytest.raises(ValueError, match="linear"):
        S.alpha("none")
    with pytest.raises(ValueError):
        S.kappa("none")


def test_quotas(spark):
    quota = lambda n, steps: [*one(spark, S.transfer_quota(F.lit(n), steps, S.alpha("linear")))]
    assert quota(10, 4) == [2, 3, 2, 3] and quota(4, 3) == [1, 2, 1] and quota(16, 5) == [3, 3, 3, 4, 3] and quota(3, 8) == [1, 1, 1]
    assert quota(0, 4) == [] and one(spark, S.transfer_quota(F.lit(3), 4, S.alpha("linear"), keep_zeros=True)) is not None
    fixed = S.transfer_quota(F.lit(5), 3, S.alpha("linear"), draw=lambda rest, p, k: F.lit(9).cast("long"))
    assert [*one(spark, fixed)] == [5]
    assert [*one(spark, S.even_quota(F.lit(10), 4))] == [3, 3, 2, 2]
