"""Text and value functions on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from cohortaudit.functions import text as X
from cohortaudit.functions import values as V


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression.alias("r")).first().r


@pytest.mark.parametrize(("text", "want"), [(None, ""), ("  A__B\n c ", "a b c"), ("É x", "é x"), ("nan", "nan")])
def test_normalize(spark, text, want):
    assert one(spark, X.normalize("v"), text) == want


@pytest.mark.parametrize(("text", "want"), [(None, 0), ("It's X-ray 3", 3), ("a-b-c", 2), ("___", 0)])
def test_token_count(spark, text, want):
    assert one(spark, X.token_count("v"), text) == want


def test_mentions(spark):
    kinds = lambda t: tuple(one(spark, X.mentions("v", ["edema", "lung edema"]), t))
    assert kinds("edema seen") == (True, True, False, False)
    assert kinds("no edema") == (True, False, True, False)
    assert kinds("possible edema; without EDEMA") == (True, False, True, True)
    assert kinds("casino edema") == (True, False, True, False)  # a cue is a plain substring
    assert kinds("no " + "x" * 45 + " edema") == (True, True, False, False)
    assert kinds("edemas") == (False,) * 4
    assert kinds("possible no edema") == (True, False, True, False)
    assert kinds(None) == (False,) * 4


def test_mentions_of_many_phrases(spark):
    kinds = lambda t, *ps: tuple(one(spark, X.mentions("v", list(ps)), t))
    assert kinds("no lung edema. " + "x" * 45 + " edema of lung", "edema", "lung edema", "lung") == (True, True, True, False)
    assert kinds("edemas lungs", "edema", "lung", "lung edema") == (False,) * 4
    assert kinds("no pain pain", "pain pain", "edema") == (True, False, True, False)
    # the second of two overlapping occurrences of one phrase doesn't count, and it alone would be affirmed
    text = "no " + "x" * 41 + " pain pain pain"
    assert kinds(text, "pain pain", "edema") == kinds(text, "pain pain")
    assert kinds(text, "pain pain", "edema") == (True, False, True, False)
    assert kinds(text, "pain", "edema") == (True, True, True, False)


def test_low_information(spark):
    low = lambda t: one(spark, X.low_information("v", 3, ["chest pain"]), t)
    assert [low(t) for t in (None, "", "pain", "chest pain acute onset", "acute severe chest pain today")] == [False, False, True, True, False]


@pytest.mark.parametrize(("text", "want"), [("___ ____ _____", 0), ("___-year-old man with cough", 4), (None, 0), ("- ; é", 1)])
def test_effective_tokens(spark, text, want):
    assert one(spark, X.effective_tokens("v"), text) == want


def test_bins_differ_at_edges(spark):
    at = lambda f, n: one(spark, f("v"), n, "int")
    assert [at(X.length_bin, n) for n in (0, 4, 5, 80)] == [0, 0, 1, 5]
    assert [at(X.sweep_bin, n) for n in (0, 5, 6, 81)] == [None, "01-05", "06-10", "81+"]
    assert [one(spark, X.preflight_bin("v"), t) for t in (None, "a b c d", "a b c d e", "a " * 10)] == ["0", "1-4", "5-9", "10+"]
    assert [one(spark, X.natural_state("v", 3), n, "int") for n in (0, 2, 3)] == ["N3", "N2", "N1"]


def test_context(spark):
    row = spark.createDataFrame([(" a ", None, "")], "x string, y string, z string")
    assert row.select(X.build_context(["x", "y", "z", "q"], row.columns).alias("c")).first().c == "a"
    with pytest.raises(ValueError):
        X.build_context(["q"], row.columns)
    states = [one(spark, X.context_features("v", 3, [])["state"], t) for t in (None, "a", "a b c")]
    assert states == ["absent", "low_information", "usable"]


def test_paths(spark):
    p = lambda t: one(spark, V.parse_path("v"), t)
    assert tuple(p("train/patient1/study2/view1_frontal.jpg")) == ("train", "patient1", "study2", "view1_frontal.jpg")
    assert p("a/train/patient1/study2/x.jpg") is None and p("train/p1/study2/x.jpg") is None and p(None) is None
    assert [one(spark, V.view_number("v"), t) for t in ("VIEW12_x.jpg", "x.jpg", None)] == [12, None, None]
    assert one(spark, X.study_id("v"), "a/b/s123.txt") == 123 and one(spark, X.study_id("v"), "xs1.txt") is None
    assert one(spark, V.report_path("v"), "files/p1/p2/s3/x.dcm") == "files/p1/p2/s3.txt"


def test_states(spark):
    values = ("1", "0", "-1.0", "2", "x", None)
    assert [one(spark, V.encode_state("v"), v) for v in values] == [1.0, 0.0, -1.0, None, None, None]
    assert [one(spark, V.state_masks("v")["known"], v) for v in values] == [True, True, True, True, False, False]
    assert [one(spark, V.label_category("v"), v) for v in values] == ["pos", "neg", "unc", "unm", "unm", "unm"]
    masks = {k: [one(spark, V.label_variant("v", k)["mask"], v) for v in ("1", "-1", None)] for k in V.VARIANTS}
    assert masks == {"primary": [True, False, False], "unmentioned_negative": [True, False, True], "uncertain_positive": [True, True, False], "uncertain_negative": [True, True, False]}
    with pytest.raises(ValueError):
        V.label_variant("v", "other")
    assert [one(spark, V.class_state("v"), i, "int") for i in range(4)] == [None, 1.0, 0.0, -1.0]
    assert [one(spark, V.age_band("v"), a) for a in ("39", "39.5", "64", "80", "x", "-1")] == ["0-39", "40-64", "40-64", "80+", "Unknown", "Unknown"]


def test_decisions(spark):
    assert one(spark, V.decide("v", F.lit(0.5)), 0.5, "double")
    assert abs(one(spark, V.logit("v"), 0.0, "double") + 13.8155) < 1e-3
    assert one(spark, V.threshold_margin("v", F.lit(0.3)), 0.3, "double") == 0
