"""Operators on hand-made tables and by identities on seeded random data."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortaudit.functions import text as X
from cohortaudit.operators import audit as A
from cohortaudit.operators import calibration as L
from cohortaudit.operators import cohort as C
from cohortaudit.operators import contracts as D
from cohortaudit.operators import interventions as I
from cohortaudit.operators import joins as J
from cohortaudit.operators import policy as K
from cohortaudit.operators import draws
from cohortaudit.operators import families as G
from cohortaudit.operators import prefix
from cohortaudit.operators import resample as B
from cohortaudit.operators import risk as R
from cohortaudit.operators import sections as S
from cohortaudit.operators.prefix import quantiles
from cohortaudit.plans import risk_queries as Q
from cohortaudit.plans.inputs import predictions
from cohortaudit.plans.registry import QUERIES


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# audit -------------------------------------------------------------------------------
IMAGES = [("S1", "view1_a", 1, 1.0), ("S2", "view2_a", 2, 1.0), ("S2", "view1_b", 1, 0.0), ("S3", "x", None, 1.0), ("S3", "view3", 3, 1.0), ("S3", "view2", 2, None)]


@pytest.fixture
def images(spark):
    return spark.createDataFrame([("Edema", *r) for r in IMAGES], "label string, study string, file string, number int, v double")


def test_weights_and_first_view(spark, images):
    w = A.study_weights(images)
    assert rows(w.groupBy("study").agg(F.round(F.sum("weight"), 9)), "*") == [("S1", 1.0), ("S2", 1.0), ("S3", 1.0)]
    assert rows(A.first_view(images), "study", "file") == [("S1", "view1_a"), ("S2", "view1_b"), ("S3", "view2")]


def test_disagreement_counts_null_and_concordance_does_not(spark, images):
    assert tuple(A.disagreement_summary(images).first()) == ("Edema", 0, 2)
    assert rows(A.disagreement(images), "a", "b", "studies") == [("neg", "pos", 1), ("pos", "unm", 1)]
    assert rows(A.concordant(images).groupBy("study").agg(F.min(F.col("concordant").cast("int"))), "*") == [("S1", 1), ("S2", 0), ("S3", 1)]


def test_weighted_median(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("a", 9, 2.0), ("b", 5, 0.1)], "g string, v int, w double")
    assert rows(A.weighted_median(df, ["g"], "v", "w"), "*") == [("a", 2), ("b", 5)]


def test_prevalence_without_known_labels(spark):
    df = spark.createDataFrame([("x", None), ("y", 1.0), ("y", -1.0)], "label string, v double")
    assert rows(A.label_prevalence(df), "label", "n_known", "n_missing", "prevalence") == [("x", 0, 1, 0.0), ("y", 2, 0, 0.5)]


# sections ----------------------------------------------------------------------------
REPORT = "                 FINAL REPORT\n EXAMINATION: CHEST\n\n INDICATION: cough\n HISTORY: fever\n TECHNIQUE: AP\n COMPARISON: none\n FINDINGS: clear\n lungs\n IMPRESSION: normal"


def test_permitted_text(spark):
    df = spark.createDataFrame([(1, REPORT), (2, "no header"), (3, None), (4, "INDICATION: a\nODD: b\nINDICATION: c")], "k int, t string")
    parsed = S.parse_sections(df, "t", ["k"], S.section_map(spark))
    assert rows(S.section_text(parsed, "k", ["indication", "history"]), "*") == [(1, "cough fever"), (4, "a c")]
    found = {(r.k, r.section): r.body for r in S.parse_plain(df, "t", ["k"]).collect()}
    assert found[1, "history"] == "cough\nfever" and found[1, "findings"] == "clear\n lungs" and found[2, "unsectioned"] == "no header"
    assert found[3, "unsectioned"] == ""
    assert not any(r.violates for r in S.order_violations(parsed, "k").collect())
    assert rows(S.unknown_headers(parsed, 1), "*") == [("ODD", 1)] and S.unknown_headers(parsed, 2).count() == 0


def test_index_summary(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 22)], "g string, v int")
    r = S.index_summary(df, ["g"], "v").first()
    assert (r.n, r.median, r.p95, r.most) == (21, 11, 20, 21)


# joins and contracts -----------------------------------------------------------------
def test_join_labels_policies(spark):
    main = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, v string")
    labels = spark.createDataFrame([(1, "z", 1), (3, "y", 0)], "k int, v string, y int")
    s = J.join_statistics(main, labels, "k").first()
    assert (s.main_duplicates, s.matched, s.main_only, s.label_only, s.expansion) == (1, 1, 1, 1, 1.0)
    with pytest.raises(ValueError):
        J.join_labels(main, labels, "k")
    got = J.join_labels(main, labels, "k", "allow")
    assert got.columns == ["k", "v", "y"] and got.count() == 4
    with pytest.raises(ValueError):
        J.join_labels(main, labels, "k", "allow", "fail")


def test_alignment_is_exact_or_raises(spark):
    p = spark.createDataFrame([(1, 10, 0.5), (2, 20, 0.6)], "study int, patient int, p double")
    assert J.align(p, p.select("study", "patient").where("study = 1"), "study", "patient").count() == 1
    other = spark.createDataFrame([(1, 11), (3, 30)], "study int, patient int")
    with pytest.raises(Exception, match="no aligned prediction"):
        J.align(p, other, "study", "patient").collect()
    assert J.align(p, other, "study", "patient", exact=False).count() == 0


def test_contract_violations(spark):
    schema = "site string, patient string, study string, image string, y int, p double, context string, state string"
    good = [("s", "p1", "a", "i1", 1, 0.5, "x", "informative"), ("s", "p2", "b", "i2", 0, 1.0, "", "absent")]
    bad = [("q", " ", "a", "i1", 2, 1.5, "x", "absent"), ("s", "p9", "b", "i3", None, None, None, "informative")]
    check = lambda r: {x.rule: x.violations for x in D.contract_violations(spark.createDataFrame(r, schema), ["patient"], "image", [("study", "patient")], ["y"], ["p"], "context", "state", {"site": ["s"]}).collect()}
    assert set(check(good).values()) == {0}
    assert check(good + bad) == {"blank:patient": 1, "label:y": 2, "probability:p": 2, "domain:site": 1, "state": 2, "repeated": 1, "parent:study": 2}
    with pytest.raises(ValueError):
        D.contract_violations(spark.createDataFrame(good, schema).drop("y"), ["patient"], "image", [], ["y"], [], "context", "state", {})
    with pytest.raises(ValueError):
        D.input_columns(["view", "findings_text"])
    with pytest.raises(PermissionError):
        D.require("fit", "evaluation", {"fit": ["calibration"]})


def test_only_source_calibration_may_fit(spark):
    df = spark.createDataFrame([("source", "calibration"), ("external", "calibration")], "site string, split string")
    assert D.require_source(df.where("site = 'source'"), "site", "split", "source", "calibration").count() == 1
    with pytest.raises(Exception, match="calibration rows"):
        D.require_source(df, "site", "split", "source", "calibration").collect()


# cohort ------------------------------------------------------------------------------
def test_waterfall_counts_each_row_once(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (1, 0), (0, 0), (None, 1)], "a int, b int")
    got = rows(C.waterfall(df, [("a", F.col("a") == 1), ("b", F.col("b") == 1)]), "step", "before", "removed", "after")
    assert got == [(1, 5, 3, 2), (2, 2, 1, 1)]


def test_largest_remainders():
    assert C.proportional({"a": 10, "b": 10, "c": 10}, 10) == {"a": 3, "b": 3, "c": 4}
    assert C.proportional({"a": 1, "b": 3}, 2) == {"a": 0, "b": 2}
    assert C.proportional({"a": 1, "b": 100}, 60) == {"a": 1, "b": 59}
    assert C.proportional({"a": 2, "b": 3}, 50) == {"a": 2, "b": 3}
    assert sum(C.proportional({"a": 7, "b": 13, "c": 29}, 20).values()) == 20


def test_tiers_are_patient_disjoint(spark):
    df = spark.createDataFrame([(i % 40, i, "train" if i % 40 < 30 else "test") for i in range(200)], "patient int, study int, split string")
    got = C.assign_tiers(df, "patient", "split", "train", 5, 7, "s")
    assert rows(C.tier_summary(got, "tier", "patient", "study"), "tier", "patients") == [("calibration", 7), ("eval", 5), ("official_test", 10), ("train", 18)]
    assert C.tier_disjoint(got, "tier", "patient").first().disjoint


# interventions -----------------------------------------------------------------------
def test_swap_invariants(spark):
    data = [(i // 2, i, "train", f"text {i}") for i in range(60)] + [(99, 99, "alone", "only")] + [(77, 100 + i, "single", f"s{i}") for i in range(3)] + [(5, 200, None, "null")]
    df = spark.createDataFrame(data, "patient int, study int, split string, context string")
    got = {r.study: r for r in I.swapped(df, ["split"], "patient", "study", "context", "x").collect()}
    assert len(got) == len(data)
    assert {r.context for r in got.values()} <= {d[3] for d in data}
    assert all(got[i].donor_patient != got[i].patient for i in range(60))
    assert got[99].context == "only" and got[200].context == "null"
    assert {got[100 + i].donor_patient for i in range(3)} == {77}
    one = {r.study: r for r in I.swapped_by_one_offset(df.where("split = 'train'"), ["split"], "patient", "study", "context", "x").collect()}
    assert sorted(r.context for r in one.values()) == sorted(f"text {i}" for i in range(60))
    assert all(r.donor_patient != r.patient for r in one.values())
    with pytest.raises(Exception, match="half of its rows"):
        I.swapped_by_one_offset(df.where("split = 'single'"), ["split"], "patient", "study", "context", "x").collect()


def test_running_sums_over_parts(spark):
    rng = random.Random(1)
    data = [("g%d" % rng.randrange(3), rng.choice([None, *range(50)]), i, rng.random()) for i in range(400)]
    df = spark.createDataFrame(data, "g string, a int, k int, v double")
    for down in (False, True):
        got = {r.k: r.cum_v for r in prefix.running_sums(df, ["g"], [("a", down), ("k", False)], ["v"], 7).collect()}
        for g in ("g0", "g1", "g2"):
            own = sorted((d for d in data if d[0] == g), key=lambda d: (((d[1] if d[1] is not None else -1) * (-1 if down else 1)), d[2]))
            total = 0.0
            for d in own:
                total += d[3]
                assert abs(got[d[2]] - total) < 1e-9


@pytest.mark.parametrize("rows", [[("g", f"patient-with-a-long-name-{i:06d}", 0.5) for i in range(8000)], [("g", f"k{i:06d}", 0.5 if i % 10 else i / 8000) for i in range(8000)]])
def test_parts_follow_the_rows(spark, rows):
    """One long common prefix, and nine of ten first values the same: the largest part stays near the mean."""
    df = spark.createDataFrame(rows, "g string, k string, v double")
    laid = prefix.ranged(df, ["g"], [("v", True), ("k", False)], 8)
    sizes = [r["count"] for r in laid.groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.5 * 1000
    got = {r.k: r.cum_one for r in prefix.running_sums(df.withColumn("one", F.lit(1)), ["g"], [("v", True), ("k", False)], ["one"], 8).collect()}
    assert got == {k: i + 1 for i, (_, k, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[1])))}


# draws -------------------------------------------------------------------------------
def test_hashed_binomials_are_quantiles():
    rng = np.random.default_rng(1)
    for c, p in ((0, 0.5), (1, 0.5), (7, 4 / 7), (40, 0.5), (300, 0.49)):
        u = rng.random(300)
        pmf = [math.comb(c, j) * p**j * (1 - p) ** (c - j) for j in range(c + 1)]
        want = [int(np.searchsorted(np.cumsum(pmf), x, "right")) for x in u]
        assert draws.binomials(np.full(300, c), p, u).tolist() == want


def test_equal_counts_share_their_weights(monkeypatch):
    """Weights are made for each value of c, not for each draw."""
    made, plain = [], np.cumprod
    monkeypatch.setattr(np, "cumprod", lambda x, **k: made.append(x.size) or plain(x, **k))
    u = np.random.default_rng(3).random(2000)
    together = draws.binomials(np.repeat([90, 100], 1000), 0.5, u)
    assert 0 < sum(made) < 2 * 200
    apart = [draws.binomials(np.array([c]), 0.5, u[i : i + 1])[0] for i, c in enumerate(np.repeat([90, 100], 1000))]
    assert together.tolist() == apart


def test_counts_are_multinomial():
    """They add up to n, don't depend on who asks, and have the moments and the cells of n draws with replacement."""
    n, reps = 200, 4000
    w = draws.counts(12345, n, reps, 0, 4)
    assert w.shape == (reps, n) and (w.sum(axis=1) == n).all()
    assert (draws.counts(12345, n, reps, 2, 3) == w[:, 128:192]).all()
    chi = ((w.sum(axis=0) - reps) ** 2 / reps).sum()
    assert 130 < chi < 290  # 199 degrees of freedom
    want = [math.comb(n, j) * (1 / n) ** j * (1 - 1 / n) ** (n - j) for j in range(6)]
    seen = [(w == j).mean() for j in range(6)]
    assert max(abs(a - b) for a, b in zip(seen, want)) < 0.003
    pairs = np.cov(w.T)
    assert abs(np.diag(pairs).mean() - (1 - 1 / n)) < 0.01
    apart = [pairs[0, 1], pairs[0, 70], pairs[63, 64], pairs[100, 199]]
    assert max(abs(x) for x in apart) < 0.08
    far = draws.counts(99, 1_000_000, 3, 7000, 7002)
    assert far.shape == (3, 128) and 60 < far.sum(axis=1).mean() < 200


def test_replicates_need_no_draw_rows(spark):
    """The plan sends replicates' sums through one exchange after the counts, and no rows of draws."""
    df = spark.range(5000).selectExpr("if(id % 2 = 0, 's', 'e') site", "id patient", "cast(id as double) x")
    plan = B.replicate_sums(df, df, "site", "patient", [], ["x"], 50, "seed")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan and plan.count("MapInPandas") == 1


def test_a_tree_is_walked_once(monkeypatch):
    """Chunks read in order from one tree split each of its ranges once, and give the counts of chunks read alone."""
    n, calls = 20 * draws.LEAF - 5, []
    plain = draws.binomials
    monkeypatch.setattr(draws, "binomials", lambda *a: calls.append(1) or plain(*a))
    tree = draws.Leaves(7, n, 5)
    parts = [tree.counts(k, k + 4) for k in range(0, 20, 4)]
    assert len(calls) == 19
    assert (np.concatenate(parts, axis=1) == draws.counts(7, n, 5, 0, 20)).all() and (parts[3] == draws.counts(7, n, 5, 12, 16)).all()


def test_weights_are_not_broadcast(spark):
    """A patient's weights are an array that Spark takes for one number; a broadcast of them would fill the driver."""
    df = spark.range(300).selectExpr("if(id % 2 = 0, 's', 'e') site", "id patient")
    got = B.with_weights(df, df, "site", "patient", 20, "seed")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    counts = {(r.site, r.patient, r.rep): r.n for r in B.patient_counts(df, "site", "patient", 20, "seed").collect()}
    assert {(r.site, r.patient, k): n for r in got.collect() for k, n in enumerate(r.weights) if n} == counts


def test_counts_leave_python_as_weights(spark):
    """A row a patient comes from Python; the rows of the replicates are made after it."""
    df = spark.range(300).selectExpr("if(id % 2 = 0, 's', 'e') site", "id patient")
    got = B.patient_counts(df, "site", "patient", 20, "seed")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("MapInArrow")
    assert {(r.site, r.rep): r.n for r in got.groupBy("site", "rep").agg(F.sum("n").alias("n")).collect()} == {(s, k): 150 for s in ("s", "e") for k in range(20)}


def test_sums_are_computed_once_to_be_weighed(spark):
    """Tasks follow from patients' numbers: nothing is computed beforehand for a sample of them."""
    df = spark.range(3000).selectExpr("'s' site", "id patient", "cast(1 as double) x")
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    sums = df.mapInPandas(told, df.schema)
    got = B.replicate_sums(sums, df, "site", "patient", [], ["x"], 5, "seed").collect()
    assert [r.x for r in got] == [3000.0] * 5 and seen.value == 3000


def test_groups_side_by_side_or_apart(spark):
    """Sums are the same whether most patients have most groups or each has its own."""
    df = spark.range(200).selectExpr("'s' site", "id patient", "cast(id % 7 as double) x")
    counts = {(r.patient, r.rep): r.n for r in B.patient_counts(df, "site", "patient", 4, "seed").collect()}
    for group, many in (("id % 2", 2), ("id % 50", 50)):
        per = spark.range(200).selectExpr("'s' site", "id patient", f"{group} g", "cast(id % 7 as double) x")
        per = per.unionByName(per.where("patient < 20"))
        want = {(g, rep): sum((i % 7) * (2 if i < 20 else 1) * counts.get((i, rep), 0) for i in range(200) if i % many == g) for g in range(many) for rep in range(4)}
        assert {(r.g, r.rep): r.x for r in B.replicate_sums(per, df, "site", "patient", ["g"], ["x"], 4, "seed").collect()} == want


def test_refits_weigh_their_histogram_once(spark, monkeypatch):
    """Replicates' thresholds are read several times, but the patients' histogram is weighed once."""
    seen, rows, plain = spark.sparkContext.accumulator(0), [], K.grid_histogram

    def told(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    def counted(df, by, *a):
        hist = plain(df, by, *a)
        if "patient" not in by:
            return hist
        rows.append(hist.count())
        return hist.mapInPandas(told, hist.schema)

    monkeypatch.setattr(K, "grid_histogram", counted)
    assert len(QUERIES["k10_calibration_uncertainty"](spark, "/root/testdata/sf0.001").collect()) == 4
    assert rows[0] > 0 and seen.value == rows[0]


def test_policies_of_all_replicates(spark):
    """Sums under every replicate's policy are those of each study's own terms."""
    rng = random.Random(8)
    cells = [(s, "m", i, t, round(rng.random(), 2), rng.choice([0.0, 1.0, None])) for s in "es" for i in range(30) for t in "ab"]
    df = spark.createDataFrame(cells, "site string, model string, study int, target string, p double, y double")
    cut, known = [0.1, 0.3, 0.9], {(k, t): rng.random() for k in range(3) for t in "ab"}
    thresholds = spark.createDataFrame([(k, "m", t, v) for (k, t), v in known.items()], "rep int, model string, target string, threshold double")
    cutoffs = spark.createDataFrame([(k, "m", c) for k, c in enumerate(cut)], "rep int, model string, cutoff double")
    got = {(r.site, r.rep): r for r in G.policy_replicates(df, thresholds, cutoffs, ["a", "b"]).collect()}
    for site in "es":
        for rep in range(3):
            sums = dict.fromkeys([f"{a}_{c}" for a in ("a", "all") for c in R.term_columns(["a", "b"])], 0.0)
            for i in range(30):
                own = [c for c in cells if c[0] == site and c[2] == i]
                wrong = {c[3]: float(c[5] is not None and (c[4] >= known[rep, c[3]]) != c[5]) for c in own}
                obs = {c[3]: float(c[5] is not None) for c in own}
                n, m = sum(wrong.values()), sum(obs.values())
                terms = dict(one=1, evaluable=m > 0, e_orig=n / max(m, 1), n_wrong=n, n_obs=m, **{f"wrong_{t}": wrong[t] for t in "ab"}, **{f"obs_{t}": obs[t] for t in "ab"})
                for a in ["all"] + ["a"] * (min(abs(2 * c[4] - 1) for c in own) >= cut[rep]):
                    for c, v in terms.items():
                        sums[f"{a}_{c}"] += v
            assert all(abs(got[site, rep][c] - v) < 1e-9 for c, v in sums.items())


def test_swapped_studies_are_judged_without_a_window(spark, monkeypatch):
    """Acceptance is taken as a study's cells are added up."""
    taken = []
    monkeypatch.setattr(G, "items", lambda terms, *a: taken.append(terms) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        QUERIES["r24_swap_permutations"](spark, "/root/testdata/sf0.001")
    plan = taken[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(seed" not in plan


def test_cells_stay_with_their_study(spark):
    """A study's cells are made after the shuffle by study, so grouping them needs no other."""
    got = predictions(spark, "/root/testdata/sf0.001").groupBy("study", "model").count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(study") == 1 and "Exchange hashpartitioning(study" in plan.split("Generate")[-1]


# policies ----------------------------------------------------------------------------
def test_policy_terms_without_copies_of_cells(spark):
    """They equal the terms of cells copied for each policy, with nulls and probabilities at a quantile."""
    rng = random.Random(4)
    data = [("m", i, t, rng.choice([0.0, 0.2, 0.35, 0.5, 0.8, 1.0, None] if i % 9 == 0 else [round(rng.random(), 2)]), rng.choice([0.0, 1.0, None])) for i in range(120) for t in ("a", "b")]
    cells = spark.createDataFrame(data, "model string, study int, target string, p double, y double")
    fits = spark.createDataFrame([("m", t, 0.4, 1.2, 0.9, 0.1, q) for t, q in (("a", 0.8), ("b", 0.35))], "model string, target string, threshold double, cold double, a double, b double, q double")
    cuts = spark.createDataFrame([("m", 0.3, 0.3, -0.4)], "model string, plain double, chill double, loss double")
    want = R.study_terms(K.apply_policies(cells, ["model", "study"], "model", "target", (fits, cuts)), ["model", "study", "policy", "accepted", "score"], ["a", "b"])
    got = G.policy_terms(cells, ["model", "study"], "model", "target", (fits, cuts), ["a", "b"])
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())) and got.count() == 600


def test_shares_of_single_labels(spark):
    """K8: each alpha's share of studies with one label in every target, counted by ranges of alphas, picks the alpha that cells judged one by one do."""
    rng = random.Random(8)
    alphas = [round(0.05 * i, 2) for i in range(1, 15)]
    data = [("m", i, t, None if i == 3 else round(rng.random() ** (2 if i % 2 else 0.5), 2), float(i % 2) if i % 7 else None) for i in range(90) for t in ("a", "b")]
    got = {r.target: r for r in K.conformal_fit(spark.createDataFrame(data, "model string, study int, target string, p double, y double"), ["model"], "target", "study", alphas, 0.7).collect()}
    q = {}
    for t in ("a", "b"):
        s = sorted(1 - p if y == 1 else p for _, _, u, p, y in data if u == t and y is not None and p is not None)
        n = sum(1 for _, _, u, p, y in data if u == t and y is not None)
        for a in alphas:
            q[t, a] = ([None] * (n - len(s)) + s + [None])[min(math.ceil((n + 1) * (1 - a)), n + 1) - 1]
            q[t, a] = 1.0 if q[t, a] is None else q[t, a]
    single = lambda p, x: p is not None and ((1 - p) <= x) != (p <= x)
    share = {a: sum(all(single(p, q[t, a]) for _, i, t, p, _ in data if i == k) for k in range(90)) / 90 for a in alphas}
    best = min(alphas, key=lambda a: (round(abs(share[a] - 0.7), 9), a))
    assert got["a"].alpha == best and got["a"].acceptance == round(share[best], 6)


def brute_grid(p, y):
    best = None
    for i in range(1, 1000):
        t = i / 1000
        tp = sum(a >= t and b == 1 for a, b in zip(p, y)) / sum(y)
        tn = sum(a < t and b == 0 for a, b in zip(p, y)) / (len(y) - sum(y))
        s = (tp + tn) / 2
        if best is None or s > best[1]:
            best = (t, s)
    return best


def test_grid_threshold(spark):
    rng = random.Random(2)
    cases = {"a": [(rng.choice([0.1, 0.25, 0.7, rng.random()]), rng.randrange(2)) for _ in range(40)], "b": [(0.5, 1), (0.499, 0)], "c": [(0.3, 1), (0.2, 1)], "d": [(1.0, 1), (0.0, 0), (0.001, 0), (0.999, 1)]}
    df = spark.createDataFrame([(k, p, float(y)) for k, v in cases.items() for p, y in v] + [("a", 0.9, None)], "t string, p double, y double")
    got = {r.t: (r.threshold, r.balanced_accuracy) for r in K.grid_thresholds(df, ["t"]).collect()}
    assert got["c"] == (0.5, None)
    for k in ("a", "b", "d"):
        t, s = brute_grid(*zip(*cases[k]))
        assert got[k] == (t, round(s, 6))
    exact = {r.t: r.threshold for r in K.exact_thresholds(df, ["t"]).collect()}
    assert exact["b"] == 0.5 and exact["d"] == 0.999


def test_cutoffs_and_conformal(spark):
    df = spark.createDataFrame([("m", i / 10) for i in range(1, 11)], "m string, confidence double")
    assert abs(K.cutoffs(df, ["m"], [0.8]).first().cutoff - 0.28) < 1e-12
    assert K.rank_cutoffs(df, ["m"], 0.75).first().cutoff == 0.3
    cells = spark.createDataFrame([("m", p, 1.0) for p in (0.9, 0.8, 0.7, 0.6)], "m string, p double, y double")
    assert abs(K.conformal_quantile(cells, ["m"], 0.4).first().q - 0.3) < 1e-12
    assert K.conformal_quantile(cells, ["m"], 0.01).first().q == 1.0


def test_scaling_recovers_the_truth(spark):
    rng = random.Random(3)
    data = []
    for _ in range(4000):
        z = rng.gauss(0, 2)
        data.append(("t", 1 / (1 + math.exp(-z)), float(rng.random() < 1 / (1 + math.exp(-(0.5 * z + 0.7))))))
    df = spark.createDataFrame(data, "target string, p double, y double")
    r = K.fit_scaling(df, ["target"], True).first()
    assert abs(r.a - 0.5) < 0.06 and abs(r.b - 0.7) < 0.1
    flipped = K.fit_scaling(df.withColumn("y", 1 - F.col("y")), ["target"], True).first()
    assert flipped.a is None


def test_temperature_is_the_likelihood_optimum(spark):
    rng = random.Random(12)
    data = [(m, t, round(rng.uniform(0.02, 0.98), 3), float(rng.random() < 0.4)) for m in ("m", "n") for t in ("s", "t") for _ in range(60)]
    df = spark.createDataFrame(data, "model string, target string, p double, y double")
    logit = lambda p: math.log(p / (1 - p))
    fits = {(r.model, r.target): r.a for r in K.fit_scaling(df, ["model", "target"], False).collect()}
    assert len(fits) == 4
    for key, a in fits.items():
        own = [(logit(p), y) for *k, p, y in data if tuple(k) == key]
        loss = lambda a: sum(math.log(1 + math.exp(-a * x)) if y else math.log(1 + math.exp(a * x)) for x, y in own)  # noqa: B023, E731
        best = min((loss(i / 2000), i / 2000) for i in range(-4000, 4001))[1]
        assert (a is None and best <= 0) or abs(a - best) < 1e-3


def test_expected_loss_and_policies(spark):
    rng = random.Random(13)
    cells = [("m", s, t, round(rng.uniform(0.02, 0.98), 3)) for s in range(30) for t in ("a", "b")]
    df = spark.createDataFrame(cells, "model string, study int, target string, p double")
    th, fit, cold, q = {"a": 0.4, "b": 0.6}, {"a": (0.8, 0.1), "b": (1.5, -0.2)}, {"a": 1.2, "b": 0.7}, {"a": 0.7, "b": 0.45}
    table = lambda d, name: spark.createDataFrame([("m", t, v) for t, v in d.items()], f"model string, target string, {name} double")
    fits = spark.createDataFrame([("m", t, *v) for t, v in fit.items()], "model string, target string, a double, b double")
    losses = K.expected_loss(df, fits, table(th, "threshold"), ["model", "study"], ["model", "target"])
    sig = lambda x: 1 / (1 + math.exp(-x))
    logit = lambda p: math.log(p / (1 - p))
    score = {}
    for s in range(30):
        wrong = []
        for _, _, t, p in (c for c in cells if c[1] == s):
            x = sig(fit[t][0] * logit(p) + fit[t][1])
            wrong.append(1 - x if p >= th[t] else x)
        score[s] = -sum(wrong) / 2
    for r in losses.collect():
        assert abs(r.score - score[r.study]) < 1e-12
    cuts = spark.createDataFrame([("m", 0.3, 0.25, -0.3)], "model string, plain double, cold double, loss double")
    got = K.policies(df, "model", "study", "target", table(th, "threshold"), table(cold, "a"), table(q, "q"), losses, cuts).collect()
    assert len(got) == 5 * 60
    for r in got:
        own = [(t, p) for _, s, t, p in cells if s == r.study]
        p = dict(own)[r.target]
        margin = min(abs(2 * p - 1) for _, p in own)
        single = all((1 - p <= q[t]) != (p <= q[t]) for t, p in own)
        accepted = {"frozen": margin >= 0.3, "temp_margin": min(abs(2 * sig(cold[t] * logit(p)) - 1) for t, p in own) >= 0.25, "expected_loss": score[r.study] >= -0.3, "conformal": single, "conformal_frozen": single}
        assert r.accepted == accepted[r.policy]
        assert r.decision == (1 - p <= q[r.target] if r.policy == "conformal" else p >= th[r.target])


def test_quantiles_and_places(spark):
    rng = random.Random(14)
    data = [(g, rng.choice([None, 0.1, 0.2, 0.35, rng.random()])) for g in ("x", "y", None) for _ in range(40)] + [("z", 0.5)]
    df = spark.createDataFrame(data, "g string, v double")
    shares = [0.0, 0.025, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in quantiles(df, ["g"], "v", shares).collect()}
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    for g in want:
        assert all(abs(a - b) < 1e-12 for a, b in zip(got[g], want[g]))
    assert abs(quantiles(df, [], "v", [0.5]).first().q[0] - df.agg(F.percentile("v", 0.5)).first()[0]) < 1e-12
    assert quantiles(df.where("v > 2"), ["g"], "v", [0.5]).count() == 0


# risks -------------------------------------------------------------------------------
TARGETS = ["u", "v"]


@pytest.fixture
def terms(spark):
    cells = [(s, t, d, y) for s, row in {1: [(1, 1.0), (1, 0.0)], 2: [(0, 0.0), (0, None)], 3: [(1, None), (1, None)]}.items() for t, (d, y) in zip(TARGETS, row)]
    df = spark.createDataFrame(cells, "study int, target string, decision int, y double")
    return R.study_terms(df, ["study"], TARGETS).withColumn("accepted", F.lit(True))


def test_estimators(spark, terms):
    e = R.study_error(terms)
    assert rows(e, "study", "error_zero", "error") == [(1, 0.5, 0.5), (2, 0.0, 0.0), (3, 0.0, None)]
    sums = R.accepted_sums(terms, [], TARGETS)
    r = sums.select(*(c.alias(k) for k, c in R.estimators(TARGETS).items())).first()
    assert (r.original, r.evaluable_study, r.cell_micro) == (0.5 / 3, 0.25, 1 / 3)
    assert (r.pathology_u, r.pathology_v, r.pathology_macro) == (0.0, 1.0, 0.5)
    nothing = R.accepted_sums(terms.withColumn("accepted", F.lit(False)), [], TARGETS).select(*(c.alias(k) for k, c in R.estimators(TARGETS).items())).first()
    assert set(nothing) == {None}


def test_original_is_evaluable_times_share(spark):
    rng = random.Random(4)
    cells = [(s, t, rng.randrange(2), rng.choice([None, 0.0, 1.0])) for s in range(200) for t in TARGETS]
    terms = R.study_terms(spark.createDataFrame(cells, "study int, target string, decision int, y double"), ["study"], TARGETS).withColumn("accepted", F.col("study") % 3 > 0)
    s = R.accepted_sums(terms, [], TARGETS)
    e = R.estimators(TARGETS)
    r = s.select(e["original"].alias("o"), e["evaluable_study"].alias("v"), (F.col("a_evaluable") / F.col("a_one")).alias("share")).first()
    assert abs(r.o - r.v * r.share) < 1e-12


def test_terms_of_cells_beside_each_other(spark):
    rng = random.Random(6)
    wide = [(s, rng.choice([1, 1, 3]), *(v for _ in TARGETS for v in (rng.choice([None, 0, 1]), rng.choice([None, 0.0, 1.0])))) for s in range(60)]
    cells = [(r[0], t, *r[2 + 2 * i : 4 + 2 * i]) for r in wide for i, t in enumerate(TARGETS) for _ in range(r[1])]
    want = R.study_terms(spark.createDataFrame(cells, "study int, target string, decision int, y double"), ["study"], TARGETS)
    got = R.wide_terms(spark.createDataFrame(wide, "study int, copies int, " + ", ".join(f"decision_{t} int, y_{t} double" for t in TARGETS)), ["study"], TARGETS, copies="copies")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("lost", [False, True])
def test_terms_need_no_row_for_each_cell(spark, tmp_path, lost):
    sf = "/root/testdata/sf0.001"
    state = lambda s, t: int(hashlib.md5(f"s:{s}:{t}".encode()).hexdigest()[:8], 16) % 20
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders = orders.unionByName(orders.where("o_orderkey % 5 = 0"))  # some studies are given twice
    if lost:  # calibration has no label of alpha
        orders = orders.where((F.col("o_orderstatus") != "O") | F.col("o_orderkey").isin([s for (s,) in orders.select("o_orderkey").distinct().collect() if state(s, "alpha") < 4]))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("customer", "nation"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    got = Q._terms(spark, str(tmp_path))
    want = R.study_terms(Q._cells(spark, str(tmp_path)), Q.KEYS, Q.T).collect()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and {r.obs_alpha > 0 for r in want} == ({False} if lost else {False, True})
    plan = R.accepted_sums(got, ["site", "model", "condition", "patient"], Q.T)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Aggregate [" in line and "condition" in line for line in plan.splitlines()) == 1


def test_resampling_takes_only_the_sums_it_needs(spark, monkeypatch):
    assert R.needed_sums(TARGETS, ["original"]) == ["a_e_orig", "a_one"]
    written, kept = {}, Q.kept
    monkeypatch.setattr(Q, "kept", lambda df, name: written.update({name: df.columns}) or kept(df, name))
    monkeypatch.setattr(Q, "REPS", 20)
    replicates, _ = Q._resampled(spark, "/root/testdata/sf0.001", ["original"])
    assert written["sums"] == ["site", "model", "condition", "patient", "a_e_orig", "a_one", "all_one"]
    assert replicates.columns == ["rep", "site", "model", "condition", "original"] and replicates.count() == 20 * 2 * 2 * 3


def brute_auroc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_auroc_and_precision(spark):
    rng = random.Random(5)
    data = [("g", rng.randrange(12) / 12, rng.random() < 0.4) for _ in range(150)] + [("one", 0.5, True)]
    df = spark.createDataFrame(data, "g string, s double, y boolean")
    got = {r.g: r.auroc for r in R.auroc(df, ["g"], "s", F.col("y")).collect()}
    assert got["one"] is None and abs(got["g"] - brute_auroc([(s, y) for g, s, y in data if g == "g"])) < 1e-6
    doubled = df.unionAll(df.where("y"))
    weighted = df.withColumn("w", F.when(F.col("y"), 2).otherwise(1))
    assert rows(R.auroc(doubled, ["g"], "s", F.col("y")), "g", "auroc") == rows(R.auroc(weighted, ["g"], "s", F.col("y"), "w"), "g", "auroc")
    ap = spark.createDataFrame([("g", 0.9, 1), ("g", 0.8, 0), ("g", 0.7, 1)], "g string, s double, y int")
    assert R.average_precision(ap, ["g"], "s", F.col("y") == 1).first().average_precision == round((1 + 2 / 3) / 2, 6)


def test_curve(spark):
    df = spark.createDataFrame([("g", 1, 0.9, 0.0), ("g", 2, 0.8, 1.0), ("g", 3, 0.8, 0.0), ("g", 4, 0.1, None)], "g string, k int, c double, e double")
    points = R.curve(df, ["g"], "c", "e", "k")
    assert [round(r.risk, 6) for r in points.orderBy("k").collect()] == [0.0, 0.5, round(1 / 3, 6)]
    a = R.areas(points, ["g"]).first()
    assert (a.aurc, a.augrc) == (round((0 + 0.5 + 1 / 3) / 3, 6), round((0 + 1 / 3 + 1 / 3) / 3, 6))
    assert [r.risk for r in R.curve_at(points, ["g"], [0.5, 1.0]).orderBy("grid").collect()] == [0.5, round(1 / 3, 6)]
    assert [r.risk for r in R.curve_at(points, ["g"], [0.0, 0.4, 2.0]).orderBy("grid").collect()] == [points.orderBy("coverage").first().risk, 0.5, round(1 / 3, 6)]


def test_run_segments(spark):
    log = spark.createDataFrame([("r", i, e, v) for i, (e, v) in enumerate([(1, 0.5), (2, 0.7), (3, 0.7), (1, 0.2), (2, 0.9)])], "k string, i int, epoch int, v double")
    assert rows(R.run_segments(log, ["k"], ["i"], "epoch", "v"), "run", "epochs", "best_epoch", "best") == [(1, 3, 2, 0.7), (2, 2, 2, 0.9)]


def test_run_segments_of_a_long_key(spark):
    """Nine tenths of the log under one key lie in several parts; the result is that of a plain loop."""
    rng = random.Random(4)
    data = [("long" if rng.random() < 0.9 else rng.choice(["a", None]), i, rng.choice([None, *range(1, 9)]), rng.choice([0.1, 0.2, 0.3])) for i in range(3000)]
    log = spark.createDataFrame(data, "k string, i int, epoch int, v double").repartition(5)
    sizes = [r["count"] for r in prefix.ranged(log, ["k"], [("i", False)], 8).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.6 * 375
    want = []
    for k in ("long", "a", None):
        last, run = None, 0
        own = {}
        for _, _, e, v in (d for d in data if d[0] == k):
            run += not (e is not None and last is not None and e > last)
            last = e
            own.setdefault(run, []).append((e, v))
        for run, members in own.items():
            top = max(v for _, v in members)
            want.append((k, run, len(members), top))
    got = R.run_segments(log, ["k"], ["i"], "epoch", "v", 8).collect()
    assert sorted(((r.k or "", r.run, r.epochs, r.best) for r in got)) == sorted((k or "", *x) for k, *x in want)


def test_coverage_at_risk_ends_with_its_ties(spark):
    df = spark.createDataFrame([("g", c, e) for c, e in ((0.9, 0.0), (0.8, 1.0), (0.8, 0.0), (0.5, 0.0), (0.4, 1.0), (0.3, None), (None, 0.0))], "g string, c double, e double")
    got = rows(L.coverage_at_risk(df, ["g"], "c", "e", [0.0, 0.25, 0.26, 0.5]), "level", "coverage", "cutoff")
    assert got == [(0.0, 0.2, 0.9), (0.25, 0.8, 0.5), (0.26, 0.8, 0.5), (0.5, 1.0, 0.4)]
    none = df.where("c = 0.4")
    assert rows(L.coverage_at_risk(none, ["g"], "c", "e", [0.1]), "coverage", "cutoff") == [(0.0, None)]


def test_equal_mass_bins_keep_ties(spark):
    df = spark.createDataFrame([("g", 0.1, 0.0)] * 6 + [("g", 0.9, 1.0), ("g", 0.8, 0.0)], "g string, p double, y double")
    assert rows(L.equal_mass_error(df, ["g"], 4), "cells", "bins", "ece", "mce") == [(8, 2, 0.1625, 0.35)]
    assert rows(L.calibration_error(df.withColumn("p", F.lit(1.0)), ["g"], 15), "bins", "ece") == [(1, 0.875)]


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.02), ("f", "c", 0.03), ("f", "d", 0.5)], "f string, n string, p double")
    assert rows(B.benjamini_hochberg(df, ["f"], "n", "p"), "n", "bh") == [("a", 0.04), ("b", 0.04), ("c", 0.04), ("d", 0.5)]


# families ----------------------------------------------------------------------------
def test_orders_of_all_replicates_at_once(spark):
    """Areas and cutoffs by weights equal those of every replicate's own repeated rows."""
    rng, reps = np.random.default_rng(2), 7
    n = 300
    c, e, w = rng.integers(0, 40, n) / 40, rng.integers(0, 3, n) / 2, rng.integers(0, 4, (n, reps))
    df = spark.createDataFrame([(f"g{i % 2}", i, float(c[i]), None if i % 11 == 0 else float(e[i]), [float(x) for x in w[i]]) for i in range(n)], "g string, k int, c double, e double, weights array<double>").repartition(5)
    areas = {(r.g, r.rep): r for r in G.weighted_areas(df, ["g"], "c", "e", "k").collect()}
    cuts = {(r.g, r.rep): r.cutoff for r in G.weighted_cutoffs(df, ["g"], "c", 0.2).collect()}
    for g in (0, 1):
        for rep in range(reps):
            own = [i for i in range(n) if i % 2 == g]
            assert abs(cuts[f"g{g}", rep] - np.quantile(np.repeat(c[own], w[own, rep]), 0.2)) < 1e-12
            done = errors = area = general = 0.0
            for i in sorted((i for i in own if i % 11), key=lambda i: (-c[i], i)):
                done, errors = done + w[i, rep], errors + w[i, rep] * e[i]
                area += w[i, rep] * (errors / done if done else 0)
                general += w[i, rep] * errors
            assert abs(areas[f"g{g}", rep].aurc - area / done) < 1e-6 and abs(areas[f"g{g}", rep].augrc - general / done**2) < 1e-6


def test_swaps_of_several_seeds(spark):
    df = spark.createDataFrame([(i % 13 if i % 5 else 1, i, f"s{i % 3}" if i % 17 else None, f"t{i}") for i in range(200)], "patient int, study int, stratum string, context string")
    many = {(r.seed, r.study): r.donor for r in I.swaps(df, ["stratum"], "patient", "study", ["a", "b"]).collect()}
    for seed in ("a", "b"):
        want = {(seed, r.study): r.donor_study for r in I.swapped(df, ["stratum"], "patient", "study", "context", seed).collect()}
        assert want == {k: v for k, v in many.items() if k[0] == seed}


# resampling --------------------------------------------------------------------------
def test_replicates_equal_row_level_sums(spark):
    rng = random.Random(6)
    data = [("s" if i % 3 else "e", f"p{i % 20}", i, rng.random()) for i in range(90)]
    df = spark.createDataFrame(data, "site string, patient string, study int, x double")
    counts = B.patient_counts(df, "site", "patient", 6, "seed")
    own = {}
    for r in counts.collect():
        own[r.site, r.rep, r.patient] = r.n
    sizes = {s: len({d[1] for d in data if d[0] == s}) for s in ("s", "e")}
    for s in sizes:
        for rep in range(6):
            assert sum(n for (a, b, _), n in own.items() if (a, b) == (s, rep)) == sizes[s]
    per = df.groupBy("site", "patient").agg(F.sum("x").alias("x"))
    for r in B.replicate_sums(per, df, "site", "patient", [], ["x"], 6, "seed").collect():
        want = sum(d[3] * own.get((d[0], r.rep, d[1]), 0) for d in data if d[0] == r.site)
        assert abs(r.x - want) < 1e-12


def test_interval_of_a_constant(spark):
    df = spark.createDataFrame([("g", 0.1)] * 50, "g string, d double")
    assert tuple(B.percentile_interval(df, ["g"], "d").first()) == ("g", 0.1, 0.1)
    with pytest.raises(Exception, match="no value"):
        B.percentile_interval(df.union(spark.createDataFrame([("g", None)], df.schema)), ["g"], "d").collect()


@pytest.mark.parametrize(
    ("point", "low", "high", "direction", "materiality", "want"),
    [
        (0.05, 0.01, 0.09, "greater", 0.02, "confirmed"),
        (0.02, 0.01, 0.03, "greater", 0.02, "confirmed"),
        (0.01, 0.001, 0.03, "greater", 0.02, "same_direction_not_material"),
        (0.05, 0.0, 0.09, "greater", 0.02, "inconclusive"),
        (-0.05, -0.09, -0.01, "greater", 0.02, "opposite_direction_material"),
        (-0.01, -0.02, -0.001, "greater", 0.02, "opposite_direction_not_material"),
        (-0.05, -0.09, -0.01, "less", 0.02, "confirmed"),
        (0.001, 0.0001, 0.01, "greater_or_equal", None, "confirmed"),
        (-0.5, -0.6, -0.4, "greater", None, "opposite_direction_not_material"),
    ],
)
def test_verdicts(spark, point, low, high, direction, materiality, want):
    df = spark.createDataFrame([(point, low, high)], "p double, a double, b double")
    assert df.select(B.verdict(F.col("p"), F.col("a"), F.col("b"), direction, materiality).alias("v")).first().v == want


def test_verdict_needs_sound_input(spark):
    for row in ((float("nan"), 0.0, 1.0), (None, 0.0, 1.0), (0.1, 1.0, 0.0), (0.1, 0.0, float("inf"))):
        df = spark.createDataFrame([row], "p double, a double, b double")
        with pytest.raises(Exception, match="finite point"):
            df.select(B.verdict(F.col("p"), F.col("a"), F.col("b"))).collect()


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("g", "a", 0.9)], "f string, n string, p double")
    assert rows(B.holm(df, ["f"], "n", "p"), "f", "n", "holm") == [("f", "a", 0.03), ("f", "b", 0.06), ("f", "c", 0.06), ("g", "a", 0.9)]


def test_role_coverage_of_odd_tables(spark):
    rows = spark.createDataFrame([("x", 1), (None, 1), ("x", None), ("1", None), (None, None)], "a string, b int")
    got = {r.role: tuple(r)[1:] for r in D.role_coverage(rows, ["a", "b"]).collect()}
    assert got == {"a": (3, 2, 0.6, 2), "b": (2, 3, 0.4, 1), "any": (4, 1, 0.8, 2)}
    assert [tuple(r) for r in D.role_coverage(rows.limit(0), ["a", "b"]).collect()] == [(k, 0, 0, None, 0) for k in ("a", "b", "any")]


def test_a_text_is_cut_once_into_plain_sections(spark):
    blank = " " * 300_000  # looked at from each of its places, a run takes hours
    text = f"before{blank}it\r\nHISTORY: a{blank}b  \nFINDINGS:\n c\nREASON FOR EXAM: d \nFIND_ING: \nFINDINGS: e"
    rows = spark.createDataFrame([(1, text), (2, " \n \nIMPRESSION: x"), (3, None), (4, " plain ")], "k int, t string")
    got = S.parse_plain(rows, "t", ["k"])
    want = {(1, "prefix"): f"before{blank}it", (1, "history"): f"a{blank}b\nd", (1, "findings"): "c\ne", (1, "find ing"): "", (2, "impression"): "x", (3, "unsectioned"): "", (4, "unsectioned"): "plain"}
    assert {(r.k, r.section): r.body for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Z /_-]") == 2 and plan.count("LogicalRDD") == 1


def test_index_summary_reads_its_rows_once(spark):
    rows = spark.createDataFrame([("a", v) for v in (5, 1, 4, 1, None)] + [("b", 7)], "s string, v int")
    got = S.index_summary(rows, ["s"], "v")
    assert sorted(map(tuple, got.select("s", "n", "mean", "median", "p95", "least", "most").collect())) == [("a", 4, 2.75, 2, 4, 1, 5), ("b", 1, 7.0, 7, 7, 7, 7)]
    assert "LogicalRDD" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_context_is_normalised_once(spark):
    texts = [None, " _ ", "of the that", "a__b c", "x" * 3 + " \t\n" + "that y-z", "é_ç  1"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = rows.withColumn("f", X.context_features("t", 3, ["of the", "that"])).select("k", "f.*")
    assert [tuple(r)[1:] for r in got.orderBy("k").collect()] == [(False, 0, False, False, "absent"), (False, 0, False, False, "absent"), (True, 3, True, False, "low_information"), (True, 3, False, True, "usable"), (True, 3, False, True, "usable"), (True, 1, True, False, "low_information")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [r[0] for r in rows.orderBy("k").select(X.normalize("t")).collect()] == ["", "", "of the that", "a b c", "xxx that y-z", "é ç 1"]
    effective = rows.select(X.effective_tokens(F.lit("a__b ___ c_d -- é _1 (x)__")))
    assert effective.first()[0] == 6
    long = spark.createDataFrame([("q", 1.0, True), ("q", 0.0, False), ("q", None, False), ("t", 0.0, True)], "label string, v double, any boolean").select("label", "v", F.struct("any").alias("direct"))
    gate = A.gate(got, long, least_pos=1).first()
    assert (gate.viable, gate.leak, gate.verdict) == (1, 1.0, "FAIL")
