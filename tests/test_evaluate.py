import math

import pytest
from pyspark.sql import functions as F

from msgflow.operators import evaluate as E

ROWS = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("b", "x")] + [("c", "a")] * 2 + [("c", None)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(ROWS)], "id long, label string, prediction string")


def plain_scores():
    found = {}
    for c in {"a", "b", "c", "x"}:
        tp = sum(t == p == c for t, p in ROWS)
        said, is_c = sum(p == c for _, p in ROWS), sum(t == c for t, _ in ROWS)
        found[c] = (tp / said if said else 0, tp / is_c if is_c else 0, 2 * tp / (said + is_c), is_c)
    return found


def test_per_class_and_macro(df):
    want = plain_scores()
    got = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in E.per_class(df).collect()}
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == pytest.approx(want[c])
    macro = E.macro_scores(df).first()
    assert macro.accuracy == pytest.approx(8 / 14)
    for i, name in enumerate(("macro_precision", "macro_recall", "macro_f1")):
        assert macro[name] == pytest.approx(sum(v[i] for v in want.values()) / 4)
    assert E.accuracy(df).first().accuracy == pytest.approx(8 / 14)
    assert tuple(E.error_totals(df).first()) == (6, 14)
    assert E.errors(df).count() == 6


def test_report_text(df):
    lines = [r.line for r in E.report_lines(E.report(df)).orderBy("line_no").collect()]
    assert lines[0] == "              precision    recall  f1-score   support".replace("precision", "precision")
    assert lines[1] == "" and lines[6] == ""
    assert lines[2] == "           a       0.71      0.71      0.71         7"
    assert lines[7] == "    accuracy                           0.57        14"
    assert lines[9].startswith("weighted avg") and len(lines) == 10


def test_confusion(df):
    wide = [tuple(r) for r in E.confusion_matrix(df).collect()]
    assert wide == [("a", 5, 2, 0), ("b", 0, 3, 0), ("c", 2, 0, 0)]
    order = [r.label for r in E.confusion_matrix(df, ["c", "a", "x"]).collect()]
    assert order == ["c", "a", "x"]
    assert [tuple(r) for r in E.confused_pairs(df, 2).collect()] == [("a", "b", 2), ("c", "a", 2)]


def test_cross_entropy(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.25, 3.0), (0.0, 1.0)], "p double, w double")
    want = (math.log(2) + 3 * math.log(4) - math.log(1e-15)) / 5
    assert E.weighted_cross_entropy(df, "p", "w").first().loss == pytest.approx(want)


def test_published_matrices_recompute(spark):
    """Scores of a 3 x 3 matrix of counts, computed from counted pairs."""
    counts = {("n", "n"): 1050, ("n", "u"): 23, ("n", "p"): 7, ("u", "n"): 6, ("u", "u"): 57, ("u", "p"): 3,
              ("p", "n"): 4, ("p", "u"): 3, ("p", "p"): 847}
    df = spark.createDataFrame([(t, p, n) for (t, p), n in counts.items()], "label string, prediction string, n int")
    rows = df.select("label", "prediction", F.explode(F.sequence(F.lit(1), "n")))
    got = E.macro_scores(rows).first()
    assert [round(got[i], 4) for i in range(4)] == [0.977, 0.8885, 0.9426, 0.9122]
