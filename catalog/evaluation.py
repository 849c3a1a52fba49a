"""Evaluation of closed-form predictors, so that SQL can follow."""

from pyspark.sql import functions as F

from catalog.preparation import SQL_SPLIT_DOCUMENTS, split_documents
from catalog.registry import query, sql_draw, sql_vote, table, vote
from msgflow.functions.draws import unit_draw
from msgflow.operators import evaluate
from msgflow.plans.evaluation import evaluate_split
from msgflow.sources.tables import save_splits
from msgflow.staging import new_path


def voted(spark, sf_dir):
    return table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]).select(
        "doc_id", "text", F.col("lang").alias("label"), vote(F.col("text")).alias("prediction"))


SQL_VOTED = f"voted AS (SELECT doc_id, text, lang AS label, {sql_vote('text')} AS prediction FROM documents)"
SQL_CLASSES = f"""{SQL_VOTED},
seen AS (SELECT label AS class, 1 AS truth, 0 AS guess, (label = prediction)::INT AS hit FROM voted
  UNION ALL SELECT prediction, 0, 1, 0 FROM voted),
sums AS (SELECT class, sum(truth)::BIGINT AS support, sum(guess)::BIGINT AS predicted, sum(hit)::BIGINT AS hits FROM seen GROUP BY class),
classes AS (SELECT class, CASE WHEN predicted = 0 THEN 0.0 ELSE hits::DOUBLE / predicted END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE hits::DOUBLE / support END AS recall,
  CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0::DOUBLE * hits / (support + predicted) END AS f1, support, predicted, hits FROM sums)"""


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("e1_accuracy", f"""
WITH {SQL_VOTED} SELECT round(avg((label = prediction)::INT), 6) AS accuracy, count(*) AS n FROM voted""")
def accuracy(spark, sf_dir):
    return _rounded(evaluate.accuracy(voted(spark, sf_dir)), "accuracy")


@query("e2_per_class", f"""
WITH {SQL_CLASSES} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  support, predicted, hits FROM classes""")
def per_class(spark, sf_dir):
    return _rounded(evaluate.per_class(voted(spark, sf_dir)), "precision", "recall", "f1")


@query("e2_macro_scores", f"""
WITH {SQL_CLASSES} SELECT round(sum(hits)::DOUBLE / sum(support)::DOUBLE, 6) AS accuracy, round(avg(precision), 6) AS macro_precision,
  round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM classes""")
def macro_scores(spark, sf_dir):
    return _rounded(evaluate.macro_scores(voted(spark, sf_dir)), "accuracy", "macro_precision", "macro_recall", "macro_f1")


@query("e2_binary_scores", """
WITH p AS (SELECT quality AS label, 1 - toxic AS prediction FROM labels),
seen AS (SELECT label AS class, 1 AS truth, 0 AS guess, (label = prediction)::INT AS hit FROM p
  UNION ALL SELECT prediction, 0, 1, 0 FROM p),
sums AS (SELECT class, sum(truth)::DOUBLE AS support, sum(guess)::DOUBLE AS predicted, sum(hit)::DOUBLE AS hits FROM seen GROUP BY class)
SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END), 6) AS macro_precision,
  round(avg(CASE WHEN support = 0 THEN 0 ELSE hits / support END), 6) AS macro_recall,
  round(avg(2 * hits / (support + predicted)), 6) AS macro_f1 FROM sums""")
def binary_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction"))
    return _rounded(evaluate.macro_scores(rows), "accuracy", "macro_precision", "macro_recall", "macro_f1")


SQL_REPORT = f"""{SQL_CLASSES},
report AS (
  SELECT 0 AS position, class AS name, precision, recall, f1, support FROM classes
  UNION ALL SELECT 1, 'accuracy', NULL, NULL, sum(hits)::DOUBLE / sum(support)::DOUBLE, sum(support)::BIGINT FROM classes
  UNION ALL SELECT 2, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM classes
  UNION ALL SELECT 3, 'weighted avg', sum(precision * support) / sum(support)::DOUBLE, sum(recall * support) / sum(support)::DOUBLE,
    sum(f1 * support) / sum(support)::DOUBLE, sum(support)::BIGINT FROM classes)"""


@query("e3_report", f"""
WITH {SQL_REPORT} SELECT position, name, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, support FROM report""")
def report(spark, sf_dir):
    return _rounded(evaluate.report(voted(spark, sf_dir)), "precision", "recall", "f1")


def _sql_cell(c):
    return f"CASE WHEN {c} IS NULL THEN repeat(' ', 10) ELSE lpad(printf('%.2f', round({c}, 2)), 10, ' ') END"


SQL_LINES = f"""{SQL_REPORT},
lines AS (
  SELECT 0 AS line_no, repeat(' ', 13) || ' precision    recall  f1-score   support' AS line
  UNION ALL SELECT 1, ''
  UNION ALL SELECT 2 + (SELECT count(*) FROM classes), ''
  UNION ALL SELECT (row_number() OVER (ORDER BY position, name)) + CASE WHEN position = 0 THEN 1 ELSE 2 END,
    lpad(name, 12, ' ') || ' ' || {_sql_cell('precision')} || {_sql_cell('recall')} || {_sql_cell('f1')} || lpad(support::VARCHAR, 10, ' ')
  FROM report)"""


@query("e3_report_lines", f"WITH {SQL_LINES} SELECT line_no::INT AS line_no, line FROM lines")
def report_lines(spark, sf_dir):
    return evaluate.report_lines(evaluate.report(voted(spark, sf_dir)))


SQL_CONFUSION = f"""{SQL_VOTED}
SELECT label, count(*) FILTER (prediction = 'de') AS de, count(*) FILTER (prediction = 'en') AS en,
  count(*) FILTER (prediction = 'es') AS es, count(*) FILTER (prediction = 'fr') AS fr FROM voted GROUP BY label"""


@query("e4_confusion_matrix", f"WITH {SQL_CONFUSION}")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(voted(spark, sf_dir))


@query("e4_fixed_labels", f"""
WITH {SQL_VOTED}, listed AS (SELECT unnest(['en', 'es', 'it']) AS l)
SELECT a.l AS label, b.l AS prediction, count(v.label) AS n FROM listed a CROSS JOIN listed b
LEFT JOIN voted v ON v.label = a.l AND v.prediction = b.l GROUP BY 1, 2""")
def fixed_labels(spark, sf_dir):
    return evaluate.confusion_pairs_dense(voted(spark, sf_dir), ["en", "es", "it"])


@query("e5_errors", f"WITH {SQL_VOTED} SELECT * FROM voted WHERE label <> prediction")
def errors(spark, sf_dir):
    return evaluate.errors(voted(spark, sf_dir))


@query("e5_error_totals", f"WITH {SQL_VOTED} SELECT count(*) FILTER (label <> prediction) AS n_wrong, count(*) AS n FROM voted")
def error_totals(spark, sf_dir):
    return evaluate.error_totals(voted(spark, sf_dir))


@query("e6_confused_pairs", f"""
WITH {SQL_VOTED} SELECT label, prediction, count(*) AS n FROM voted WHERE label <> prediction
GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10""")
def confused_pairs(spark, sf_dir):
    return evaluate.confused_pairs(voted(spark, sf_dir), 10)


@query("f8_weighted_cross_entropy", f"""
WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
p AS (SELECT {sql_draw(7, 'p', 'event_id')} / 4294967296.0::DOUBLE AS p,
  (SELECT sum(n)::DOUBLE FROM n) / ((SELECT count(*) FROM n) * n.n) AS w FROM events e JOIN n ON e.event_type = n.event_type)
SELECT round(sum(w * -ln(greatest(p, 1e-15::DOUBLE))) / sum(w), 6) AS loss FROM p""")
def weighted_cross_entropy(spark, sf_dir):
    from msgflow.operators.features import class_weights

    events = table(spark, sf_dir, "events").select("event_type", unit_draw(7, "p", F.col("event_id")).alias("p"))
    weights = class_weights(events, "event_type").select("event_type", F.col("weight").alias("w"))
    return _rounded(evaluate.weighted_cross_entropy(events.join(weights, "event_type"), "p", "w"), "loss")


@query("f13_split_accuracy", f"""
WITH {SQL_SPLIT_DOCUMENTS} SELECT split, round(avg((lang = {sql_vote('text')})::INT), 6) AS accuracy, count(*) AS n
FROM split_rows GROUP BY split""")
def split_accuracy(spark, sf_dir):
    rows = split_documents(spark, sf_dir).withColumn("prediction", vote(F.col("text")))
    return _rounded(evaluate.accuracy(rows, "lang", "prediction", by=["split"]), "accuracy")


# -------------------------------------------------------------- one pass for all


SQL_HELD_OUT = SQL_REPORT.replace(SQL_VOTED, f"""{SQL_SPLIT_DOCUMENTS},
voted AS (SELECT doc_id, text, lang AS label, {sql_vote('text')} AS prediction FROM split_rows WHERE split = 'test')""")


@query("evaluate_held_out", f"""
WITH {SQL_HELD_OUT} SELECT position, name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support,
  (SELECT count(*) FROM voted WHERE label <> prediction) AS n_wrong,
  (SELECT count(*) FROM (SELECT DISTINCT label FROM voted)) + 1 AS matrix_lines,
  (SELECT count(*) FROM report) + 3 AS report_lines FROM report""")
def held_out(spark, sf_dir):
    """The saved test split, scored once: report, matrix and errors, and the files written from them."""
    splits, output = new_path(spark, "held-out"), new_path(spark, "evaluation")
    save_splits(split_documents(spark, sf_dir), splits)
    found = evaluate_split(spark, splits, lambda rows: rows.select(
        "doc_id", "text", F.col("lang").alias("label"), vote(F.col("text")).alias("prediction")), output)
    wrong = found.totals.first()["n_wrong"]
    lines = {name: spark.read.text(f"{output}/{name}").count() for name in ("confusion_matrix", "report")}
    return _rounded(found.report, "precision", "recall", "f1").withColumns({
        "n_wrong": F.lit(wrong).cast("bigint"), "matrix_lines": F.lit(lines["confusion_matrix"]).cast("bigint"),
        "report_lines": F.lit(lines["report"]).cast("bigint")})
