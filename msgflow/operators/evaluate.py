"""Evaluation of (label, prediction) tables; one implementation for every classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_CLASSES = 1000  # columns of a matrix; the long form has no limit


def is_wrong(label: str = "label", prediction: str = "prediction") -> Column:
    return ~F.col(label).eqNullSafe(F.col(prediction))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction",
             by: list[str] | None = None) -> DataFrame:
    """accuracy and n, over the whole table or per group (for example per split)."""
    right = (~is_wrong(label, prediction)).cast("int")
    return df.groupBy(*(by or [])).agg(F.avg(right).alias("accuracy"), F.count("*").alias("n"))


def per_class(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, precision, recall, f1, support, predicted, hits) over classes seen in truth or prediction.

    Pairs are counted first; each counted pair then adds to the class it was and
    the class it was taken for.  A zero denominator gives 0.
    """
    pairs = df.groupBy(F.col(label).alias("t"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("bigint")
    as_truth = F.struct(F.col("t").alias("class"), F.col("n").alias("support"),
                        none.alias("predicted"), hit.alias("hits"))
    as_guess = F.struct(F.col("p").alias("class"), none.alias("support"),
                        F.col("n").alias("predicted"), none.alias("hits"))
    sums = (pairs.select(F.inline(F.array(as_truth, as_guess))).where(F.col("class").isNotNull())
            .groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")]))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return sums.select(
        "class",
        ratio(hits, predicted).alias("precision"),
        ratio(hits, support).alias("recall"),
        ratio(hits * 2, support + predicted).alias("f1"),
        "support", "predicted", "hits",
    )


def macro_scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy and macro precision, recall and F1."""
    return per_class(df, label, prediction).agg(
        F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
    )


def report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(position, name, precision, recall, f1, support): classes in order, then accuracy,
    macro and weighted averages.  The accuracy row has no precision and recall."""
    classes = per_class(df, label, prediction)
    total = F.sum("support")
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), total)
    none = F.lit(None).cast("double")

    def line(position: int, name: str, p: Column, r: Column, f: Column) -> Column:
        return F.struct(F.lit(position).alias("position"), F.lit(name).alias("name"), p.alias("precision"),
                        r.alias("recall"), f.alias("f1"), F.col("total").alias("support"))

    sums = classes.agg(
        total.alias("total"), F.try_divide(F.sum("hits"), total).alias("acc"),
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
    )
    averages = sums.select(F.inline(F.array(
        line(1, "accuracy", none, none, F.col("acc")),
        line(2, "macro avg", F.col("m_precision"), F.col("m_recall"), F.col("m_f1")),
        line(3, "weighted avg", F.col("w_precision"), F.col("w_recall"), F.col("w_f1")),
    )))
    rows = classes.select(F.lit(0).alias("position"), F.col("class").cast("string").alias("name"),
                          "precision", "recall", "f1", "support")
    return rows.unionByName(averages).orderBy("position", "name")


def report_lines(report_df: DataFrame, name_width: int | None = None) -> DataFrame:
    """(line_no, line): the report as aligned text with two decimals.

    A report has one row per class, so the line numbers come from a small window.
    """
    if name_width is None:
        name_width = max(12, report_df.agg(F.max(F.length("name"))).first()[0] or 0)
    cell = lambda c: F.lpad(F.coalesce(F.format_string("%.2f", F.round(c, 2)), F.lit("")), 10, " ")
    blank_or = lambda c: F.when(F.col(c).isNull(), F.lit(" " * 10)).otherwise(cell(c))
    line = F.concat(F.lpad("name", name_width, " "), F.lit(" "), blank_or("precision"), blank_or("recall"),
                    blank_or("f1"), F.lpad(F.col("support").cast("string"), 10, " "))
    number = F.row_number().over(Window.orderBy("position", "name"))
    # Blank lines stand after the header and before the averages.
    body = report_df.select((number + F.when(F.col("position") == 0, 1).otherwise(2)).alias("line_no"),
                            line.alias("line"))
    titles = "".join(f"{t:>10}" for t in ("precision", "recall", "f1-score", "support"))
    gap = report_df.agg((F.count_if(F.expr("position = 0")) + 2).cast("int").alias("line_no")).withColumn("line", F.lit(""))
    spark = report_df.sparkSession
    head = spark.createDataFrame([(0, " " * (name_width + 1) + titles), (1, "")], "line_no int, line string")
    return head.unionByName(gap).unionByName(body).orderBy("line_no")


def class_list(df: DataFrame, label: str = "label") -> list:
    """The sorted classes of a column; an error if they are too many to be classes."""
    found = [r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct()
             .limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES:
        raise ValueError(f"More than {MAX_CLASSES} classes in {label}.")
    return sorted(found)


def confusion_matrix(df: DataFrame, labels: list | None = None, label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """Dense matrix: one row per true label, one column per predicted label.

    ``labels`` defaults to the sorted true labels; rows and columns outside it are dropped.
    """
    labels = class_list(df, label) if labels is None else list(labels)
    long = confusion_pairs_dense(df, labels, label, prediction)
    order = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label"))
    wide = long.groupBy("label").pivot("prediction", labels).agg(F.first("n"))
    return wide.orderBy(order)


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n) for the pairs that occur, however many classes there are."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def confusion_pairs_dense(df: DataFrame, labels: list, label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n) for every pair of listed labels, zeros included."""
    listed = F.array(*[F.lit(x) for x in labels])
    grid = (df.sparkSession.range(1).select(F.explode(listed).alias("label"))
            .select("label", F.explode(listed).alias("prediction")))
    counts = confusion_counts(df, label, prediction)
    # A null-safe join: from a plain one Spark infers a filter on the prediction and computes it twice per row.
    same = grid["label"].eqNullSafe(counts["label"]) & grid["prediction"].eqNullSafe(counts["prediction"])
    return grid.join(counts, same, "left").select(
        grid["label"], grid["prediction"], F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def errors(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The misclassified rows, all columns."""
    return df.where(is_wrong(label, prediction))


def error_totals(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: n_wrong and n."""
    return df.agg(F.count_if(is_wrong(label, prediction)).alias("n_wrong"), F.count("*").alias("n"))


def confused_pairs(df: DataFrame, top: int = 10, label: str = "label",
                   prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n): the most frequent confusions; ties by label, then prediction."""
    return (errors(df, label, prediction).groupBy(label, prediction).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), label, prediction).limit(top))


def weighted_cross_entropy(df: DataFrame, p_true: str, weight: str | None = None,
                           floor: float = 1e-15) -> DataFrame:
    """One row: sum(w * -ln p) / sum(w) with p, the probability of the true class, kept above ``floor``."""
    w = F.col(weight) if weight else F.lit(1.0)
    loss = -F.log(F.greatest(F.col(p_true), F.lit(floor)))
    return df.agg(F.try_divide(F.sum(w * loss), F.sum(w)).alias("loss"))
