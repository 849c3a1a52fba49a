"""Preparing labelled text: cleaning, label maps, dedupe, ids, splits, augmentation, leakage."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from msgflow import values
from msgflow.functions.draws import draw, rank_key, unit_draw
from msgflow.functions.text import clean_intent_text, clean_language_text, normalise_placeholders, words
from msgflow.staging import new_path, stage

SPLIT_BUCKETS = 4  # hex digits: 65,536 buckets per class

# ------------------------------------------------------------------ cleaning


def computed_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a costly column that a later filter does not make Spark compute again.

    A filter moves below a projection and takes a copy of its expressions along;
    it stays above a generator.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))


def clean_rows(df: DataFrame, text: str = "text",
               cleaner: Callable[[Column], Column] = clean_language_text,
               observation: Observation | None = None) -> DataFrame:
    """Clean a column and drop rows it leaves empty.

    ``observation`` receives ``n_dropped`` when the result is first used.
    """
    cleaned = computed_once(df, "_cleaned", cleaner(F.col(text))).withColumn(text, F.col("_cleaned")).drop("_cleaned")
    if observation is not None:
        cleaned = cleaned.observe(observation, F.count_if(F.length(text) == 0).alias("n_dropped"))
    return cleaned.where(F.length(text) > 0)


# ---------------------------------------------------------------- label maps


def mapped(column: Column, mapping: Mapping) -> Column:
    """Look a value up in a fixed map; null when it is not there."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.element_at(F.create_map(*pairs), column)


def map_emotions(df: DataFrame, raw_id: str = "label") -> DataFrame:
    """Raw id -> emotion -> sentiment -> sentiment id; an unmapped id gives nulls."""
    return (df.withColumn("emotion", mapped(F.col(raw_id).cast("int"), dict(enumerate(values.EMOTIONS))))
            .withColumn("sentiment", mapped(F.col("emotion"), values.EMOTION_SENTIMENT))
            .withColumn("sentiment_id", sentiment_id(F.col("sentiment"))))


def sentiment_id(sentiment: Column) -> Column:
    return mapped(sentiment, {name: i for i, name in enumerate(values.SENTIMENTS)})


def unmapped_values(df: DataFrame, raw: str, mapping: Mapping) -> DataFrame:
    """The distinct values of ``raw`` that the map does not cover, null among them."""
    return df.where(mapped(F.col(raw), mapping).isNull()).select(raw).distinct()


def map_intents(df: DataFrame, raw: str = "intent",
                mapping: Mapping[str, str] = values.RAW_INTENT_ROUTING,
                output: str = "routing_intent") -> DataFrame:
    """Map raw to routing intents; raise if there are unmapped values.

    The error names the first ones and a table that lists them all in order.
    """
    missing = unmapped_values(df, raw, mapping)
    if not missing.isEmpty():
        path = new_path(df.sparkSession, "unmapped-values")
        missing.orderBy(raw).write.parquet(path)
        listed = df.sparkSession.read.parquet(path)
        first = [r[0] for r in listed.orderBy(raw).limit(20).collect()]
        raise ValueError(f"No routing intent for {listed.count()} raw values, the first of them {first}; "
                         f"all are listed in {path}. Extend the map.")
    return df.withColumn(output, mapped(F.col(raw), mapping))


# -------------------------------------------------------------------- dedupe


def digest(text: Column) -> Column:
    """32 bytes that stand for a text wherever texts are only compared; null for null."""
    return F.unhex(F.sha2(text.cast("string").cast("binary"), 256))


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows with the same ``key`` keep the one that comes first in ``order``, which is not null.

    Copies collapse to a digest and the first place before the shuffle, so a text
    that fills a third of the table costs no more than any other; the rows are
    then met by digest and place, which spreads copies over all tasks.  Of rows
    that share key and place any one stays.
    """
    keyed = df.withColumn("_key", F.coalesce(digest(F.col(key)), F.lit(b"").cast("binary")))
    first = keyed.groupBy("_key").agg(F.min(order).alias(order))
    return keyed.join(first, ["_key", order], "left_semi").dropDuplicates(["_key", order]).select(*df.columns)


def duplicate_counts(df: DataFrame, key: str) -> DataFrame:
    """One row: rows before, rows after and rows dropped by ``keep_first``."""
    return (df.groupBy(digest(F.col(key))).agg(F.count("*").alias("n"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_before"), F.count("*").alias("n_after"))
            .withColumn("n_dropped", F.col("n_before") - F.col("n_after")))


def dense_ids(df: DataFrame, order: list[str], output: str = "doc_id") -> DataFrame:
    """Number the rows 0, 1, 2, ... in ``order`` without bringing them into one task.

    The sorted table is staged with each row's partition and place, so the
    numbers do not change when a task is run again.
    """
    placed = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_at", F.monotonically_increasing_id()))
    placed = stage(placed, "dense-ids").withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort: bounded by the partition count.
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return (placed.join(F.broadcast(starts), "_part")
            .select((F.col("_start") + place).alias(output), *df.columns))


def build_knowledge_base(pairs: DataFrame, order: str = "id") -> DataFrame:
    """Pairs with distinct cleaned questions, numbered densely in ``order``."""
    keyed = pairs.withColumn("_clean", clean_intent_text(F.col("instruction")))
    kept = keep_first(keyed, "_clean", order).select(order, "instruction", "response", "intent", "category")
    return dense_ids(kept, [order]).drop(order)


# -------------------------------------------------------------------- splits


def _shared_out(sizes: DataFrame, n: str, wanted: int, total: int, output: str) -> DataFrame:
    """Add each class's share of ``wanted`` rows: largest remainder, ties by label.

    ``sizes`` has one row per class, and so have its two windows.
    """
    exact = F.lit(wanted).cast("decimal(38,0)") * F.col(n).cast("decimal(18,0)")
    rest = exact % F.lit(total).cast("decimal(38,0)")
    sizes = sizes.withColumn("_rest", rest).withColumn("_base", ((exact - rest) / F.lit(total)).cast("bigint"))
    everyone = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(wanted) - F.sum("_base").over(everyone)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), "_label"))
    return sizes.withColumn(output, F.col("_base") + (place <= left).cast("bigint")).drop("_base", "_rest")


def split_quotas(sizes: DataFrame, total: int, test_size: float, val_size: float) -> DataFrame:
    """(_label, _n) with ``_test`` and ``_val``, the rows of each class that go to test and validation."""
    n_test = math.ceil(test_size * total)
    out = _shared_out(sizes, "_n", n_test, total, "_test").withColumn("_left", F.col("_n") - F.col("_test"))
    n_val = math.ceil(val_size / (1 - test_size) * (total - n_test))
    return _shared_out(out, "_left", n_val, total - n_test, "_val").drop("_left")


def stratified_split(df: DataFrame, id_col: str, label: str, test_size: float = 0.15,
                     val_size: float = 0.15, seed: int = 42) -> DataFrame:
    """Add ``split`` (train, val or test) with exact quotas per class, however many classes there are.

    Rows of a class are ordered by a seeded hash; the first go to test, the next
    to validation.  Only the two cut points of each class are computed: counts
    per (class, hash bucket) find the bucket, and only that bucket's rows are
    ordered.  The cut points are a staged table of one row per class, which Spark
    broadcasts if its files are small; then the table itself is not shuffled.
    """
    keyed = df.select(F.col(label).alias("_label"), F.col(id_col).alias("_id"),
                      rank_key(seed, F.col(id_col)).alias("_key"))
    keyed = keyed.withColumn("_bucket", F.substring("_key", 1, SPLIT_BUCKETS))
    counts = stage(keyed.groupBy("_label", "_bucket").agg(F.count("*").alias("_n")), "split-counts")

    sizes = stage(counts.groupBy("_label").agg(F.sum("_n").alias("_n")), "split-sizes")
    seen = sizes.agg(F.sum("_n").alias("total"), F.count_if(F.col("_label").isNull()).alias("unlabelled"),
                     F.count_if(F.col("_n") < 2).alias("single")).first()
    if seen["unlabelled"]:
        raise ValueError(f"Rows without a {label} cannot be stratified.")
    if seen["single"]:
        raise ValueError(f"Every {label} needs at least 2 rows to be stratified.")
    quotas = split_quotas(sizes, seen["total"] or 0, test_size, val_size) if seen["total"] else sizes.select(
        "*", F.lit(0).alias("_test"), F.lit(0).alias("_val"))

    marks = F.array(F.struct(F.lit("test").alias("_part"), F.col("_test").alias("_place")),
                    F.struct(F.lit("val").alias("_part"), (F.col("_test") + F.col("_val")).alias("_place")))
    places = stage(quotas.select("_label", F.inline(marks)).where("_place > 0"), "split-places")
    so_far = F.sum("_n").over(Window.partitionBy("_label").orderBy("_bucket")
                              .rowsBetween(Window.unboundedPreceding, 0))
    upto = counts.withColumn("_upto", so_far).join(places, "_label")
    cut_buckets = upto.where((F.col("_upto") >= F.col("_place")) & (F.col("_upto") - F.col("_n") < F.col("_place")))
    cut_buckets = stage(cut_buckets.select("_label", "_bucket", "_part",
                                           (F.col("_place") - F.col("_upto") + F.col("_n")).alias("_rank")),
                        "split-buckets")
    in_bucket = Window.partitionBy("_label", "_part").orderBy("_key", "_id")
    cuts = (keyed.join(cut_buckets, ["_label", "_bucket"])  # at most two rows per class
            .withColumn("_row", F.row_number().over(in_bucket)).where("_row = _rank")
            .groupBy("_label").pivot("_part", ["test", "val"])
            .agg(F.first(F.struct("_key", "_id"))))
    cuts = stage(cuts, "split-cuts")
    place = F.struct(rank_key(seed, F.col(id_col)).alias("_key"), F.col(id_col).alias("_id"))
    split = F.when(place <= F.col("test"), "test").when(place <= F.col("val"), "val").otherwise("train")
    return (df.join(cuts, df[label] == cuts["_label"], "left")  # one row per class
            .select(*[df[c] for c in df.columns], split.alias("split")))


# -------------------------------------------------------------- augmentation


def add_training_examples(split_df: DataFrame, examples: DataFrame,
                          constants: Mapping[str, str] | None = None) -> DataFrame:
    """Append hand-written rows to the train split only; columns they lack become null."""
    extra = examples.withColumn("split", F.lit("train"))
    for name, value in (constants or {}).items():
        extra = extra.withColumn(name, F.lit(value))
    return split_df.unionByName(extra, allowMissingColumns=True)


def short_spans(df: DataFrame, id_col: str, text: str = "text", label: str = "label",
                spans_per_row: int = 1, min_words: int = 2, max_words: int = 6,
                seed: int = 42, start_share: float = 0.6) -> DataFrame:
    """Cut short word spans from longer texts: (id, span_no, text, label).

    A row needs more than ``min_words`` words.  The length is uniform up to
    ``max_words``; with probability ``start_share`` the span begins the text.
    """
    parts = computed_once(df, "_words", words(F.col(text))).select(id_col, label, "_words")
    parts = parts.where(F.size("_words") > min_words)
    parts = parts.withColumn("span_no", F.explode(F.sequence(F.lit(1), F.lit(spans_per_row))))
    key = [F.col(id_col), F.col("span_no")]
    n = F.size("_words")
    longest = F.least(F.lit(max_words), n)
    length = (F.lit(min_words) + draw(seed, "length", *key) % (longest - min_words + 1)).cast("int")
    parts = parts.withColumn("_len", length)
    inside = (draw(seed, "start", *key) % (n - F.col("_len") + 1)).cast("int")
    begin = F.when(unit_draw(seed, "front", *key) < start_share, F.lit(0)).otherwise(inside)
    span = F.array_join(F.slice("_words", begin + 1, F.col("_len")), " ")
    return parts.select(id_col, "span_no", span.alias(text), label)


# ------------------------------------------------------------------- leakage


def split_uniqueness(df: DataFrame, text: str = "text", split: str = "split") -> DataFrame:
    """(split, n_rows, n_texts).  Copies collapse per (split, text) before the final count."""
    per_text = df.groupBy(split, digest(F.col(text)).alias("_key")).agg(F.count("*").alias("_n"))
    return per_text.groupBy(split).agg(F.sum("_n").alias("n_rows"), F.count("_key").alias("n_texts"))


def shared_texts(left: DataFrame, right: DataFrame, text: str = "text") -> DataFrame:
    """The distinct texts that both tables hold."""
    key = digest(F.col(text)).alias("_key")
    shared = left.select(key).distinct().join(right.select(key).distinct(), "_key", "left_semi")
    return left.select(text, key).join(shared, "_key", "left_semi").dropDuplicates(["_key"]).select(text)


def split_overlap(df: DataFrame, text: str = "text", split: str = "split") -> DataFrame:
    """One row: exact texts shared by train and test, and by train and validation."""
    seen = df.groupBy(digest(F.col(text))).agg(*[F.max((F.col(split) == s).cast("int")).alias(s)
                                                 for s in ("train", "val", "test")])
    return seen.agg(F.count_if(F.expr("train = 1 AND test = 1")).alias("train_test"),
                    F.count_if(F.expr("train = 1 AND val = 1")).alias("train_val"))


def template_overlap(df: DataFrame, text: str = "text", split: str = "split") -> DataFrame:
    """One row: templates (placeholders normalised) in train, in test and in both, and the
    shared share of test templates in percent; null when test is empty."""
    templates = df.where(F.col(split).isin("train", "test"))
    templates = templates.withColumn("_key", digest(normalise_placeholders(F.col(text))))
    seen = templates.groupBy("_key").agg(*[F.max((F.col(split) == s).cast("int")).alias(s)
                                           for s in ("train", "test")])
    totals = seen.agg(F.count_if(F.expr("train = 1")).alias("train_templates"),
                      F.count_if(F.expr("test = 1")).alias("test_templates"),
                      F.count_if(F.expr("train = 1 AND test = 1")).alias("shared_templates"))
    share = F.try_divide(F.col("shared_templates") * 100.0, F.col("test_templates"))
    return totals.withColumn("shared_percent", F.round(share, 1))
