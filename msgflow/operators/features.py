"""TF-IDF features and class weights."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark import Broadcast
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from msgflow.functions.terms import char_terms, once, sparse_vector, vector_parts, word_terms
from msgflow.staging import stage

LOCAL_TERMS = 1 << 22  # weights (16 bytes each) that every executor may hold
ROWS_AT_ONCE = 4096    # rows whose terms a task counts at a time
CHARS_AT_ONCE = 1 << 19  # bytes of texts whose n-grams a task counts at a time, or one text if that is longer
HEAVY = 256            # a term is hot if it makes up this part of all or more, so there are at most so many


@dataclass(frozen=True)
class TermRule:
    """How texts become terms and which terms make up the vocabulary."""

    analyzer: str                # "char" or "word"
    max_n: int
    max_features: int
    min_df: int = 1
    sublinear: bool = False      # 1 + ln(tf) in place of tf
    max_words: int | None = None

    def terms(self, text: Column) -> Column:
        if self.analyzer == "char":
            return char_terms(text, 1, self.max_n)
        return word_terms(text, self.max_n, self.max_words)


LANGUAGE_TERMS = TermRule("char", max_n=3, max_features=50_000, sublinear=True)
#: Retrieval keeps every term: one that stands in a single question tells most.
RETRIEVAL_TERMS = TermRule("word", max_n=2, max_features=0, min_df=1)
INTENT_TERMS = TermRule("word", max_n=2, max_features=20_000, min_df=2)
SENTIMENT_TERMS = TermRule("word", max_n=2, max_features=20_000, min_df=2)


def term_counts(df: DataFrame, text: str, rule: TermRule) -> DataFrame:
    """(term, total, n_docs) over the corpus.

    Each task adds up some texts at a time, so one map-side aggregation of few rows
    serves both and neither texts nor (document, term) pairs are shuffled.
    """
    counted = _counted(df, text, rule)
    return counted.groupBy("term").agg(F.sum("tf").alias("total"), (F.count("*") + F.sum("more")).alias("n_docs"))


def _batch_counter(rule: TermRule, index: dict | None = None) -> Callable:
    """words of each row -> (first row, number of rows, row, term, count, names) of some rows at a time, by row and term.

    ``words`` is a list column of tokens ("word") or a lowered text ("char"; white space is what
    Python's ``split`` and ``collapse_spaces`` know). The counts are those of :meth:`TermRule.terms`.
    A term is a place in ``names``, the terms met; with an ``index`` {term: number} other terms are
    left out and ``names`` holds the numbers, ascending.
    """
    n_grams, chars, cells, at_once = rule.max_n, rule.analyzer == "char", 1 << 22, CHARS_AT_ONCE
    table = np.zeros(0x110000, np.int32)  # code points to places in the alphabet of some rows
    white = np.array([chr(i).isspace() for i in range(0x3001)])

    def distinct(row, key, n_rows, wide):
        """Counts of the distinct pairs of row and key."""
        both = row.astype(np.int64) * wide + key
        if 16 * len(both) < n_rows * wide or n_rows * wide > 4 * cells:
            both.sort()
            first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
            both, tf = both[first], np.diff(np.r_[first, len(both)])
        else:
            tf = np.bincount(both, minlength=n_rows * wide)
            both = np.flatnonzero(tf)
            tf = tf[both]
        return both // wide, both % wide, tf

    def numbered(key, space):
        """(the distinct keys, the place of each key among them)"""
        if space > max(cells, 8 * len(key)):
            return np.unique(key, return_inverse=True)
        seen = np.zeros(space, bool)
        seen[key] = True
        keys = np.flatnonzero(seen)
        place = np.empty(space, np.int32)
        place[keys] = np.arange(len(keys), dtype=np.int32)
        return keys, place[key]

    def grams(code, group, row, names, space):
        """Runs of neighbours in one group: a run of n is numbered by the run before and the one after it."""
        rows, keys, every, run, last = [row], [code], list(names), code.copy(), names
        for n in range(2, n_grams + 1):
            at = np.flatnonzero(group[n - 1:] == group[:max(0, len(group) - n + 1)])
            found, own = numbered(run[at].astype(np.int64) * len(names) + code[at + n - 1], max(1, len(last) * len(names)))
            before, after = (found // max(1, len(names))).tolist(), (found % max(1, len(names))).tolist()
            last = [f"{last[a]}{space}{names[b]}" for a, b in zip(before, after)]
            run[at] = own
            rows.append(row[at])
            keys.append(own + len(every))
            every += last
        return np.concatenate(rows), np.concatenate(keys), every

    def counted(row, key, names, n_rows):
        if index is not None:
            number = np.array([index.get(t, -1) for t in names], np.int64)
            names = np.unique(number[number >= 0])
            place = np.where(number >= 0, np.searchsorted(names, number), -1)
            key = place[key] if len(place) else key
            row, key = row[key >= 0], key[key >= 0]
        return (*distinct(row, key, n_rows, max(1, len(names))), names)

    def of_words(words):
        import pyarrow.compute as pc

        lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(words).dictionary_encode()
        row = np.repeat(np.arange(len(lengths)), lengths)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        yield 0, len(lengths), *counted(*grams(code, row, row, coded.dictionary.to_pylist(), " "), len(lengths))

    def of_chars(texts):
        import pyarrow as pa

        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + at_once, side="right")) - 1)
            plain = texts.buffers()[2][ends[at]:ends[stop]].to_pybytes() if ends[stop] > ends[at] else b""
            begins = np.r_[0, np.cumsum((np.frombuffer(plain, np.uint8) & 0xC0) != 0x80)][ends[at:stop + 1] - ends[at]]
            point = np.frombuffer(plain.decode().encode("utf-32-le"), np.uint32)
            place = np.flatnonzero(~white[np.minimum(point, len(white) - 1)] | (point >= len(white)))
            point, row = point[place], np.repeat(np.arange(stop - at), np.diff(begins))[place]
            first = np.ones(len(place), bool)
            first[1:] = (place[1:] != place[:-1] + 1) | (row[1:] != row[:-1])
            word = np.cumsum(first) - 1
            n_words = int(word[-1]) + 1 if len(word) else 0
            letters = np.flatnonzero(np.bincount(point)) if len(point) else np.zeros(0, np.int64)
            table[letters] = np.arange(1, len(letters) + 1)
            code = np.zeros(len(point) + 2 * n_words, np.int64)  # every word with a space on each side
            code[np.arange(len(point)) + 2 * word + 1] = table[point]
            sizes = np.diff(np.r_[np.flatnonzero(first), len(point)]) + 2
            group = np.repeat(np.arange(n_words), sizes)
            row = np.repeat(row[first], sizes)
            names = [" ", *map(chr, letters.tolist())]
            yield at, stop - at, *counted(*grams(code, group, row, names, ""), stop - at)
            at = stop

    return of_chars if chars else of_words


def _words(text: Column, rule: TermRule) -> Column:
    """What :func:`_batch_counter` counts."""
    return F.lower(F.coalesce(text, F.lit(""))) if rule.analyzer == "char" else word_terms(text, 1, rule.max_words)


def _counted(df: DataFrame, text: str, rule: TermRule) -> DataFrame:
    """(term, tf, more): a row stands for the first of some texts that hold the term, and for ``more`` others."""
    make, names = _batch_counter, ["term", "tf", "more"]

    def run(batches):
        import pyarrow as pa

        count = make(rule)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                for _, _, _, term, tf, terms in count(batch.column(0).slice(at, ROWS_AT_ONCE)):
                    total, n = np.bincount(term, tf, len(terms)).astype(np.int64), np.bincount(term, minlength=len(terms))
                    met = pa.array(n > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t).filter(met) for x, t in ((terms, pa.string()), (total, pa.int64()), (n - 1, pa.int64()))], names)

    return df.select(_words(F.col(text), rule).alias("_words")).mapInArrow(run, "term string, tf long, more long")


def fit_terms(df: DataFrame, text: str, rule: TermRule, n_rows: int | None = None) -> DataFrame:
    """The vocabulary, staged: (idx, term, total, n_docs, idf).

    Terms in fewer than ``min_df`` texts go first, then the ``max_features`` of
    the highest total stay, ties by term; idx follows the term order.
    """
    n_rows = df.select(F.count("*")).scalar() if n_rows is None else F.lit(n_rows)
    top = (term_counts(df, text, rule).where(F.col("n_docs") >= rule.min_df)
           .orderBy(F.desc("total"), "term").limit(rule.max_features))
    # At most max_features rows are left for this window.
    idx = (F.row_number().over(Window.orderBy("term")) - 1).alias("idx")
    idf = (F.log((F.lit(1.0) + n_rows) / (F.lit(1.0) + F.col("n_docs"))) + 1.0).alias("idf")
    return stage(top.select(idx, "term", "total", "n_docs", idf), "terms")


class TfIdf:
    """A fitted vocabulary that turns texts into unit vectors, row by row and without a shuffle."""

    def __init__(self, rule: TermRule, vocabulary: DataFrame):
        self.rule = rule
        self.vocabulary = vocabulary
        rows = vocabulary.orderBy("idx").select("term", "idf").collect()  # at most max_features rows
        if not rows:
            raise ValueError("Empty vocabulary: no term passes min_df.")
        self.terms = [r["term"] for r in rows]
        self._idf = np.array([r["idf"] for r in rows])
        self._weigher = ElementwiseProduct(scalingVec=Vectors.dense(self._idf), inputCol="_counts", outputCol="_weighted")

    @classmethod
    def fit(cls, df: DataFrame, text: str, rule: TermRule, n_rows: int | None = None) -> TfIdf:
        return cls(rule, fit_terms(df, text, rule, n_rows))

    @cached_property
    def _counter(self) -> CountVectorizerModel:
        """Built once; the terms go to the JVM as one text, which is as ``from_vocabulary`` but not with a call for each term."""
        context = self.vocabulary.sparkSession.sparkContext
        met = set("".join(self.terms))
        between = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in met)
        terms = context._jvm.java.util.regex.Pattern.compile(between).split(between.join(self.terms), -1)
        model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", terms)
        model.setInputCol("_terms").setOutputCol("_counts")
        return model._set(vocabSize=len(self.terms))

    def vectors(self, df: DataFrame, text: str, output: str = "features") -> DataFrame:
        """Add the TF-IDF vector (Spark ML, sparse, L2 norm 1 or no terms at all)."""
        out = self._counter.transform(df.withColumn("_terms", self.rule.terms(F.col(text))))
        if self.rule.sublinear:
            out = out.withColumn("_parts", vector_parts(F.col("_counts")))
            damped = F.transform("_parts.values", lambda tf: F.lit(1.0) + F.log(tf))
            out = out.withColumn("_counts", sparse_vector(F.col("_parts.size"), F.col("_parts.indices"), damped))
        out = Normalizer(p=2.0, inputCol="_weighted", outputCol=output).transform(self._weigher.transform(out))
        return out.drop("_terms", "_counts", "_parts", "_weighted")

    def arrays(self, df: DataFrame, text: str, output: str = "embedding") -> DataFrame:
        """Add the same vector as struct(indices, values)."""
        out = self.vectors(df, text, "_vector").withColumn("_parts", vector_parts(F.col("_vector")))
        return (out.withColumn(output, F.struct(F.col("_parts.indices").alias("indices"),
                                                F.col("_parts.values").alias("values")))
                .drop("_vector", "_parts"))

    @cached_property
    def _at_hand(self) -> Broadcast:
        """({term: idx}, idf), at most max_features of them."""
        return self.vocabulary.sparkSession.sparkContext.broadcast(({t: i for i, t in enumerate(self.terms)}, self._idf))

    def _in_batches(self, df: DataFrame, text: str, kept: list[str], schema: T.StructType, made: Callable) -> DataFrame:
        """``made(kept columns, number of rows, row, idx, weight)`` of some rows at a time, for tables that are written whole.

        The weights are those of :meth:`vectors`; words are taken apart once for each task, not for each text.
        """
        rule, weights, make, at_once = self.rule, self._at_hand, _batch_counter, ROWS_AT_ONCE

        def run(batches):
            index, idf = weights.value
            count = make(rule, index)
            for batch in batches:
                for at in range(0, batch.num_rows, at_once):
                    some = batch.slice(at, at_once)
                    for first, n, row, idx, tf, numbers in count(some.column(len(kept))):
                        idx = numbers[idx]
                        weight = (1.0 + np.log(tf) if rule.sublinear else tf) * idf[idx]
                        norm = np.sqrt(np.bincount(row, weight * weight, n))
                        yield made(some.slice(first, n).columns[:len(kept)], n, row, idx, weight / norm[row])

        return df.select(*kept, _words(F.col(text), rule).alias("_words")).mapInArrow(run, schema)

    def written_vectors(self, df: DataFrame, text: str, kept: list[str], output: str = "features") -> DataFrame:
        """The columns ``kept`` and the vectors of :meth:`vectors`, made in batches."""
        fields = [df.schema[c] for c in kept]
        schema = T.StructType([*fields, T.StructField(output, VectorUDT())])
        size, names = len(self.terms), schema.names

        def made(columns, n, row, idx, weight):
            import numpy as np
            import pyarrow as pa

            offsets = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
            vector = pa.StructArray.from_arrays(
                [pa.array(np.zeros(n), pa.int8()), pa.array(np.full(n, size), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(idx, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(weight, pa.float64()))], ["type", "size", "indices", "values"])
            return pa.RecordBatch.from_arrays([*columns, vector], names)

        return self._in_batches(df, text, kept, schema, made)

    def long(self, df: DataFrame, id_col: str, text: str) -> DataFrame:
        """(id, term, weight): the sparse matrix as a table."""
        schema = T.StructType([df.schema[id_col], T.StructField("idx", T.IntegerType()), T.StructField("weight", T.DoubleType())])
        names = schema.names

        def made(columns, n, row, idx, weight):
            import pyarrow as pa

            return pa.RecordBatch.from_arrays([columns[0].take(pa.array(row)), pa.array(idx, pa.int32()), pa.array(weight, pa.float64())], names)

        pairs = self._in_batches(df, text, [id_col], schema, made)
        # The vocabulary is bounded by max_features.
        return pairs.join(F.broadcast(self.vocabulary.select("idx", "term")), "idx").select(id_col, "term", "weight")


class TermWeights:
    """The idf of every term of a corpus as a table, for TF-IDF without a vocabulary limit.

    A term's index is its 64-bit hash, so nothing is cut (``max_features`` and ``min_df``
    of the rule are not looked at); two terms share an index with a chance of about
    n * n / 2^65.  The table is counted once: up to ``local_terms`` rows of 16 bytes go to
    every executor and texts are weighed row by row; a larger one is met in a join that
    sets the hot terms apart.  Both ways give the same vectors.
    """

    def __init__(self, rule: TermRule, vocabulary: DataFrame, local_terms: int = LOCAL_TERMS):
        self.rule = rule
        self.vocabulary = vocabulary  # idx, term, n_docs, idf
        self.local_terms = local_terms

    @classmethod
    def fit(cls, df: DataFrame, text: str, rule: TermRule = RETRIEVAL_TERMS, local_terms: int = LOCAL_TERMS) -> TermWeights:
        n_rows = df.select(F.count("*")).scalar()
        idf = (F.log((F.lit(1.0) + n_rows) / (F.lit(1.0) + F.col("n_docs"))) + 1.0).alias("idf")
        counts = term_counts(df, text, rule).groupBy(F.xxhash64("term").alias("idx")).agg(
            F.min("term").alias("term"), F.sum("n_docs").alias("n_docs"))
        return cls(rule, stage(counts.select("idx", "term", "n_docs", idf), "term-weights"), local_terms)

    @cached_property
    def _local(self) -> Broadcast | None:
        """All weights, if the table is small."""
        if self.vocabulary.count() > self.local_terms:
            return None
        return _weights_at_hand(self.vocabulary)

    def arrays(self, df: DataFrame, text: str, output: str = "embedding",
               hold: Callable[[DataFrame, str], DataFrame] = stage) -> DataFrame:
        """Add the TF-IDF vector of unit length as struct(indices, values); empty arrays if no term is known.

        ``hold`` keeps the numbered rows if the table of weights is large, see :meth:`_joined`.
        """
        terms = F.transform(self.rule.terms(F.col(text)), lambda t: F.xxhash64(t))
        if self._local is not None:
            weighed = _weighed(df.withColumn("_terms", terms), self._local)
            return weighed.withColumn(output, unit(F.col("_vector"))).drop("_vector")
        return self._joined(df.withColumn("_terms", terms), output, hold)

    def _joined(self, df: DataFrame, output: str, hold: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
        """Heavy and light terms apart: the weights of the few hot terms go to every executor, the others are met in a hash join.

        A sketch over the rows' terms names the hot ones, at most HEAVY of them.  So a term
        that stands in every row is never a key of the shuffle, and each light one takes a
        small part of a task.
        """
        rows = hold(df.withColumn("_row", F.monotonically_increasing_id()), "weighted-rows")
        heavy = self.heavy_terms(rows)
        rows = _weighed(rows, _weights_at_hand(heavy), rest="_light")
        light = light_terms(rows).join(self.vocabulary.select("idx", "idf"), "idx")
        met = light.groupBy("_row").agg(F.collect_list(F.struct("idx", (F.col("tf") * F.col("idf")).alias("w"))).alias("_met"))
        none = F.array().cast("array<struct<idx:bigint,w:double>>")
        every = F.sort_array(F.concat(F.arrays_zip(F.col("_vector.indices").alias("idx"), F.col("_vector.values").alias("w")), F.coalesce("_met", none)))
        found = rows.join(met, "_row", "left").withColumn("_all", every)
        vector = F.struct(F.transform("_all", lambda x: x["idx"]).alias("indices"), F.transform("_all", lambda x: x["w"]).alias("values"))
        return found.withColumn(output, unit(vector)).drop("_row", "_vector", "_light", "_met", "_all")

    def heavy_terms(self, rows: DataFrame) -> DataFrame:
        """The weights of the terms that a frequent-items sketch over ``_terms`` finds hot: a part in HEAVY of all, or more."""
        each = rows.select(F.explode(F.array_distinct("_terms")).alias("idx"))
        top = each.agg(F.expr(f"approx_top_k(idx, {HEAVY}, {16 * HEAVY})").alias("top"), F.count("*").alias("n"))
        named = top.select(F.explode("top").alias("t"), "n").where(F.col("t.count") * HEAVY >= F.col("n"))
        return self.vocabulary.join(F.broadcast(named.select("t.item")), F.col("idx") == F.col("item"), "left_semi")  # at most HEAVY rows


def _weights_at_hand(table: DataFrame) -> Broadcast:
    """(idx, idf) of a table whose size has been checked, sorted, on every executor."""
    rows = table.select("idx", "idf").toArrow()
    idx = rows["idx"].to_numpy()
    order = np.argsort(idx)
    return table.sparkSession.sparkContext.broadcast((idx[order], rows["idf"].to_numpy()[order]))


def _weighed(rows: DataFrame, weights: Broadcast, rest: str | None = None) -> DataFrame:
    """``rows`` without ``_terms``, with ``_vector`` (indices ascending, tf * idf of the terms at hand) and,
    if asked for, ``rest``: the other terms with their counts."""
    place = rows.columns.index("_terms")
    kept = [f for f in rows.schema.fields if f.name != "_terms"]
    pairs = T.StructType([T.StructField("indices", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.DoubleType()))])
    schema = T.StructType([*kept, T.StructField("_vector", pairs), *([T.StructField(rest, pairs)] if rest else [])])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known, idf = weights.value

        def lists(row, idx, value, n):
            offsets = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
            return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(idx, pa.int64())),
                                               pa.ListArray.from_arrays(offsets, pa.array(value, pa.float64()))], ["indices", "values"])

        for batch in batches:
            terms, n = batch.column(place), batch.num_rows
            flat = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(n), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            order = np.lexsort((flat, row))
            flat, row = flat[order], row[order]
            starts = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])]) if len(flat) else np.zeros(0, np.int64)
            tf = np.diff(np.r_[starts, len(flat)]).astype(np.float64)
            idx, row = flat[starts], row[starts]
            at = np.minimum(np.searchsorted(known, idx), max(len(known) - 1, 0))
            met = known[at] == idx if len(known) else np.zeros(len(idx), bool)
            made = [lists(row[met], idx[met], tf[met] * idf[at[met]], n)]
            if rest:
                made.append(lists(row[~met], idx[~met], tf[~met], n))
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != place], *made], [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def light_terms(rows: DataFrame) -> DataFrame:
    """(_row, idx, tf) of the terms that are met in the join."""
    return rows.select("_row", F.inline(F.arrays_zip(F.col("_light.indices").alias("idx"), F.col("_light.values").alias("tf"))))


def unit(vector: Column) -> Column:
    """struct(indices, values) scaled to length 1; one without values stays."""
    def scaled(norm: Column) -> Column:
        return F.struct(vector["indices"].alias("indices"), F.transform(vector["values"], lambda x: x / norm).alias("values"))

    return once(F.sqrt(F.aggregate(vector["values"], F.lit(0.0), lambda s, x: s + x * x)), scaled)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight) with balanced weights n / (classes * n_of_class)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.select(F.sum("n")).scalar()
    classes = counts.select(F.count("*")).scalar()
    return counts.select(label, "n", (total / (classes * F.col("n"))).alias("weight"))


def unit_length(embedding: Column) -> Column:
    """An array of numbers scaled to L2 norm 1; a zero vector stays as it is."""
    as_double = F.transform(embedding, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(as_double, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(as_double, lambda x: F.when(norm > 0, x / norm).otherwise(x))
