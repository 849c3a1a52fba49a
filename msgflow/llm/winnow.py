"""Benchmark decontamination by winnowing.

Of every ``SPAN - GRAM + 1`` consecutive word k-grams the one with the smallest
hash is kept as a fingerprint, for documents and benchmark items alike, so any
span of ``SPAN`` shared words shares a fingerprint.  Fingerprints are joined;
each hit carries the words around it and is extended along its diagonal to the
windows of ``SPAN`` equal words.  An item with fewer words is one window of all
its words, and its fingerprint is that whole run.

A Bloom filter of fixed size with the benchmark's fingerprints goes to the
executors, so that only document fingerprints that may hit are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from msgflow.llm.words import Words, mixed, pieces, runs_hash, text_column
from msgflow.staging import in_small_batches, stage

SPAN = 13
GRAM = 6
#: Bits of the Bloom filter. Its size does not depend on the data; past a million fingerprints it only filters less.
BLOOM_BITS = 1 << 20

#: Bytes that separate words: everything under 0x80 but digits and letters.
SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))

_ITEM = "item_key string, length int, print long, around array<long>"
_DOC = "n_words long, hits array<struct<length:int, print:long, place:long, around:array<long>>>"


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the rightmost smallest hash of each run of ``window`` hashes (of the one shorter run, if there are fewer)."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))])
    runs = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(runs)) + window - 1 - np.argmin(runs[:, ::-1], axis=1))


def _prints(words: np.ndarray, length: int, span: int, gram: int):
    """(places, hashes, words before and after a hit that matter) of one text's fingerprints for windows of ``length``."""
    size = gram if length == span else length
    grams = runs_hash(words, size)
    places = winnowed(grams, span - gram + 1) if length == span else np.arange(len(grams))
    return places, grams[places], length - size, size


def _around(words: np.ndarray, places: np.ndarray, margin: int, size: int, absent: int) -> np.ndarray:
    """The words from ``margin`` before to ``margin`` after each hit, ``absent`` where the text has none."""
    padded = np.concatenate([np.full(margin, absent, np.uint64), words, np.full(margin, absent, np.uint64)])
    return padded[places[:, None] + np.arange(size + 2 * margin)].view(np.int64)


def _bits(prints: np.ndarray, n_bits: int) -> list[np.ndarray]:
    again = mixed(prints ^ np.uint64(0x5851F42D4C957F2D))
    return [(x % np.uint64(n_bits)).astype(np.int64) for x in (prints, again)]


def item_prints(items: DataFrame, item_id: str, text: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Fingerprints of the items: item_key (the id as a string), window length, print, the words around it."""

    def run(batches):
        cutter = Words(SEPARATORS)
        for batch in batches:
            rows = {"item_key": [], "length": [], "print": [], "around": []}
            keys = batch.column(0).to_pylist()
            first, _, _, hashes = cutter.cut(text_column(batch.column(1)))
            for i, key in enumerate(keys):
                words = hashes[first[i]:first[i + 1]]
                if not len(words):
                    continue
                length = min(span, len(words))
                places, prints, margin, size = _prints(words, length, span, gram)
                rows["item_key"] += [key] * len(places)
                rows["length"] += [length] * len(places)
                rows["print"] += prints.view(np.int64).tolist()
                rows["around"] += _around(words, places, margin, size, 1).tolist()
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([
                ("item_key", pa.string()), ("length", pa.int32()), ("print", pa.int64()), ("around", pa.list_(pa.int64()))]))

    return items.select(F.col(item_id).cast("string"), text).mapInArrow(run, _ITEM)


def _bloom(prints: DataFrame, n_bits: int) -> tuple[np.ndarray, list[int]]:
    """The filter, and the window lengths that occur (at most SPAN)."""

    def run(batches):
        for batch in batches:
            found = np.unique(np.concatenate(_bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), n_bits)))
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["bit"])

    filled = np.zeros(n_bits, bool)
    places = prints.select("print").mapInArrow(run, "bit long").distinct().toArrow().column(0)  # at most n_bits rows
    filled[places.to_numpy()] = True
    return filled, sorted(r.length for r in prints.select("length").distinct().collect())


def document_prints(docs: DataFrame, text: str, bloom: np.ndarray, lengths: list[int], span: int = SPAN,
                    gram: int = GRAM) -> DataFrame:
    """n_words, and the fingerprints that may hit, beside the other columns of ``docs``."""
    kept = [c for c in docs.columns if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bloom))
    n_bits = len(bloom)

    def run(batches):
        filled = np.unpackbits(shared.value).astype(bool)
        cutter = Words(SEPARATORS)
        for batch in batches:
            column = text_column(batch.column(len(kept)))
            for start, stop in pieces(column):
                first, _, _, hashes = cutter.cut(column.slice(start, stop - start))
                found = [[] for _ in range(stop - start)]
                for length in lengths:
                    _hits(found, first, hashes, length, filled)
                rest = [batch.column(i).slice(start, stop - start) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(np.diff(first)), pa.array(found, type=_HITS)], [*kept, "n_words", "hits"])

    def _hits(found, first, hashes, length, filled):
        size = gram if length == span else length
        grams = runs_hash(hashes, size)
        if not len(grams):
            return
        may = np.logical_and.reduce([filled[b] for b in _bits(grams, n_bits)])
        owner = np.searchsorted(first, np.flatnonzero(may), side="right") - 1
        for i in np.unique(owner):
            words = hashes[first[i]:first[i + 1]]
            if len(words) < length:
                continue
            own = grams[first[i]:first[i] + len(words) - size + 1]
            passed = may[first[i]:first[i] + len(own)]
            places = winnowed(own, span - gram + 1) if length == span else np.arange(len(own))
            places = places[passed[places]]
            around = _around(words, places, length - size, size, 0).tolist()
            found[i] += [{"length": length, "print": p, "place": q, "around": a}
                         for p, q, a in zip(own[places].view(np.int64).tolist(), places.tolist(), around)]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept)
    return docs.select(*kept, text).mapInArrow(run, f"{schema}, {_DOC}")


_HITS = pa.list_(pa.struct([("length", pa.int32()), ("print", pa.int64()), ("place", pa.int64()),
                            ("around", pa.list_(pa.int64()))]))


@in_small_batches
def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
                  share: tuple[int, int] = (1, 20), span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The columns of ``docs``, without the text, and what the benchmark left in it.

    Adds ``n_words``, ``n_hit`` (words inside an occurrence of an item's window of
    ``span`` words; an item of fewer words is one window), ``n_items`` and ``items``
    (sorted ids, as strings, of the items with such windows) and ``contaminated``:
    ``n_hit`` is over 0 and at least ``share`` of the words.

    Words are lower-cased runs of ASCII letters, digits and code points past 0x7F.
    Null and empty texts have no words and are clean; items without words or id are
    left out; items that share an id count once.  Every row is judged by itself, so
    repeated rows each get their own, equal, result.  Columns of ``docs`` named like
    an added one are replaced.  No items: every document is clean.
    """
    added = {"n_words", "n_hit", "n_items", "items", "contaminated"}
    spark = docs.sparkSession
    prints = stage(item_prints(items.where(F.col(item_id).isNotNull()), item_id, text, span, gram), "item-prints")
    bloom, lengths = _bloom(prints, BLOOM_BITS)
    kept = [c for c in docs.columns if c != text and c not in added]
    # Rows are numbered once and staged, so that the number stays with its row.
    numbered = docs.select(*[F.col(c).alias(f"own_{i}") for i, c in enumerate(kept)], text)
    found = document_prints(numbered, text, bloom, lengths, span, gram).withColumn("row", F.monotonically_increasing_id())
    found = stage(found, "document-prints")
    hits = found.select("row", F.explode("hits").alias("hit")).select("row", "hit.length", "hit.print", "hit.place",
                                                                    F.col("hit.around").alias("words"))
    met = hits.join(prints, ["length", "print"])
    same = F.zip_with("words", "around", lambda a, b: a == b)
    met = met.select("row", "item_key", "place", "length", same.alias("same"))
    # The windows on the hit's diagonal: the hit begins at most ``margin`` words after its window.
    offsets = F.filter(F.sequence(F.lit(0), F.size("same") - F.col("length")),
                       lambda o: F.forall(F.slice("same", o + 1, F.col("length")), lambda x: x))
    margin = F.when(F.col("length") == span, F.lit(span - gram)).otherwise(0)
    starts = met.select("row", "item_key", "length", (F.col("place") - margin).alias("left"), F.explode(offsets).alias("offset"))
    starts = starts.groupBy("row", (F.col("left") + F.col("offset")).alias("start")).agg(
        F.max("length").alias("length"), F.collect_set("item_key").alias("items"))
    words = starts.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("word"))
    counted = words.groupBy("row", "word").agg(F.lit(1).alias("one")).groupBy("row").agg(F.count("*").alias("n_hit"))
    named = starts.select("row", F.explode("items").alias("item")).groupBy("row").agg(
        F.sort_array(F.collect_set("item")).alias("items"))
    judged = found.join(counted, "row", "left").join(named, "row", "left")
    own = [F.col(f"own_{i}").alias(c) for i, c in enumerate(kept)]
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    items_ = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    part, whole = share
    return judged.select(*own, "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
                         items_.alias("items"), ((n_hit > 0) & (whole * n_hit >= part * F.col("n_words"))).alias("contaminated"))
