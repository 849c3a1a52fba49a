import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from msgflow import staging
from msgflow.llm import winnow

from .helpers import UPPER


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def plain(docs, items, span):
    windows = {}
    for key, text in items:
        w = words(text)
        if w and key is not None:
            n = min(span, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i:i + n]), set()).add(str(key))
    lengths, out = {len(x) for x in windows}, []
    for d, text in docs:
        w, hit, met = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    met |= windows[tuple(w[i:i + n])]
        out.append((str(d), len(w), len(hit), sorted(met), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def got(found):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.items, r.contaminated) for r in found.collect())


@pytest.mark.parametrize("letters, seed", [("ab", 1), ("abcdefgh", 2), ("ab", 3)])
def test_equals_brute_force(spark, letters, seed):
    """Few letters make ties among k-grams, repeats and overlapping windows."""
    rng = random.Random(seed)

    def text(n):
        return " ".join(rng.choice(letters) for _ in range(n))

    items = [(i, text(rng.randrange(0, 40))) for i in range(25)] + [(25, None), (None, text(20)), (3, text(15)), (26, text(5)), (27, text(13))]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    for i in range(40):
        own = words(rng.choice(items[:25])[1])
        a = rng.randrange(max(1, len(own)))
        docs.append((100 + i, " ".join([f"u{j}" for j in range(rng.randrange(30))] + own[a:a + rng.randrange(5, 30)]
                                       + [f"v{j}" for j in range(rng.randrange(300))])))
    docs += [(1, None), (2, ""), (300, "!!"), (300, "!!"), (None, items[4][1])]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, n_words int").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    assert got(winnow.contamination(df, bench)) == plain(docs, items, 13)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(winnow, "BLOOM_BITS", 8)
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, "x " * 20 + text), (2, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, text), (8, "other " * 14)], "item_id long, text string")
    assert got(winnow.contamination(df, bench)) == plain([(1, "x " * 20 + text), (2, "nothing here")], [(9, text), (8, "other " * 14)], 13)


def test_no_items_and_no_documents(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert got(winnow.contamination(df, bench)) == [("1", 2, 0, [], False)]
    assert winnow.contamination(df.limit(0), bench).collect() == []


def test_windows_share_a_fingerprint():
    rng = np.random.default_rng(0)
    for _ in range(500):
        hashes = rng.integers(0, 5, int(rng.integers(1, 30))).astype(np.uint64)
        kept = set(winnow.winnowed(hashes, 8).tolist())
        for i in range(max(1, len(hashes) - 7)):
            run = hashes[i:i + 8]
            assert any(i <= k < i + len(run) and hashes[k] == run.min() for k in kept)


def test_texts_are_handed_over_in_small_batches(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    def largest(docs):
        return max(r.n for r in docs.mapInArrow(run, "n long").collect())

    docs = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("ab "), 20_000).alias("text"))
    assert largest(docs) > 16 << 20
    assert staging.in_small_batches(largest)(docs) < 5 << 20
    assert spark.conf.get(setting) == before


def test_contamination_uses_small_batches(spark, monkeypatch):
    setting, met = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, keep = spark.conf.get(setting), winnow.stage
    monkeypatch.setattr(winnow, "stage", lambda df, name: met.append(spark.conf.get(setting)) or keep(df, name))
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    winnow.contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text"))
    assert met and set(met) == {"4m"} and spark.conf.get(setting) == before
