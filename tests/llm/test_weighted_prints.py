import hashlib
import random

import numpy as np

from msgflow.llm import neighbours, weighted_prints

from .helpers import bag_likeness


def test_agreement_is_the_generalised_jaccard_similarity(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {r.doc_id: np.frombuffer(bytes.fromhex(r.fingerprint), ">u2") for r in
              weighted_prints.fingerprints(df, "text", samples=1024).collect()}
    errors = [weighted_prints.likeness(prints[i], prints[j]) - bag_likeness(texts[i], texts[j]) for i in range(60) for j in range(i)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.02 and max(map(abs, errors)) < 0.08


def test_edit_probe_equals_brute_force(spark, monkeypatch):
    real = neighbours.with_neighbours
    monkeypatch.setattr(weighted_prints, "with_neighbours", lambda *a, **k: real(*a, **k | {"rows_per_bucket": 9}))
    rng = random.Random(8)
    docs = [(i * 3, "".join(rng.choice("ab é\n漢") for _ in range(rng.randrange(60)))) for i in range(100)] + [(500, None), (501, ""), (502, " ")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_chars int").repartition(4)
    got = {r.doc_id: r for r in weighted_prints.edit_probe(df, "doc_id", "text").collect()}
    order = sorted(((d, t or "") for d, t in docs), reverse=True)
    assert len(got) == len(docs)
    for (d, own), (other, after) in zip(order, order[1:] + order[:1]):
        cut = len(own) // 3
        edited = own[:len(own) - cut] + after[:cut]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint == "") == (not own.strip(" \t\n\v\f\r"))
        a, b = (np.frombuffer(bytes.fromhex(x), ">u2") for x in (r.fingerprint, r.edited_fingerprint))
        near = float(np.mean(a == b)) if len(a) and len(b) else float(len(a) == len(b))
        assert r.near_edited == near and 0 <= r.near_next <= 1
        assert r.near_next == weighted_prints.likeness(*[np.frombuffer(bytes.fromhex(x), ">u2") if x else None
                                                        for x in (r.fingerprint, got[other].fingerprint)])


def test_repeated_rows_null_ids_one_row_and_none(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "x y z"), (-2 ** 63, "low est"), (2 ** 63 - 1, "high est")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = weighted_prints.edit_probe(df, "doc_id", "text").collect()
    order = ["high est", "a b c", "a b c", "low est", "x y z"]
    by = {}
    for own, after in zip(order, order[1:] + order[:1]):
        cut = len(own) // 3
        by.setdefault(own, set()).add(hashlib.sha256((own[:len(own) - cut] + after[:cut]).encode()).hexdigest())
    assert {r.edited_sha256 for r in got} == set().union(*by.values()) and len(got) == 5
    one = weighted_prints.edit_probe(df.where("doc_id = -9223372036854775808"), "doc_id", "text").collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert weighted_prints.edit_probe(df.limit(0), "doc_id", "text").collect() == []
    same = weighted_prints.fingerprints(df.withColumnRenamed("doc_id", "fingerprint"), "text")
    assert same.columns == ["fingerprint"] and len({r.fingerprint for r in same.collect()}) == 4
