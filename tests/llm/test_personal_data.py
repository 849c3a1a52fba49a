import random
import re

import pandas as pd
import pytest

from msgflow.llm import personal_data as pii

DATA = "/root/testdata/sf0.1"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                  "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return [(a, z, k) for a, _, z, k in sorted(out)]


@pytest.mark.parametrize("letters", ["a.@-_1 ", "12.3 -", "+1 ()2.-9", "é0145 -."])
def test_base_spans_equal_the_patterns(letters):
    rng = random.Random(letters)
    for _ in range(15_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(45)))
        assert pii.base_spans(text) == plain(text), text


def test_base_spans_of_long_runs():
    for text in ("1" * 20_000, "a" * 20_000, "1.1" * 5_000, "1 " * 10_000, "+1" * 5_000, "a@b." * 5_000):
        assert pii.base_spans(text) == plain(text) if len(text) <= 1_000 else pii.base_spans(text) is not None


def test_numbers_of_thousands_of_digits():
    for zeros in (300, 5_000, 100_000):
        assert pii.base_spans("0" * zeros + "7.1.2.255") == [(0, zeros + 9, "ip")]
        assert pii.base_spans("0" * zeros + "256.1.2.3") == [] and pii.base_spans("9" * zeros + ".1.2.3") == []
    assert pii.base_spans("0.0.0.0") == [(0, 7, "ip")]


@pytest.fixture(scope="module")
def fitted(spark):
    return pii.fit(spark.read.parquet(f"{DATA}/documents.parquet"), "text")


def test_base_spans_stay_and_loose_forms_are_added(spark, fitted):
    model, thresholds = fitted
    assert model is not None and thresholds
    rows = [(1, "write to jane at shop dot example dot com or +1 (212) 555-0143 now"), (2, "call 212-555-0143 please"), (3, None), (4, ""),
            (5, "server 10.0.0.1 and card 4111 1111 1111 1111, mail a.b@c.example"), (5, "server 10.0.0.1 and card 4111 1111 1111 1111, mail a.b@c.example"),
            (6, "it was at home at noon in 1999")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = pii.find(df, "text", model, thresholds).collect()
    assert len(got) == len(rows)
    added = set()
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        base = [(s.start, s.end, s.kind) for s in r.base]
        spans = [(s.start, s.end, s.kind) for s in r.spans]
        assert base == plain(text) and set(base) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (s[0], pii.KINDS.index(s[2])))
        added |= {(r.doc_id, text[a:z]) for a, z, _ in set(spans) - set(base)}
    assert any(d == 1 and "at shop dot" in t for d, t in added) and not any(d == 6 for d, _ in added)
    assert pii.find(df.limit(0), "text", model, thresholds).collect() == []


def test_documents_without_loose_forms_keep_their_base_spans(spark, fitted):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("doc_id < 3000")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    wrong = 0
    for r in pii.find(docs, "text", *fitted).collect():
        base = plain(texts[r.doc_id])
        assert [(s.start, s.end, s.kind) for s in r.base] == base
        wrong += len(r.spans) - len(base)
    assert wrong <= 10  # the tables hold no loose forms


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "no data"), (2, "10.1.1.1")], "doc_id long, text string")
    assert pii.fit(df, "text") == (None, {})
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(df, "text").collect()}
    assert got == {1: [], 2: [(0, 8, "ip")]}


def test_thresholds_reach_the_precision():
    held = pd.DataFrame({"kind": ["ip"] * 100 + ["card"] * 100, "label": [1.0] * 60 + [0.0] * 40 + [0.0] * 100,
                         "p": [0.9 - i / 200 for i in range(100)] + [0.8] * 100})
    limits = pii.calibrated(held, 0.95)
    assert set(limits) == {"ip"}
    above = held[(held.kind == "ip") & (held.p >= limits["ip"])]
    assert above.label.mean() >= 0.95 and len(above) >= 60


def test_every_sequence_of_groups_that_fits_is_proposed():
    def found(text):
        return {(text[a:z], k) for a, z, k in pii.candidates(text)}

    assert ("555-123-4567", "phone") in found("ring 555-123-4567 12.05.2023")
    assert ("212-555-0143", "phone") in found("1 2 3 4 5 6 7 8 212-555-0143")
    assert {("(826) 555-4081", "phone"), ("190.137.223.204", "ip")} <= found("(826) 555-4081 190.137.223.204")
    assert ("4111 1111 1111 1111", "card") in found(" ".join(map(str, range(1000, 1400))) + " 4111 1111 1111 1111 2024")
    assert not any(len(t) > 19 for t, _ in found("1" * 20 + " 2")) and found("12345678901234567890123") == set()
    # All of them, on random runs, by trying each sequence of groups.
    rng = random.Random(4)
    for _ in range(200):
        groups = [str(10 ** (rng.randrange(1, 8) - 1) + 1) for _ in range(rng.randrange(1, 14))]
        text, want = "-".join(groups), set()
        for i in range(len(groups)):
            for j in range(i, len(groups)):
                n, own = len("".join(groups[i:j + 1])), "-".join(groups[i:j + 1])
                want |= {(own, k) for k, yes in (("ip", j == i + 3 and n <= 12), ("card", 12 <= n <= 19), ("phone", 7 <= n <= 15)) if yes}
        assert found(text) == want


def test_the_rewritten_span_is_chosen_beside_another_number(spark, fitted):
    text = "phone 1 (212) 555-0143 12.05.2023 and"
    got = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), "text", *fitted).collect()[0]
    assert [text[s.start:s.end] for s in got.spans if s.kind == "phone"] == ["1 (212) 555-0143"]


def test_sample_takes_distinct_texts(spark):
    """One text with thousands of copies neither fills the sample nor thins out the others."""
    df = spark.range(3000).selectExpr("'server 10.0.0.1 and 1 2 3 4 5 6 7' text").unionByName(
        spark.range(30).selectExpr("concat('server 10.0.1.', id) text"))
    rows = pii._training_table(df, "text", 100).where("label = 1").groupBy("x").count().collect()
    assert sum(r["count"] for r in rows) == sum(label for t in {r.text for r in df.collect()} for _, label, _ in pii.training_rows(t))


def test_limits_equal_the_plain_version(spark):
    rng = random.Random(2)
    rows = [(k, float(rng.random() < p), round(p, 2)) for k in ("ip", "card", "phone") for p in (rng.random() for _ in range(400))]
    held = pd.DataFrame(rows, columns=["kind", "label", "p"])
    for precision in (0.5, 0.8, 0.95):
        assert pii.limits(spark.createDataFrame(rows, "kind string, label double, p double"), precision) == pii.calibrated(held, precision)


def test_every_distinct_text_teaches(spark, monkeypatch):
    """More texts than the sample once took: none is left out, and copies teach once."""
    monkeypatch.setattr(pii, "SAMPLE_DOCUMENTS", 5, raising=False)
    texts = [f"server 10.0.{i // 200}.{i % 200}" for i in range(300)]
    df = spark.createDataFrame([(t,) for t in texts + texts[:50]], "text string").repartition(4)
    want = sum(len(pii.training_rows(t)) for t in texts)
    assert pii._training_table(df, "text").count() == want
