"""Personal data: base patterns, generous candidates, and boosted trees that choose among the candidates.

Base spans are exact (see :func:`base_spans`) and always stay.  Generators propose
further, overlapping spans: numbers without a plus sign, addresses written out in
words, card numbers with other separators.  Gradient-boosted trees score each
candidate by its format and context, and a threshold per kind, calibrated on
held-out rows, selects those that are added.

No labels are given, so the trees learn from the base spans of all distinct
documents: each is rewritten in looser ways (no plus sign, "at" and "dot",
dots for spaces) where it stands, which makes the positive rows; candidates that
touch no base span are the negative ones.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from msgflow.llm.words import pieces, text_column
from msgflow.staging import stage

KINDS = ("email", "ip", "card", "phone")

#: A threshold is the least score at which so many of the held-out candidates above it are right.
PRECISION = 0.95
#: With fewer positive rows to learn from, or fewer held out for a kind, nothing is added.
LEAST_POSITIVE = 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order of start and kind, in code points.

    Per kind the leftmost matches that do not overlap of these patterns; a match
    that fails its check is dropped and not tried shorter:
    email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip four numbers with
    dots, none over 255; card ``[0-9]([ -]?[0-9])+`` of 12 to 19 digits that pass the
    Luhn check; phone ``\\+[0-9][ ().0-9-]+[0-9]`` of 9 to 15 digits.
    The forms used here give the same matches in linear time.
    """
    found = [(a, z, 0) for a, z in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in (p.lstrip("0") for p in m.group().split("."))):
            found.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append((*m.span(), 3))
    found.sort(key=lambda s: (s[0], s[2]))
    return [(a, z, KINDS[k]) for a, z, k in found]


# ---------------------------------------------------------------- candidates

_WRITTEN_AT = re.compile(r"[\w.%+-]{1,64} ?(?:\[at\]|\(at\)|\bat\b|@) ?[\w-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\bdot\b|\.) ?[\w-]{1,63}){1,4}")
_NUMBERS = re.compile(r"(?<![\w.+])\(?[0-9]++\)?+(?:[ ./()-]{1,2}+[0-9]++\)?+)*+")
_GROUP = re.compile(r"\(?[0-9]++\)?+")
#: Digits of a span of numbers; an ip has four groups.
_SIZES = {"ip": range(4, 13), "card": range(12, 20), "phone": range(7, 16)}
_MOST_DIGITS = 19

#: Words that often stand before data of a kind (fixed values).
CONTEXT = {
    "email": "mail email e-mail contact write address courriel correo schreiben".split(),
    "ip": "ip server host address login adresse direccion serveur".split(),
    "card": "card visa mastercard credit debit carte tarjeta karte kreditkarte".split(),
    "phone": "phone call tel telephone mobile fax dial cell telefon appelez llame telefono".split(),
}

N_FEATURES = 22


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Proposed spans of all kinds; they may overlap each other and the base spans.

    Of a run of numbers, however long, every sequence of whole groups of digits whose digits fit a kind.
    """
    found = []
    if "@" in text or " at " in text or "[at]" in text or "(at)" in text:
        found += [(*m.span(), "email") for m in _WRITTEN_AT.finditer(text)]
    for m in _NUMBERS.finditer(text):
        groups = [(*g.span(), len(_digits(g.group()))) for g in _GROUP.finditer(text, *m.span())]
        for i, (start, _, _) in enumerate(groups):
            n = 0
            for j in range(i, len(groups)):
                n += groups[j][2]
                if n > _MOST_DIGITS:
                    break
                found += [(start, groups[j][1], k) for k, sizes in _SIZES.items() if n in sizes and (k != "ip" or j == i + 3)]
    return found


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of a span and of what stands around it."""
    span, before, after = text[start:end], text[max(0, start - 48):start], text[end:end + 16]
    digits = _digits(span)
    groups = re.findall("[0-9]+", span)
    words = set(re.findall(r"[\w-]+", before.lower()))
    seps = set(re.findall("[^0-9]", span))
    return [
        *[float(kind == k) for k in KINDS], float(len(digits)), float(len(span)), float(len(groups)),
        float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)), float(len(seps)),
        float(luhn(digits)) if digits else 0.0, float(max((int(g[:9]) for g in groups), default=0) <= 255),
        float(span.startswith("00")), float("(" in span), float("." in span), float("-" in span), float(" " in span),
        float("@" in span or re.search(r"\bat\b", span) is not None), float("." in span[-5:] or "dot" in span),
        float(any(w in words for w in CONTEXT[kind])), float(bool(re.match(r"\s*(?:%|€|\$|£|kg|km|cm|mm|\w+/)", after))),
        float(bool(re.search(r"[$€£#§]\s*$", before)))]


_NO_DIGITS = str.maketrans("0123456789", "annesolupi")


def loosened(span: str, kind: str, turn: int) -> str:
    """A base span as people also write it; ``turn`` chooses the way."""
    if kind == "email":
        if turn % 2:
            span = span.translate(_NO_DIGITS)  # names without digits are as common
        return [span.replace("@", " at ").replace(".", " dot "), span.replace("@", " [at] "), span.replace("@", "(at)")][turn % 3]
    if kind == "ip":
        return [span.replace(".", " . "), span.replace(".", "-"), span.replace(".", "/")][turn % 3]
    if kind == "card":
        return ".".join(re.findall("[0-9]{1,4}", _digits(span))) if turn % 2 else "/".join(re.findall("[0-9]{1,4}", _digits(span)))
    return [span.lstrip("+"), "00" + span[1:], span.lstrip("+").replace(" ", ".")][turn % 3]


def training_rows(text: str) -> list[tuple[list[float], float, str]]:
    """(features, label, kind) that a text teaches.

    Every other rewritten span gets a date beside it.  Candidates that go beyond a rewritten
    number, or are of another kind, are wrong; of the others within it only the whole one teaches.
    """
    base, rows = base_spans(text), []
    for start, end, kind in candidates(text):
        if not any(a < end and start < z for a, z, _ in base):
            rows.append((features(text, start, end, kind), 0.0, kind))
    for i, (start, end, kind) in enumerate(base):
        for turn in range(3):
            own = loosened(text[start:end], kind, turn + i)
            before, after = text[max(0, start - 60):start], text[end:end + 20]
            if kind != "email" and (turn + i) % 2:
                before, after = (before + "12.05.2023 ", after) if turn else (before, " 12.05.2023" + after)
            changed, a = before + own + after, len(before)
            z = a + len(own)
            for x, y, k in candidates(changed):
                if x >= z or y <= a or kind == "email" != k:
                    continue
                if kind == "email" or k == kind and x <= a + 1 and y >= z - 1 and _digits(changed[x:y]) == _digits(own):
                    rows.append((features(changed, x, y, k), 1.0, k))
                elif k != kind or x < a or y > z:
                    rows.append((features(changed, x, y, k), 0.0, k))
    return rows


# --------------------------------------------------------------------- model


def _training_table(docs: DataFrame, text: str, sample: int | None = None) -> DataFrame:
    """(x, label, kind, held_out) of every distinct text, or of about ``sample`` to twice as many chosen by a hash.

    Copies are taken out among the rows they teach, so texts are not shuffled.
    """
    def run(batches):
        for batch in batches:
            for start, stop in pieces(text_column(batch.column(0))):
                for t in text_column(batch.column(0)).slice(start, stop - start).to_pylist():
                    rows = training_rows(t)
                    if rows:
                        whole = t.encode()
                        held, digest = zlib.crc32(whole) % 10 < 3, hashlib.blake2b(whole, digest_size=16).digest()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows]),
                             pa.array([r[2] for r in rows]), pa.array([held] * len(rows)), pa.array([digest] * len(rows)),
                             pa.array(range(len(rows)), pa.int32())], ["x", "label", "kind", "held_out", "digest", "n"])

    texts, draw = docs.select(F.coalesce(text, F.lit("")).alias("t")), F.xxhash64("t")
    if sample is not None:
        step = max(1, texts.select(draw.alias("draw")).distinct().count() // sample)
        texts = texts.where(F.pmod(draw, F.lit(step)) == 0)
    rows = texts.mapInArrow(run, "x array<double>, label double, kind string, held_out boolean, digest binary, n int")
    return rows.dropDuplicates(["digest", "n"]).sortWithinPartitions("digest", "n").drop("digest", "n")


def fit(docs: DataFrame, text: str, sample: int | None = None, precision: float = PRECISION):
    """(model, {kind: threshold}), or (None, {}) where there is too little to learn from.

    Every distinct text is read: seven tenths train the trees, the others calibrate the
    thresholds. With ``sample``, so many to about twice as many are read, chosen by a hash.
    """
    rows = stage(_training_table(docs, text, sample), "pii-training")
    counts = {r.label: r.n for r in rows.where("not held_out").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if counts.get(1.0, 0) < LEAST_POSITIVE or counts.get(0.0, 0) < 1:
        return None, {}
    vectors = rows.withColumn("features", array_to_vector("x"))
    model = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=7, maxBins=32).fit(vectors.where("not held_out"))
    held = model.transform(vectors.where("held_out")).select("kind", "label", vector_to_array("probability")[1].alias("p"))
    return model, limits(held, precision)


def limits(held: DataFrame, precision: float) -> dict[str, float]:
    """:func:`calibrated` of a DataFrame; a row for each kind comes to the driver."""
    scores = held.groupBy("kind", "p").agg(F.sum("label").alias("right"), F.count("*").alias("n"))
    above = Window.partitionBy("kind").orderBy(F.desc("p"))
    runs = scores.select("kind", "p", F.sum("right").over(above).alias("right"), F.sum("n").over(above).alias("n"))
    good = runs.where((F.col("right") / F.col("n") >= precision) & (F.col("right") >= LEAST_POSITIVE))
    return {r.kind: max(0.5, r.p) for r in good.groupBy("kind").agg(F.min("p").alias("p")).collect()}


def calibrated(held: pd.DataFrame, precision: float) -> dict[str, float]:
    """The least threshold of each kind at which the share of right rows is ``precision``; kinds without one are left out."""
    chosen = {}
    for kind, rows in held.groupby("kind"):
        rows = rows.sort_values("p", ascending=False, kind="stable")
        right = rows["label"].cumsum().to_numpy()
        share = right / np.arange(1, len(rows) + 1)
        last = np.r_[rows["p"].to_numpy()[1:] != rows["p"].to_numpy()[:-1], True]  # equal scores pass together
        good = np.flatnonzero((share >= precision) & (right >= LEAST_POSITIVE) & last)
        if len(good):
            chosen[str(kind)] = max(0.5, float(rows["p"].iloc[good[-1]]))
    return chosen


_SPAN = "array<struct<start:int, end:int, kind:string>>"
_FOUND = f"base {_SPAN}, proposed array<struct<start:int, end:int, kind:string, x:array<double>>>"
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
_ARROW_PROPOSED = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()),
                                      ("x", pa.list_(pa.float64()))]))


def _searched(docs: DataFrame, text: str) -> DataFrame:
    """The other columns of ``docs``, the base spans and the candidates that touch none of them."""
    kept = [c for c in docs.columns if c != text]

    def run(batches):
        for batch in batches:
            column = text_column(batch.column(len(kept)))
            for start, stop in pieces(column):
                base, proposed = [], []
                for t in column.slice(start, stop - start).to_pylist():
                    spans = base_spans(t)
                    base.append([{"start": a, "end": z, "kind": k} for a, z, k in spans])
                    free, i = [], 0
                    for a, z, k in sorted(candidates(t)):
                        while i < len(spans) and max(x[1] for x in spans[i:i + 1]) <= a:
                            i += 1
                        if not any(b < z and a < y for b, y, _ in spans[max(0, i - len(KINDS)):i + len(KINDS)]):
                            free.append({"start": a, "end": z, "kind": k, "x": features(t, a, z, k)})
                    proposed.append(free)
                rest = [batch.column(i).slice(start, stop - start) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(base, _ARROW_SPAN), pa.array(proposed, _ARROW_PROPOSED)], [*kept, "base", "proposed"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept]
    return docs.select(*kept, text).mapInArrow(run, ", ".join([*fields, _FOUND]))


def _chosen(scored: pd.Series) -> pd.Series:
    """Of overlapping candidates the one with the highest score stays (ties: the first, then the longest)."""
    def one(rows):
        taken, starts = [], []  # by start; those taken do not overlap
        for r in sorted(rows, key=lambda r: (-r["p"], r["start"], -r["end"], KINDS.index(r["kind"]))):
            i = bisect.bisect_left(starts, r["end"])
            if i == 0 or taken[i - 1]["end"] <= r["start"]:
                taken.insert(i, r)
                starts.insert(i, r["start"])
        return [{"start": t["start"], "end": t["end"], "kind": t["kind"]} for t in taken]

    return scored.map(one)


def find(docs: DataFrame, text: str, model=None, thresholds: dict[str, float] | None = None) -> DataFrame:
    """The columns of ``docs`` without the text, and ``base`` and ``spans``: arrays of (start, end, kind).

    ``spans`` holds the base spans and the candidates that the trees select, by start
    and then kind in the order of KINDS; places are code points, the end exclusive.
    Without a model nothing is added.  Null counts as the empty text.  Each row is
    judged by itself, so repeated rows have equal spans; columns named ``base`` or
    ``spans`` are replaced; no rows give no rows.
    """
    kept = [c for c in docs.columns if c not in (text, "base", "spans")]
    own = docs.select(*[F.col(c).alias(f"own_{i}") for i, c in enumerate(kept)], text)
    rows = _searched(own, text)
    if model is None or not thresholds:
        rows = rows.withColumn("more", F.array().cast(_SPAN))
    else:
        # Rows are numbered once and staged, so that the number stays with its row.
        rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "pii-candidates")
        each = rows.select("row", F.explode("proposed").alias("c")).select("row", "c.start", "c.end", "c.kind", "c.x")
        limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in thresholds.items()])
        scored = model.transform(each.withColumn("features", array_to_vector("x")))
        scored = scored.withColumn("p", vector_to_array("probability")[1]).where(F.col("p") >= limit)
        choose = F.pandas_udf(_chosen, _SPAN)
        more = scored.groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind", "p")).alias("all"))
        rows = rows.join(more.select("row", choose("all").alias("more")), "row", "left")
    order = F.array(*[F.lit(k) for k in KINDS])
    both = F.concat("base", F.coalesce("more", F.array().cast(_SPAN)))
    keyed = F.array_sort(F.transform(both, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(keyed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return rows.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(kept)], "base", spans.alias("spans"))


def written(spans) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
