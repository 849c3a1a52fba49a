"""Document fingerprints by consistent weighted sampling.

A text is a bag of words with their counts as weights.  For each of the
samples, every word has fixed draws: r and c from the gamma distribution of
shape 2, and b uniform.  With t = floor(ln(weight) / r + b), a word's value is
ln c - r * (t - b) - r, and the word and t of the least value are the sample.
Two texts agree in a sample with a chance equal to the generalised Jaccard
similarity of their bags (the sum of the smaller weights over that of the larger).

The draws come from a hash of the word, so all tasks have the same ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from msgflow.llm.neighbours import with_neighbours
from msgflow.llm.words import Words, mixed, pieces, text_column

#: Samples of a fingerprint; each is written as 16 bits, four hexadecimal digits.
SAMPLES = 128

#: ASCII white space separates words.
SPACES = b" \t\n\v\f\r"

_ROWS = 16384  # of the table of values that are handled at once


def _uniform(bits: np.ndarray) -> np.ndarray:
    """In (0, 1), from 32 bits."""
    return (bits.astype(np.float64) + 0.5) * 2.0 ** -32


def draws(terms: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of each term hash (rows) and sample (columns)."""
    with np.errstate(over="ignore"):
        seeds = terms[:, None] + np.arange(1, samples + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1342543DE82EF95)
        x, y, z = (mixed(seeds ^ np.uint64(k)) for k in (0, 0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47))
    low, high = np.uint64(0xFFFFFFFF), np.uint64(32)
    r = -np.log(_uniform(x & low) * _uniform(x >> high))
    ln_c = np.log(-np.log(_uniform(y & low) * _uniform(y >> high)))
    return r, ln_c, _uniform(z & low)


def values(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """The values of (term, weight) rows in each sample; rows of a term that stand together share its draws."""
    out = np.empty((len(terms), samples), np.float32)
    for i in range(0, len(terms), 2048):
        own, weight = terms[i:i + 2048], np.log(weights[i:i + 2048, None].astype(np.float64))
        new = np.r_[True, own[1:] != own[:-1]]
        r, ln_c, b = (x[np.cumsum(new) - 1] for x in draws(own[new], samples))
        out[i:i + 2048] = ln_c - r * (np.floor(weight / r + b) - b) - r
    return out


def signatures(column: pa.Array, cutter: Words, samples: int = SAMPLES) -> list[np.ndarray | None]:
    """16 bits for each sample of each text; None for a text without words."""
    first, _, _, hashes = cutter.cut(column)
    terms, counts, sizes = [], [], []
    for a, z in zip(first[:-1], first[1:]):
        term, count = np.unique(hashes[a:z], return_counts=True)
        terms.append(term)
        counts.append(count)
        sizes.append(len(term))
    if not sum(sizes):
        return [None] * len(sizes)
    terms, counts = np.concatenate(terms), np.concatenate(counts)
    with np.errstate(over="ignore"):
        keys = terms + counts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, one, which = np.unique(keys, return_index=True, return_inverse=True)
    by_term = np.argsort(terms[one], kind="stable")
    place = np.empty(len(one), np.int64)
    place[by_term] = np.arange(len(one))
    one, which = one[by_term], place[which]
    table = values(terms[one], counts[one], samples)
    least = np.full((len(sizes), samples), np.inf, np.float32)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for i in range(0, len(which), _ROWS):
        own = owner[i:i + _ROWS]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        some = np.minimum.reduceat(table[which[i:i + _ROWS]], starts, axis=0)
        least[own[starts]] = np.minimum(least[own[starts]], some)
    short = (mixed(least.view(np.uint32).astype(np.uint64)) & np.uint64(0xFFFF)).astype(">u2")
    return [short[i] if n else None for i, n in enumerate(sizes)]


def written(signature: np.ndarray | None) -> str:
    return "" if signature is None else signature.tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """The share of equal samples; two texts without words are alike, one of them and another text are not."""
    if a is None or b is None:
        return float(a is b)
    return float(np.mean(a == b))


def fingerprints(docs: DataFrame, text: str, samples: int = SAMPLES) -> DataFrame:
    """The columns of ``docs`` without the text, and ``fingerprint``: 4 * samples hexadecimal digits.

    Null and empty texts, and those of white space alone, have the empty string.
    Words are lower-cased (A-Z) runs without ASCII white space.  Each row is
    handled by itself: repeated rows have equal fingerprints, no rows give no rows,
    a column of ``docs`` named ``fingerprint`` is replaced.
    """
    kept = [c for c in docs.columns if c not in (text, "fingerprint")]

    def run(batches):
        cutter = Words(SPACES)
        for batch in batches:
            column = text_column(batch.column(len(kept)))
            for start, stop in pieces(column):
                made = [written(s) for s in signatures(column.slice(start, stop - start), cutter, samples)]
                rest = [batch.column(i).slice(start, stop - start) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(made, pa.string())], [*kept, "fingerprint"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept]
    return docs.select(*kept, text).mapInArrow(run, ", ".join([*fields, "fingerprint string"]))


def edit_probe(docs: DataFrame, doc_id: str, text: str, samples: int = SAMPLES) -> DataFrame:
    """How fingerprints see an edit: each text, and the text with its last third replaced.

    The last floor(n_chars / 3) code points are replaced by the first as many (or
    all) of the next document, in descending order of ``doc_id`` and around from the
    last to the first.  Null ids come last; rows that share an id are ordered by
    their text, and rows equal in both are alike.  Returns ``doc_id``, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and
    ``near_next`` (the shares of samples that agree with the edited text and with the
    next document).  Null texts count as empty; other columns are not read; a single
    document is its own next one.
    """
    # ~x turns the order of longs around without overflow.
    rows = docs.select(F.col(doc_id).cast("long").alias("own_id"), F.coalesce(text, F.lit("")).alias("own_text"))
    rows = rows.withColumn("key", F.coalesce(F.bitwise_not("own_id"), F.lit(2 ** 63 - 1)))
    ringed = with_neighbours(rows, "key", ["own_text"], around=True)

    def made(items, cutter):
        """Rows for all items but the last: (bucket, border, id, text)."""
        olds, news, at = [x[3] for x in items], [], []
        for i, (bucket, border, _, own) in enumerate(items[:-1]):
            if border == 0 and items[i + 1][0] == bucket:
                cut = len(own) // 3
                news.append(own[:len(own) - cut] + items[i + 1][3][:cut])
                at.append(i)
        if not at:
            return None
        both = signatures(pa.array(olds + news, pa.string()), cutter, samples)  # they have most words in common
        prints, edited = both[:len(olds)], both[len(olds):]
        return pa.RecordBatch.from_arrays([
            pa.array([items[i][2] for i in at], pa.int64()), pa.array([len(olds[i]) for i in at], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in news]), pa.array([written(prints[i]) for i in at]),
            pa.array([written(x) for x in edited]), pa.array([likeness(prints[i], x) for i, x in zip(at, edited)]),
            pa.array([likeness(prints[i], prints[i + 1]) for i in at])],
            [doc_id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        cutter, items, held = Words(SPACES), [], 0
        for batch in batches:
            for start, stop in pieces(batch.column(3), 256 << 10):
                part = batch.slice(start, stop - start)
                items += zip(*[part.column(i).to_pylist() for i in range(4)])
                held += sum(len(x[3]) for x in items[-(stop - start):])
                if held >= 1 << 20:
                    if (rows_ := made(items, cutter)) is not None:
                        yield rows_
                    items = items[-1:]
                    held = len(items[0][3])
        if items and (rows_ := made(items, cutter)) is not None:
            yield rows_

    return ringed.select("bucket", "border", "own_id", "own_text").mapInArrow(
        run, f"`{doc_id}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
