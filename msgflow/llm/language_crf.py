"""Language identification of words in context by a linear-chain conditional random field.

A word's score for each language is the sum of learned weights of its affixes, its
byte n-grams and of the lexicons that hold it; a learned matrix scores the step
from one word's language to the next.  Forward-backward gives the chance of each
language for each word, so a text that switches languages keeps its parts; a
document gets the language with the largest mean chance.

Training reads a bounded sample of labelled rows.  Scoring is one pass in numpy:
all words of a few megabytes at once, the chains in blocks whose transfer matrices
are composed, so that a long text costs no more per word than a short one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from msgflow.llm.words import Words, mixed, pieces, text_column, utf8

UNDETERMINED = "und"
SPACES = b" \t\n\v\f\r"

#: Bounds of the training sample: distinct texts for each label, chosen by a hash; segments of each, spread over the
#: whole text; words of a segment.
ROWS, SEGMENTS, SEGMENT_WORDS = 300, 4, 48
#: Words in each language's lexicon, the most telling ones of the sample.
LEXICON = 1500
EPOCHS = 40

_TRIPLES = 1 << 16
_AFFIXES = 1 << 15
_BLOCK = 32


class Crf(NamedTuple):
    """A trained model. Weights have a column for each label."""

    labels: list
    pairs: np.ndarray  # of two bytes
    triples: np.ndarray  # of three bytes, hashed
    affixes: np.ndarray  # of the first and last one to three bytes, hashed
    lexicon: np.ndarray  # sorted word hashes
    of_lexicon: np.ndarray  # their weights
    bias: np.ndarray
    step: np.ndarray  # from the row's label to the column's
    start: np.ndarray


def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


class _Text:
    """The words of an Arrow column with the features of each."""

    def __init__(self, column: pa.Array, cutter: Words):
        self.first, self.starts, self.ends, self.hashes = cutter.cut(column)
        _, data = utf8(column)
        self.data = _lowered()[data].astype(np.uint32)

    def affixes(self) -> np.ndarray:
        """Six hashed features of each word (rows): 1 to 3 bytes from its start and from its end."""
        data, out = self.data, np.empty((len(self.starts), 6), np.int64)
        length = self.ends - self.starts
        for side, base in ((0, self.starts), (1, self.ends - 1)):
            code = np.full(len(base), side + 1, np.uint64)
            for k in range(3):
                place = base + k if side == 0 else base - k
                here = np.where(k < length, data[np.clip(place, 0, max(len(data) - 1, 0))], 256).astype(np.uint64)
                code = code * np.uint64(257) + here
                out[:, 3 * side + k] = (mixed(code + np.uint64(k) * np.uint64(0x1234567)) & np.uint64(_AFFIXES - 1)).astype(np.int64)
        return out

    def grams(self):
        """(words, features) of the byte pairs, and of the byte triples, inside words."""
        data = self.data
        word = np.repeat(np.arange(len(self.starts), dtype=np.int32), self.ends - self.starts)
        at = np.arange(len(word)) + np.repeat(self.starts - np.r_[0, np.cumsum(self.ends - self.starts)[:-1]], self.ends - self.starts)
        two = word[:-1] == word[1:]
        three = two[:-1] & two[1:]
        at2, at3 = at[:-1][two], at[:-2][three]
        pair = data[at2] * 256 + data[at2 + 1]
        triple = (data[at3].astype(np.uint64) << np.uint64(16)) | (data[at3 + 1].astype(np.uint64) << np.uint64(8)) | data[at3 + 2]
        triple = (mixed(triple) & np.uint64(_TRIPLES - 1)).astype(np.int64)
        return (word[:-1][two], pair.astype(np.int64)), (word[:-2][three], triple)


def emissions(text: _Text, model: Crf) -> np.ndarray:
    """Scores of each word (rows) for each label."""
    n = len(text.starts)
    out = np.tile(model.bias, (n, 1))
    if not n:
        return out
    for (word, feature), weights in zip(text.grams(), (model.pairs, model.triples)):
        if len(word):
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            out[word[begin]] += np.add.reduceat(weights[feature], begin, axis=0)
    affix = text.affixes()
    for k in range(affix.shape[1]):
        out += model.affixes[affix[:, k]]
    if len(model.lexicon):
        place = np.minimum(np.searchsorted(model.lexicon, text.hashes), len(model.lexicon) - 1)
        known = model.lexicon[place] == text.hashes
        out[known] += model.of_lexicon[place[known]]
    return out


def label_shares(scores: np.ndarray, first: np.ndarray, model: Crf) -> np.ndarray:
    """The sum over each text's words (rows ``first[i]:first[i + 1]`` of ``scores``) of the chance of each label."""
    k, length = scores.shape[1], np.diff(first)
    out = np.zeros((len(length), k))
    texts = np.flatnonzero(length)
    if not len(texts):
        return out
    blocks = -(-length[texts] // _BLOCK)
    begin = np.r_[0, np.cumsum(blocks)]
    n = int(begin[-1])
    owner = np.repeat(np.arange(len(texts)), blocks)
    word = np.arange(len(scores)) - np.repeat(first[texts], length[texts])
    row = np.repeat(begin[:-1], length[texts]) + word // _BLOCK
    chance = np.ones((n, _BLOCK, k))
    used = np.zeros((n, _BLOCK), bool)
    chance[row, word % _BLOCK] = np.exp(scores - scores.max(axis=1, keepdims=True))
    used[row, word % _BLOCK] = True
    step = np.exp(model.step - model.step.max())
    start = np.exp(model.start - model.start.max())
    head = np.zeros(n, bool)
    head[begin[:-1]] = True

    # The transfer matrix of each block; a text's first step forgets what was before.
    whole = np.where(head[:, None, None], start[None, None, :], step[None, :, :]) * chance[:, 0, None, :]
    for s in range(1, _BLOCK):
        moved = (whole.reshape(-1, k) @ step).reshape(n, k, k) * chance[:, s, None, :]
        whole = np.where(used[:, s, None, None], moved, whole)
        whole /= whole.max(axis=(1, 2), keepdims=True)
    before, after = np.full((n, k), 1 / k), np.ones((n, k))
    by_length = np.argsort(-blocks, kind="stable")
    longer = np.searchsorted(-blocks[by_length], -np.arange(1, int(blocks.max()) + 1), side="right")  # texts with over j blocks
    for j in range(1, len(longer)):
        at = begin[by_length[:longer[j]]] + j
        moved = np.einsum("nk,nkl->nl", before[at - 1], whole[at - 1])
        before[at] = moved / moved.sum(axis=1, keepdims=True)
    for j in range(len(longer) - 1, 0, -1):
        at = begin[by_length[:longer[j]]] + j
        moved = np.einsum("nkl,nl->nk", whole[at], after[at])
        after[at - 1] = moved / moved.sum(axis=1, keepdims=True)

    alpha = np.empty((n, _BLOCK, k))
    now = before
    for s in range(_BLOCK):
        came = now @ step
        if s == 0:
            came[head] = start
        came = came * chance[:, s]
        now = np.where(used[:, s, None], came / came.sum(axis=1, keepdims=True), now)
        alpha[:, s] = now
    total, now = np.zeros((n, k)), after
    for s in range(_BLOCK - 1, -1, -1):
        both = alpha[:, s] * now
        total += np.where(used[:, s, None], both / both.sum(axis=1, keepdims=True), 0)
        went = (chance[:, s] * now) @ step.T
        now = np.where(used[:, s, None], went / went.sum(axis=1, keepdims=True), now)
    for label in range(k):
        out[texts, label] = np.bincount(owner, total[:, label], len(texts))
    return out


# ------------------------------------------------------------------ training


def training_segments(docs: DataFrame, text: str, label: str, rows: int = ROWS) -> list[tuple[str, str]]:
    """(segment, label): at most SEGMENTS from each of ``rows`` distinct texts of each label, or of all if it has fewer, wherever in them."""
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(label).alias("l"))
    draw = F.xxhash64("t", "l")
    # Copies share their draw, so the step counts distinct texts; twice as many, or 100 more, leave ``rows`` of them.
    counts = known.select("l", draw.alias("draw")).distinct().groupBy("l").agg(F.count("*").alias("n"))
    steps = counts.select("l", F.greatest(F.floor(F.col("n") / max(2 * rows, rows + 100)), F.lit(1)).alias("every"))
    some = known.join(F.broadcast(steps), "l").where(F.pmod(draw, "every") == 0).dropDuplicates(["t", "l"])
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("t"), "t"))
    some = some.withColumn("place", place).where(F.col("place") <= rows).select("t", "l")

    def run(batches):
        for batch in batches:
            out = []
            for t, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = t.split()
                cuts = list(range(0, len(words), SEGMENT_WORDS))
                for i in sorted({cuts[j * len(cuts) // SEGMENTS] for j in range(SEGMENTS)} if cuts else ()):
                    out.append({"t": " ".join(words[i:i + SEGMENT_WORDS]), "l": own})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("t", pa.string()), ("l", pa.string())]))

    found = some.select("t", F.col("l").cast("string").alias("l")).mapInArrow(run, "t string, l string").collect()
    return sorted((r.t, r.l) for r in found)


def train(segments: list[tuple[str, str]], epochs: int = EPOCHS, lexicon: int = LEXICON, seed: int = 5) -> Crf | None:
    """The model of labelled segments by penalised likelihood and Adam; None without segments.

    Half of the chains are a segment of one language, half the parts of two, so that
    switches are learned too.
    """
    labels = sorted({own for _, own in segments})
    if not labels:
        return None
    rng, k, cutter = np.random.default_rng(seed), len(labels), Words(SPACES)
    text = _Text(pa.array([t for t, _ in segments]), cutter)
    truth_of = np.array([labels.index(own) for _, own in segments])
    # Features of the distinct words of the sample.
    _, one, which = np.unique(text.hashes, return_index=True, return_inverse=True)
    owner = np.repeat(np.arange(len(segments)), np.diff(text.first))
    count = np.bincount(which * k + truth_of[owner], minlength=len(one) * k).reshape(-1, k).astype(np.float64)
    telling = (count + 0.1) / (count.sum(axis=0) + 0.1 * len(one))
    telling = count * (np.log(telling) - np.log(telling.mean(axis=1, keepdims=True)))
    listed = np.unique(np.concatenate([np.argsort(-telling[:, j], kind="stable")[:lexicon] for j in range(k)]))
    listed = listed[count[listed].max(axis=1) >= 2]
    sizes = [65536, _TRIPLES, _AFFIXES, len(listed), 1]
    base = np.r_[0, np.cumsum(sizes)]
    feature, word = _features(text, one, which, listed, base)
    order = np.argsort(word, kind="stable")
    feature, word = feature[order], word[order]
    begin = np.searchsorted(word, np.arange(len(one)))

    chains, truth = _chains(text.first, truth_of, which, rng)
    used = truth >= 0
    weights, step, start = np.zeros((base[-1], k)), np.eye(k), np.zeros(k)
    moment = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, step, start)]
    real = np.eye(k)[np.where(used, truth, 0)] * used[..., None]
    moved = np.einsum("nti,ntj->ij", real[:, :-1], real[:, 1:])
    for epoch in range(1, epochs + 1):
        scores = np.add.reduceat(weights[feature], begin, axis=0)
        chance, steps = _expected(scores[chains], used, step, start)
        slope = (chance - real)[used]
        grad = np.stack([np.bincount(chains[used], slope[:, j], len(one)) for j in range(k)], axis=1)
        down = np.stack([np.bincount(feature, grad[word, j], base[-1]) for j in range(k)], axis=1)
        slopes = [down + 0.5 * weights, steps - moved + 0.5 * step, (chance - real)[:, 0].sum(axis=0) + 0.5 * start]
        for x, slope, m in zip((weights, step, start), slopes, moment):
            slope = slope / len(chains)
            m[0] += 0.1 * (slope - m[0])
            m[1] += 0.001 * (slope ** 2 - m[1])
            x -= 0.08 * (m[0] / (1 - 0.9 ** epoch)) / (np.sqrt(m[1] / (1 - 0.999 ** epoch)) + 1e-8)
    parts = [weights[a:z].astype(np.float32) for a, z in zip(base, base[1:])]
    hashes = text.hashes[one[listed]]
    by_hash = np.argsort(hashes)
    return Crf(labels, parts[0], parts[1], parts[2], hashes[by_hash], parts[3][by_hash], parts[4][0].astype(np.float64), step, start)


def _features(text, one, which, listed, base):
    first_use = np.full(len(text.starts), -1)
    first_use[one] = np.arange(len(one))
    feature, word = [], []
    for (own, codes), shift in zip(text.grams(), base):
        own = first_use[own]
        feature.append(codes[own >= 0] + shift)
        word.append(own[own >= 0])
    affix = text.affixes()[one]
    feature.append((affix + base[2]).ravel())
    word.append(np.repeat(np.arange(len(one)), affix.shape[1]))
    feature += [base[3] + np.arange(len(listed)), np.full(len(one), base[4])]
    word += [listed, np.arange(len(one))]
    return np.concatenate(feature), np.concatenate(word)


def _chains(first, truth_of, which, rng):
    """Word numbers and labels (-1: no word) of the training chains."""
    order = rng.permutation(len(truth_of))
    chains = np.zeros((len(order), SEGMENT_WORDS), np.int64)
    truth = np.full((len(order), SEGMENT_WORDS), -1)
    for row, i in enumerate(order):
        j = order[(row + 1) % len(order)] if row % 2 else i
        half = SEGMENT_WORDS // 2 if row % 2 else SEGMENT_WORDS
        parts = [(i, which[first[i]:first[i + 1]][:half])]
        if row % 2:
            parts.append((j, which[first[j]:first[j + 1]][-half:]))
        words = np.concatenate([w for _, w in parts])
        chains[row, :len(words)] = words
        truth[row, :len(words)] = np.concatenate([np.full(len(w), truth_of[n]) for n, w in parts])
    return chains, truth


def _expected(scores, used, step, start):
    """Chances of labels per word and expected steps, by forward-backward over chains of one length."""
    n, length, k = scores.shape
    chance = np.exp(scores - scores.max(axis=2, keepdims=True))
    step, start = np.exp(step - step.max()), np.exp(start - start.max())
    alpha, beta = np.empty((n, length, k)), np.ones((n, length, k))
    for t in range(length):
        came = (start if t == 0 else alpha[:, t - 1] @ step) * chance[:, t]
        alpha[:, t] = np.where(used[:, t, None], came / came.sum(axis=1, keepdims=True), alpha[:, t - 1] if t else 1 / k)
    steps = np.zeros((k, k))
    for t in range(length - 1, 0, -1):
        ahead = chance[:, t] * beta[:, t]
        pair = alpha[:, t - 1, :, None] * step[None] * ahead[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        steps += pair[used[:, t]].sum(axis=0)
        went = ahead @ step.T
        beta[:, t - 1] = np.where(used[:, t, None], went / went.sum(axis=1, keepdims=True), beta[:, t])
    both = alpha * beta
    return both / both.sum(axis=2, keepdims=True) * used[..., None], steps


# ------------------------------------------------------------------- scoring


def _letters(column: pa.Array) -> list[bool]:
    """Whether each text has a letter."""
    offsets, data = utf8(column)
    low = data | 32
    ascii_ = np.r_[0, np.cumsum((low >= 97) & (low <= 122) & (data < 128))]
    found = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    return [bool(yes) or any(c.isalpha() for c in column[i].as_py()) for i, yes in enumerate(found)]


def predicted(docs: DataFrame, text: str, model: Crf | None) -> DataFrame:
    """The columns of ``docs``, and ``lang_pred`` and ``score``.

    ``lang_pred`` is the label with the largest mean chance over the words of the
    whole text (ties: the first by name) and ``score`` that mean; a text that is
    null, empty or without a letter, and any text if there is no model, gets ``und``
    and 0.  Words are lower-cased (A-Z) runs without ASCII white space.  Only the
    text is looked at, so repeated rows have equal results; columns named like the
    added ones are replaced; no rows give no rows.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the tables and LEXICON

    def run(batches):
        cutter, crf = Words(SPACES), shared.value
        for batch in batches:
            column = text_column(batch.column(kept.index(text)))
            for start, stop in pieces(column):
                part = column.slice(start, stop - start)
                langs, scores = [UNDETERMINED] * len(part), [0.0] * len(part)
                if crf is not None:
                    words = _Text(part, cutter)
                    shares = label_shares(emissions(words, crf), words.first, crf)
                    best = shares.argmax(axis=1)
                    for i, letter in enumerate(_letters(part)):
                        if letter:
                            langs[i] = crf.labels[best[i]]
                            scores[i] = min(1.0, float(shares[i, best[i]] / (words.first[i + 1] - words.first[i])))
                rest = [batch.column(i).slice(start, stop - start) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(langs), pa.array(scores)], [*kept, "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept]
    return docs.select(*kept).mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
