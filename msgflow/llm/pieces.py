"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A text is cut into tokens (spaces with the word after them) that no piece of the
vocabulary crosses, and every distinct token is encoded once per task.  All new
tokens of a batch are encoded together: one flat array of symbols, and in each
round every token merges its pair of lowest rank, all its leftmost occurrences at
once; finished tokens leave the array, until no pair remains.

Several occurrences at once equal the library's one-by-one order only if the new
piece cannot take part in a merge of lower rank.  For pieces where it can (found
when the tables are built), a round merges a token's leftmost occurrence alone; a
long token with such pieces, such as a run of spaces, is finished by a queue of its pairs.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from msgflow.llm.words import pieces as text_pieces, text_column
from msgflow.staging import in_small_batches, stage

SPACE = "▁"
_FREE = 1 << 20  # symbols from here are characters that no piece holds
_WIDE = np.int64(1 << 22)
_NONE = np.iinfo(np.int64).max

#: A token of more symbols whose merges have to go one by one leaves the rounds for a queue of its own.
LONG = 64

#: Distinct tokens that a task remembers, and as many from before; tokens not met meanwhile are forgotten, which changes no result.
REMEMBERED = 150_000


class Tables(NamedTuple):
    """What the merge rounds need of a vocabulary."""

    size: int
    symbol: dict  # character -> symbol
    text: list  # symbol -> its characters
    bytes_: list  # byte value -> id
    pairs: np.ndarray  # left * _WIDE + right, sorted
    merged: np.ndarray  # the piece of each pair
    rank: np.ndarray  # symbol -> merge rank of that piece
    alone: np.ndarray  # symbol -> one occurrence a round only
    token: str  # pattern of the tokens
    end: int


def read_tables(path: str) -> Tables:
    """The merge tables of a BPE model with byte fallback, dummy prefix and no normalisation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
    text = [model.id_to_piece(i) for i in range(n)]
    score = [model.get_score(i) for i in range(n)]
    ids = {t: i for i, t in enumerate(text) if i not in special}
    if any(SPACE in t.lstrip(SPACE) for t in ids):
        raise ValueError("the vocabulary has pieces with a space inside, so texts cannot be cut at spaces")
    symbol = dict(ids)
    for t in ids:
        for c in t:
            if c not in symbol:
                symbol[c] = len(text)
                text.append(c)
    ranks = {s: r for r, s in enumerate(sorted(set(score[i] for i in ids.values()), reverse=True))}
    rank = np.full(len(text), _NONE, np.int64)
    for i in ids.values():
        rank[i] = ranks[score[i]]
    alone = np.zeros(len(text), bool)
    pairs, merged = [], []
    for t, i in ids.items():
        for k in range(1, len(t)):
            left, right = symbol.get(t[:k]), symbol.get(t[k:])
            if left is not None and right is not None:
                pairs.append(left * int(_WIDE) + right)
                merged.append(i)
                for part in (left, right):
                    alone[part] |= len(text[part]) > 1 and rank[i] <= rank[part]
    order = np.argsort(np.array(pairs, np.int64), kind="stable")
    lines = "".join(c for c in "\n\r\t" if not any(c in t for t in ids))
    token = f"{SPACE}*[^{SPACE}{re.escape(lines)}]+|{SPACE}+" + (f"|[{re.escape(lines)}]" if lines else "")
    bytes_ = [next((i for i in special if text[i] == f"<0x{b:02X}>"), model.unk_id()) for b in range(256)]
    return Tables(n, {c: s for c, s in symbol.items() if len(c) == 1}, text, bytes_, np.array(pairs, np.int64)[order],
                  np.array(merged, np.int64)[order], rank, alone, token, model.eos_id())


def merge_rounds(tokens: list[str], t: Tables) -> list[tuple[int, ...]]:
    """The ids of each (not empty) token."""
    symbols = np.array([t.symbol.get(c, _FREE + ord(c)) for c in chain.from_iterable(tokens)], np.int64)
    owner = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
    done: list = [None] * len(tokens)
    while len(symbols):
        rank, piece = _pair_ranks(symbols, owner, t)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        least = np.minimum.reduceat(rank, first)
        lengths = np.diff(np.r_[first, len(symbols)])
        for k in np.flatnonzero(least == _NONE):
            done[owner[first[k]]] = _ids(symbols[first[k]:first[k] + lengths[k]], t)
        least_here = np.repeat(least, lengths)
        going = least_here != _NONE
        chosen = (rank == least_here) & going
        at = np.flatnonzero(chosen)
        if not len(at):
            break
        # Of pairs that overlap (a run of neighbours), the first, third, ... are merged.
        begins = np.r_[True, np.diff(at) != 1]
        run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        odd = (np.arange(len(at)) - run) % 2 == 1
        leftmost = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
        single = np.zeros(len(tokens), bool)
        single[owner[at[t.alone[piece[at]]]]] = True
        for k in np.flatnonzero(single[owner[first]] & (lengths > LONG)):  # a merge a round would take as many rounds
            a, z = first[k], first[k] + lengths[k]
            done[owner[a]] = _ids(np.array(_in_order(symbols[a:z].tolist(), t), np.int64), t)
            going[a:z] = False
        at = at[~odd & (leftmost | ~single[owner[at]]) & going[at]]
        symbols = symbols.copy()
        symbols[at] = piece[at]
        going[at + 1] = False
        symbols, owner = symbols[going], owner[going]
    return done


def _in_order(symbols: list[int], t: Tables) -> list[int]:
    """All merges of one token, one by one: the lowest rank first, of equal ones the leftmost."""
    after, before = [*range(1, len(symbols)), -1], [-1, *range(len(symbols) - 1)]
    known: dict = {}

    def pair(i):
        j = after[i]
        if j < 0:
            return
        key = (symbols[i], symbols[j])
        if key not in known:
            number = key[0] * int(_WIDE) + key[1]
            place = int(np.searchsorted(t.pairs, number))
            met = place < len(t.pairs) and t.pairs[place] == number
            known[key] = (int(t.rank[t.merged[place]]), int(t.merged[place])) if met else None
        if known[key] is not None:
            heapq.heappush(queue, (known[key][0], i, j, *key))

    queue: list = []
    for i in range(len(symbols)):
        pair(i)
    while queue:
        _, i, j, left, right = heapq.heappop(queue)
        if after[i] != j or symbols[i] != left or symbols[j] != right:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = known[left, right][1], -1
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        if before[i] >= 0:
            pair(before[i])
        pair(i)
    return [x for x in symbols if x >= 0]


def _pair_ranks(symbols, owner, t):
    """Rank and piece of the pair that each symbol forms with the next one of its token."""
    key = np.full(len(symbols), -1, np.int64)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    key[inner] = symbols[inner] * _WIDE + symbols[inner + 1]
    place = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
    known = t.pairs[place] == key
    piece = np.where(known, t.merged[place], 0)
    return np.where(known, t.rank[piece], _NONE), piece


def _ids(symbols, t) -> tuple[int, ...]:
    out = []
    for s in symbols.tolist():
        if s < t.size:
            out.append(s)
        else:
            out += [t.bytes_[b] for b in (chr(s - _FREE) if s >= _FREE else t.text[s]).encode()]
    return tuple(out)


class Encoder:
    """Encodes texts, remembering the tokens it has met."""

    def __init__(self, tables: Tables, end: bool = True):
        self.tables, self.known, self.before, self.find = tables, {}, {}, re.compile(tables.token).findall
        self.end = (tables.end,) if end else ()
        self.number = list(range(tables.size))  # one object for each id, however many tokens hold it

    def tokens(self, texts: list[str]) -> list[list[str]]:
        """The tokens of each text, all of them known from then on."""
        cut = [self.find(SPACE + x.replace(" ", SPACE)) if x else [] for x in texts]
        fresh = set(chain.from_iterable(cut)).difference(self.known)
        if fresh and len(self.known) + len(fresh) > REMEMBERED:
            self.known, self.before = {}, self.known
            fresh = set(chain.from_iterable(cut))
        new = []
        for x in fresh:
            if x in self.before:
                self.known[x] = self.before[x]
            else:
                new.append(x)
        for x, ids in zip(new, merge_rounds(new, self.tables)):
            self.known[x] = (tuple([self.number[i] for i in ids]), " ".join(map(str, ids)))
        return cut

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(chain.from_iterable(self.known[x][0] for x in cut)) + list(self.end) for cut in self.tokens(texts)]

    def encode_with_text(self, texts: list[str]):
        """Ids, and the decimal ids joined by one space, of each text."""
        end = [str(i) for i in self.end]
        for cut in self.tokens(texts):
            met = [self.known[x] for x in cut]
            yield (list(chain.from_iterable([m[0] for m in met])) + list(self.end), " ".join([m[1] for m in met] + end))


def encoded(docs: DataFrame, text: str, model_path: str) -> DataFrame:
    """The columns of ``docs`` without the text, and ``ids array<int>``: its pieces and an end id.

    Null counts as the empty text, which gives the end id alone.  Rows are encoded
    one by one whatever the others hold, so repeated rows get equal ids; a column of
    ``docs`` named ``ids`` is replaced.  No rows give no rows.
    """

    def rows(encoder, _, texts):
        return [pa.array(encoder.encode(texts), pa.list_(pa.int32()))]

    return _mapped(docs, text, model_path, {"ids": "array<int>"}, rows)


@in_small_batches
def digests(docs: DataFrame, text: str, model_path: str) -> DataFrame:
    """The columns of ``docs`` without the text, and n_tokens, ids_sha256 and decoded_sha256.

    The ids are those of :func:`encoded`; ``ids_sha256`` is over the decimal ids
    joined by one space, ``decoded_sha256`` over the UTF-8 text that the library's
    ``decode`` makes of them.  The table is staged, so that texts come in small batches.
    """

    def rows(encoder, model, texts):
        count, ids_sha, text_sha = [], [], []
        for ids, written in encoder.encode_with_text(texts):
            count.append(len(ids))
            ids_sha.append(hashlib.sha256(written.encode()).hexdigest())
            text_sha.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
        return [pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

    return stage(_mapped(docs, text, model_path, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, rows), "digests")


def _mapped(docs, text, model_path, added, rows):
    kept = [c for c in docs.columns if c != text and c not in added]
    tables = docs.sparkSession.sparkContext.broadcast(read_tables(model_path))

    def run(batches):
        import sentencepiece

        model, encoder = sentencepiece.SentencePieceProcessor(model_file=model_path), Encoder(tables.value)
        for batch in batches:
            column = text_column(batch.column(len(kept)))
            for start, stop in text_pieces(column):
                rest = [batch.column(i).slice(start, stop - start) for i in range(len(kept))]
                made = rows(encoder, model, column.slice(start, stop - start).to_pylist())
                yield pa.RecordBatch.from_arrays([*rest, *made], [*kept, *added])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept]
    return docs.select(*kept, text).mapInArrow(run, ", ".join([*fields, *[f"{k} {v}" for k, v in added.items()]]))
