"""Terms of a text, and sparse vectors as Spark ML vectors or as plain arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, functions as F, types as T

from msgflow.functions.text import WORD, collapse_spaces

_PARTS = T.StructType([
    T.StructField("type", T.ByteType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("indices", T.ArrayType(T.IntegerType())),
    T.StructField("values", T.ArrayType(T.DoubleType())),
])


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def char_terms(text: Column, min_n: int = 1, max_n: int = 3) -> Column:
    """Character n-grams inside words padded with one space on each side.

    The words are laid out as " one  two  three ": an n-gram lies inside one word
    exactly if it holds no double space.  A zero-width match per position lists
    them; a match never starts inside a surrogate pair.  ``min_n`` is at most 3,
    the length of the shortest padded word.
    """
    if not 1 <= min_n <= 3 or max_n < min_n:
        raise ValueError("n-gram sizes need 1 <= min_n <= 3 and min_n <= max_n")
    one = r"[^\p{Cs}]"

    def grams(laid_out: Column) -> Column:
        found = []
        for n in range(min_n, max_n + 1):
            if n == 1:
                found.append(F.split(laid_out, ""))
            else:
                window = f"(?=((?:(?!  ){one}){{{n - 1}}}{one}))"
                found.append(F.regexp_extract_all(laid_out, F.lit(window), 1))
        return F.concat(*found)

    def lay_out(plain: Column) -> Column:
        return F.concat(F.lit(" "), F.replace(plain, F.lit(" "), F.lit("  ")), F.lit(" "))

    none = F.array().cast("array<string>")
    plain = collapse_spaces(F.lower(F.coalesce(text, F.lit(""))))
    return once(plain, lambda p: F.when(p == "", none).otherwise(once(lay_out(p), grams)))


def word_terms(text: Column, max_n: int = 2, max_words: int | None = None) -> Column:
    """Tokens of at least two word characters, and their n-grams joined by a space.

    ``max_words`` cuts the token list first (the input length of a model).
    """
    none = F.array().cast("array<string>")

    def runs(tokens: Column) -> Column:
        found = [tokens]
        for n in range(2, max_n + 1):
            # Joined neighbour by neighbour; the padding at the end gives nulls.
            tail = F.when(F.size(tokens) >= n, F.slice(tokens, n, F.size(tokens))).otherwise(none)
            joined = F.zip_with(found[-1], tail, lambda a, b: F.concat(a, F.lit(" "), b))
            found.append(F.filter(joined, lambda g: g.isNotNull()))
        return F.concat(*found)

    lowered = F.lower(F.coalesce(text, F.lit("")))
    tokens = F.regexp_extract_all(lowered, F.lit(f"{WORD}{{2,}}"), 0)
    return once(tokens if max_words is None else F.slice(tokens, 1, max_words), runs)


# Spark has no expression that opens or builds a sparse ML vector; JSON carries
# its fields there and back, exactly, without leaving the JVM.

def vector_parts(vector: Column) -> Column:
    """struct(type, size, indices, values) of a sparse ML vector."""
    schema = T.StructType([T.StructField("v", _PARTS)])
    return F.from_json(F.to_json(F.struct(vector.alias("v"))), schema)["v"]


def sparse_vector(size: Column, indices: Column, numbers: Column) -> Column:
    """A sparse ML vector from its fields."""
    schema = T.StructType([T.StructField("v", VectorUDT())])
    parts = F.struct(F.lit(0).alias("type"), size.alias("size"),
                     indices.alias("indices"), numbers.alias("values"))
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), schema)["v"]
