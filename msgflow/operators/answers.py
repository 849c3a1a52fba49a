"""Answers to prompts: the best hit's response, or a batch hook on the executors."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from msgflow import values
from msgflow.functions.prompting import PromptRules


def default_answer(responses: Column) -> Column:
    """The response of the best document; the fallback when there is none."""
    return F.coalesce(F.get(responses, 0), F.lit(values.ANSWER_FALLBACK))


def hook_answers(df: DataFrame, make_hook: Callable[..., Callable[[str], str]], key: str = "message_id",
                 prompt: str = "prompt", rules: PromptRules = PromptRules()) -> DataFrame:
    """(key, answer, error): ``make_hook`` runs once per task and returns prompt -> answer.

    A ``make_hook`` with a parameter is given the ``rules``: the system text, which stands
    before every prompt, and the temperature.  A prompt that fails gets the fallback and
    its error text; the others go on.
    """
    fallback = values.ANSWER_FALLBACK
    given = (rules,) if inspect.signature(make_hook).parameters else ()
    schema = T.StructType([df.schema[key], T.StructField("answer", T.StringType()),
                           T.StructField("error", T.StringType())])

    def run(batches):
        import pandas as pd

        hook = broken = None
        try:
            hook = make_hook(*given)
        except Exception as problem:  # noqa: BLE001 - every prompt of the task reports it
            broken = str(problem)

        def answer(text):
            if hook is None:
                return fallback, broken
            try:
                return hook(text), None
            except Exception as problem:  # noqa: BLE001
                return fallback, str(problem)

        for batch in batches:
            said = [answer(text) for text in batch[prompt]]
            yield pd.DataFrame({key: batch[key], "answer": [a for a, _ in said], "error": [e for _, e in said]})

    return df.select(key, prompt).mapInPandas(run, schema)


def hook_embeddings(df: DataFrame, make_encoder: Callable, key: str, text: str) -> DataFrame:
    """(key, embedding, embedding_error): see :class:`EncoderFeatures`."""
    return EncoderFeatures(make_encoder).arrays(df.select(key, text), text).drop(*({text} - {key}))


class EncoderFeatures:
    """A dense encoder in the place of term weights.

    ``make_encoder`` runs once per task and returns list of texts -> list of vectors;
    these are scaled to unit length.  If a batch fails its texts are encoded one by
    one, and a text that fails has a null vector and its error.
    """

    def __init__(self, make_encoder: Callable[[], Callable[[list], list]]):
        self.make_encoder = make_encoder

    def arrays(self, df: DataFrame, text: str, output: str = "embedding", hold: Callable | None = None) -> DataFrame:
        """Add ``output`` and ``{output}_error``; nothing is kept, so ``hold`` is not used."""
        from msgflow.operators.features import unit_length

        make_encoder, place = self.make_encoder, df.columns.index(text)
        schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.DoubleType())),
                               T.StructField(f"{output}_error", T.StringType())])

        def run(batches):
            import pyarrow as pa

            encode = broken = None
            try:
                encode = make_encoder()
            except Exception as problem:  # noqa: BLE001 - every text of the task reports it
                broken = str(problem) or type(problem).__name__

            def plain(vectors):
                return [[float(x) for x in v] for v in vectors]

            def one(text):
                if encode is None:
                    return None, broken
                try:
                    return plain(encode([text]))[0], None
                except Exception as problem:  # noqa: BLE001
                    return None, str(problem) or type(problem).__name__

            for batch in batches:
                texts = batch.column(place).to_pylist()
                try:
                    vectors, errors = plain(encode(texts)), [None] * len(texts)
                    if len(vectors) != len(texts):
                        raise ValueError("one vector for each text is needed")
                except Exception:  # noqa: BLE001
                    vectors, errors = zip(*map(one, texts)) if texts else ([], [])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(list(vectors), pa.list_(pa.float64())), pa.array(list(errors), pa.string())],
                    [*batch.schema.names, output, f"{output}_error"])

        return df.mapInArrow(run, schema).withColumn(output, unit_length(F.col(output)))
