"""Column forms against plain Python on generated text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from msgflow import values
from msgflow.functions import text as X
from msgflow.functions.smalltalk import small_talk
from msgflow.functions.terms import char_terms, word_terms

PIECES = ["Hi", " ", "  ", "\n", "\t", " ", " ", "\x1c", "é", "ß", "Ärger", "http://a.b/c", "HTTPS://X.Y", "www.z",
          "www.", "{{Order Number}}", "{{", "}}", "{{a\nb}}", "😀", "我的订单", "I'm", "_x", "2²", "hello", "bye", "thanks",
          "you", "so much", "see you later", "take care", ",", "!", "हिन्दी", "a", "ab", "ſee you", "good morning", "$1", "\\"]


def texts(n=400, seed=5):
    rng = random.Random(seed)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9))) for _ in range(n)]
    return made + ["", " ", "\x1f　", None]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "id int, text string").repartition(5)


def check(frame, column, expected):
    got = {r.id: r.v for r in frame.select("id", column.alias("v")).collect()}
    for i, t in enumerate(texts()):
        assert got[i] == expected(t), repr(t)


def test_clean_language(frame):
    def plain(t):
        t = re.sub(r"http\S+|www\.\S+", " ", (t or "").lower())
        return " ".join(t.split())

    check(frame, X.clean_language_text(F.col("text")), plain)


def test_clean_intent(frame):
    check(frame, X.clean_intent_text(F.col("text")), lambda t: None if t is None else " ".join(t.lower().split()))


def test_placeholders(frame):
    check(frame, X.normalise_placeholders(F.col("text")),
          lambda t: None if t is None else re.sub(r"\{\{.*?\}\}", lambda m: values.PLACEHOLDER_TOKEN, t))
    check(frame, X.normalise_placeholders(F.col("text"), "$1\\"),
          lambda t: None if t is None else re.sub(r"\{\{.*?\}\}", lambda m: "$1\\", t))


def test_blank(frame):
    check(frame, X.is_blank(F.col("text")), lambda t: not (t or "").strip())


def test_preview(frame):
    check(frame, X.preview(F.col("text"), 5), lambda t: None if t is None else t[:5] + ("..." if len(t) > 5 else ""))


def test_words(frame):
    check(frame.where("text is not null").union(frame.where("text is null").fillna("")), X.words(F.col("text")),
          lambda t: (t or "").split())


def test_small_talk(frame):
    s, b = r"\s", r"\b"
    patterns = {k: re.compile(v.replace("{s}", s).replace("{b}", b).replace("{e}", b), re.I)
                for k, v in values.SMALL_TALK_PATTERNS.items()}

    def plain(t):
        if t is None:
            return None
        t = t.lower().strip()
        for label, pattern in patterns.items():
            if pattern.search(t) and not set(re.findall(r"\w+", pattern.sub("", t))) - set(values.SMALL_TALK_FILLERS):
                return label
        return None

    check(frame, small_talk(X.clean_intent_text(F.col("text"))), lambda t: plain(" ".join(t.split()) if t else t))


@pytest.mark.parametrize("text,label", [
    ("Hello there!", "greeting"), ("good evening 😀", "greeting"), ("Bye, talk later", "goodbye"), ("take care", "goodbye"),
    ("thx", "gratitude"), ("Thank you very much, team", "gratitude"), ("hello, where is my order", None),
    ("hi thanks", None), ("thanks, you're great", None), ("ébye", None), ("byeé", None), ("thanks in advance, where is it", None),
    ("so good bye and have a great day", "goodbye"), ("this and that", None),
])
def test_small_talk_cases(spark, text, label):
    row = spark.createDataFrame([(text,)], "text string").select(small_talk(F.col("text")).alias("v")).first()
    assert row.v == label


@pytest.mark.parametrize("low,high", [(1, 3), (2, 4), (3, 3)])
def test_char_terms(frame, low, high):
    def plain(t):
        found = []
        for w in (t or "").lower().split():
            w = f" {w} "
            for n in range(low, high + 1):
                found += [w[i:i + n] for i in range(len(w) - n + 1)]
        return sorted(found)

    check(frame, F.array_sort(char_terms(F.col("text"), low, high)), plain)


@pytest.mark.parametrize("max_n,cut", [(1, None), (2, None), (3, None), (2, 3)])
def test_word_terms(frame, max_n, cut):
    def plain(t):
        w = re.findall(r"(?u)\b\w\w+\b", (t or "").lower())[:cut]
        return [" ".join(w[i:i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    check(frame, word_terms(F.col("text"), max_n, cut), plain)
