import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (SparkSession.builder.master("local[8]").appName("msgflow-tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def models(spark):
    """Small models fitted on the written examples, and a knowledge base of the same texts."""
    from pyspark.sql import functions as F

    from msgflow.examples import intent_examples, sentiment_examples
    from msgflow.operators.features import SENTIMENT_TERMS, TermRule
    from msgflow.plans import classifiers as K
    from msgflow.plans.knowledge import build_vectors
    from msgflow.plans.message_flow import MessageModels
    from msgflow.staging import stage

    samples = {
        "en": "where is my order and when will it arrive today with the other things i bought from your shop",
        "de": "wo ist meine bestellung und wann kommt sie heute mit den anderen sachen aus dem laden an",
        "es": "dónde está mi pedido y cuándo va a llegar hoy con las otras cosas que compré en la tienda",
        "fr": "où est ma commande et quand va-t-elle arriver avec les autres choses de votre magasin",
    }
    rows = [(i, text, lang) for i, (lang, text) in enumerate(samples.items())]
    language = K.train_language(spark.createDataFrame(rows, "id long, text string, label string"))
    intents = stage(intent_examples(spark), "intents")
    intent = K.fit_classifier(intents, "text", "routing_intent", TermRule("word", 2, 20_000), c=100.0, balanced=True)
    feelings = stage(sentiment_examples(spark), "feelings")
    sentiment = K.fit_classifier(feelings, "text", "sentiment", TermRule("word", 2, 20_000, max_words=SENTIMENT_TERMS.max_words),
                                 c=100.0, balanced=True)
    kb = intents.select((F.row_number().over(_by_text()) - 1).cast("long").alias("doc_id"),
                        F.col("text").alias("instruction"), F.concat(F.lit("Answer to: "), "text").alias("response"),
                        F.lit("raw").alias("intent"), F.upper("routing_intent").alias("category"))
    kb = stage(kb, "kb")
    features, vectors = build_vectors(kb)
    return MessageModels(language, sentiment, intent, kb, features, vectors)


def _by_text():
    from pyspark.sql import Window

    return Window.orderBy("text")
