import hashlib
import inspect
import os

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from msgflow.llm import queries
from msgflow.staging import stage
from tools.check_oracles import compare, duck

from .helpers import near_components
from .test_line_chunks import plain_dedup
from .test_winnow import plain as plain_contamination

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    """The documents, with nulls, blanks, repeated rows, near copies and columns whose names a stage also uses."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = F.concat(F.col("text"), F.lit("\nand one line more for this near copy"))
    more = docs.where("doc_id < 10").withColumn("doc_id", F.col("doc_id") + 5000).withColumn("text", text)
    odd = docs.where("doc_id = 11").select((F.col("doc_id") + 6000).alias("doc_id"), F.explode(F.array(
        F.lit(None).cast("string"), F.lit(""), F.lit("12 34 !"))).alias("text"), "lang", "source", "n_chars")
    every = docs.unionByName(more).unionByName(odd).unionByName(docs.where("doc_id = 3"))
    every = every.withColumns({"score": F.lit("own"), "n_removed": F.lit("own"), "lang_pred": F.lit("own"), "component_id": F.lit(1)})
    return stage(every.repartition(5), "given")


@pytest.fixture(scope="module")
def staged(spark, given):
    out = [given]
    for name, function in corpus_pipeline.STAGES:
        out.append(stage(function(spark, out[-1], DATA), name))
    return out


def test_shape():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "encoding"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)


def test_all_stages_but_the_last_keep_the_columns(staged):
    for out in staged[1:-1]:
        assert out.columns == staged[0].columns and [f.dataType for f in out.schema] == [f.dataType for f in staged[0].schema]


def test_language_id_rejects_what_has_no_letter(staged):
    before, after = (sorted((r.doc_id, r.text or "") for r in x.collect()) for x in staged[:2])
    assert after == [r for r in before if any(c.isalpha() for c in r[1])]


def test_line_dedup(staged):
    before = {r.doc_id: r.text for r in staged[1].collect()}
    want = plain_dedup(list(before.items()), 40)
    want = {d: t for d, t in want.items() if t == before[d] or t.split()}
    rows = staged[2].collect()
    assert {r.doc_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows if r.text != before[r.doc_id])


def test_one_document_of_each_group_stays(staged):
    docs = {r.doc_id: r.text for r in staged[2].collect()}
    groups = near_components(list(docs.items()), 5, 80, 100)
    assert sorted(r.doc_id for r in staged[3].collect()) == sorted(set(groups.values()))


def test_contaminated_documents_go(spark, staged):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in staged[3].collect()]
    clean = {d for d, *_, bad in plain_contamination(docs, items, 13) if not bad}
    assert {str(r.doc_id) for r in staged[4].collect()} == clean and len(clean) < len(docs)


def test_encoding(staged):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in staged[4].collect()}
    rows = staged[5].collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = model.encode(texts[r.doc_id]) + [model.eos_id()]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_no_documents(spark, given):
    docs = given.limit(0)
    for _, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, DATA), "none")
    assert docs.count() == 0 and "ids_sha256" in docs.columns


def test_every_operator_is_registered():
    names = entry_points.queries()
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= {x.split("_")[0] for x in names}
    assert set(queries.ORACLES) <= set(queries.QUERIES) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, duck(DATA), name, queries.QUERIES[name], queries.ORACLES[name], DATA) is None


def test_nothing_else_imports_the_package():
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for folder in ("msgflow", "catalog", "tools"):
        for path, _, files in os.walk(os.path.join(root, folder)):
            if not path.endswith(os.sep + "llm"):
                for name in files:
                    if name.endswith(".py"):
                        with open(os.path.join(path, name)) as file:
                            assert "msgflow.llm" not in file.read() and "corpus_pipeline" not in name
