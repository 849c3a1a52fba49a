import hashlib
import random
import time

import public_tokenizers
import pytest
import sentencepiece

from msgflow.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.read_tables(PATH))


def texts(library):
    rng = random.Random(5)
    letters = "ab  \n\t▁éüß你好世界😀0123456789<>/sthe  membres"
    listed = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    runs = "▁membres membre the and ing aaaaaaaaaaaa ssssss nnnn ......... -------- ====== stock international é".split()
    out = ["", " ", "  ", "\n", "a", "▁", "\0a\0", " " * 40, "x" * 3000, "</s><s><unk><0x0A>", "a\r\nb"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(2000)]
    out += ["".join(rng.choice(listed) for _ in range(rng.randrange(1, 25))) for _ in range(4000)]
    return out + ["".join(rng.choice(runs) + rng.choice(["", "", " ", "  "]) for _ in range(rng.randrange(1, 25))) for _ in range(2000)]


def test_ids_equal_the_library(library, encoder):
    every = texts(library)
    got, want = encoder.encode(every), library.encode(every)
    assert all(g == w + [library.eos_id()] for g, w in zip(got, want))


def test_memory_may_start_anew(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    own = pieces.Encoder(pieces.read_tables(PATH))
    every = texts(library)[:600]
    got = [ids for i in range(0, 600, 40) for ids in own.encode(every[i:i + 40])]
    assert got == [w + [library.eos_id()] for w in library.encode(every)]


def test_tables_of_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "two words"), (3, "two words"), (4, "é\n" * 500)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    got = pieces.encoded(df, "text", PATH).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((d, library.encode(t or "") + [2]) for d, t in rows)
    sums = pieces.digests(df, "text", PATH).collect()
    for r, (d, t) in zip(sorted(sums), sorted(rows, key=lambda r: r[0])):
        ids = library.encode(t or "") + [2]
        assert (r.doc_id, r.n_tokens, r.ids) == (d, len(ids), "x")
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest() and library.decode(ids) == (t or "")
    assert pieces.digests(df.limit(0), "text", PATH).collect() == []


def test_long_runs_equal_the_library_in_little_time():
    """Runs whose merges go one by one, alone, around words and beside each other, up to 100,000 characters."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, tables = sentencepiece.SentencePieceProcessor(model_file=path), pieces.read_tables(path)
    rng = random.Random(12)
    texts = [c * n for c in (" ", "=", "-", "_", "\n", "\t", "1", "a", "é", "ha") for n in (63, 64, 65, 66, 1000)] + [" " * 100_000, "=" * 100_000]
    texts += ["".join(rng.choice(("word", "x", " " * rng.randint(1, 300), "\n", "--" * rng.randint(1, 200))) for _ in range(60)) for _ in range(20)]
    start = time.monotonic()
    got = pieces.Encoder(tables).encode(texts)
    assert time.monotonic() - start < 30  # a merge a round took a minute for 32,000 spaces
    assert got == [model.encode(t) + [model.eos_id()] for t in texts]


def test_common_tokens_stay_in_a_small_memory(library, monkeypatch):
    """What every text holds is encoded once, whatever else fills the memory, which stays within its bound."""
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    merged, rounds = [], pieces.merge_rounds
    monkeypatch.setattr(pieces, "merge_rounds", lambda tokens, tables: merged.extend(tokens) or rounds(tokens, tables))
    own = pieces.Encoder(pieces.read_tables(PATH))
    for i in range(40):
        text = f"common words and x{i} y{i} z{i}"
        assert own.encode([text]) == [library.encode(text) + [library.eos_id()]]
        assert len(own.known) + len(own.before) <= 40
    assert merged.count(pieces.SPACE + "common") == 1


def test_digests_take_texts_in_small_batches(spark, monkeypatch):
    setting, met = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, keep = spark.conf.get(setting), pieces.stage
    monkeypatch.setattr(pieces, "stage", lambda df, name: met.append(spark.conf.get(setting)) or keep(df, name))
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert pieces.digests(df, "text", PATH).count() == 1
    assert met == ["4m"] and spark.conf.get(setting) == before
