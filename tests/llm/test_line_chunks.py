import random

import pytest
from pyspark.sql import functions as F

from msgflow.llm import line_chunks


def plain_passages(rows, least):
    """(first, last, lines with words) of every shortest passage, by line number."""
    words = [sum(w != "" for w in x.split(" ")) for x in rows]
    full = [i for i, w in enumerate(words) if w]
    spans = set()
    for a in range(len(full)):
        for z in range(a, len(full)):
            if sum(words[i] for i in full[a:z + 1]) >= least:
                if sum(words[i] for i in full[a:z]) < least or sum(words[i] for i in full[a + 1:z + 1]) < least:
                    spans.add((a, z))
                else:
                    break
    return sorted((full[a], full[z + 1] - 1 if z + 1 < len(full) else len(rows) - 1, tuple(rows[i] for i in full[a:z + 1]))
                  for a, z in spans)


def plain_dedup(docs, least):
    """{id: text} for distinct ids, in order of id."""
    first, out = {}, {}
    for d, text in sorted(docs):
        if text is None:
            out[d] = None
            continue
        rows, gone = text.split("\n"), set()
        for a, z, lines in plain_passages(rows, least):
            at = first.setdefault(lines, (d, a, z))
            if at[0] != d or a > at[2]:
                gone |= set(range(a, z + 1))
        out[d] = "\n".join(x for i, x in enumerate(rows) if i not in gone)
    return out


def corpus():
    passage = [" ".join(f"p{i}.{j}" for j in range(9)) for i in range(8)]
    long = " ".join(f"l{i}" for i in range(60))
    docs = [(i, "\n".join([f"own {i} a", f"own {i} b", *passage, f"own {i} c", "short", "short"])) for i in range(6)]
    docs += [(10 + i, "\n".join([f"before {i}", long, f"after  {i}"])) for i in range(5)]
    docs += [(20, "\n".join([long, "x", long])), (21, long), (22, None), (23, ""), (24, "\n\n"), (25, "same\nsame\nsame")]
    docs += [(26, "\n".join(["a b c"] * 50)), (27, "\n \n".join(passage) + "\n\n\nend"), (28, "\n".join(passage[3:] + passage[:4]))]
    return docs


@pytest.mark.parametrize("least", [40, 5, 1])
def test_equals_brute_force(spark, least):
    docs = corpus()
    df = spark.createDataFrame([(*d, "x", 9) for d in docs], "doc_id long, text string, removed string, n_removed int").repartition(4)
    got = line_chunks.deduplicated(df, least_words=least)
    assert got.columns[:3] == ["doc_id", "text", "removed"]
    rows = got.collect()
    assert {r.doc_id: r.text for r in rows} == plain_dedup(docs, least) and len(rows) == len(docs)
    assert all((r.n_removed > 0) == (r.text != dict(docs)[r.doc_id]) or not r.text for r in rows)


def test_lines_from_few_words_equal_brute_force(spark):
    """Many passages that repeat in part, overlap, and stand beside other copies than their first."""
    draw = random.Random(7)
    pool = [" ".join(draw.choice("abc") for _ in range(draw.randint(0, 4))) for _ in range(12)]
    docs = [(i, "\n".join(draw.choice(pool) for _ in range(draw.randint(0, 25)))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for least in (7, 12):
        assert {r.doc_id: r.text for r in line_chunks.deduplicated(df, least_words=least).collect()} == plain_dedup(docs, least)


@pytest.mark.parametrize("n, words", [(1, 51), (2, 26), (3, 17), (5, 11), (6, 10), (9, 10), (12, 10), (5, 20), (50, 8), (51, 1)])
def test_planted_passages_go_whole(spark, n, words):
    """A passage of 51 words or more between own lines, in two documents: the second loses all of it and nothing else."""
    def lines(name, count):
        return [" ".join(f"{name}.{i}.{j}" for j in range(words)) for i in range(count)]

    docs, left = [], {}
    for t in range(60):
        passage = lines(f"passage{t}", n)
        for d in (2 * t, 2 * t + 1):
            before, after = lines(f"before{d}", t % 4), lines(f"after{d}", t % 3)
            docs.append((d, "\n".join(before + passage + after)))
            left[d] = docs[-1][1] if d % 2 == 0 else "\n".join(before + after)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_chunks.deduplicated(df).collect()} == left


def test_a_whole_chunk_stands_in_every_passage(spark):
    draw = random.Random(3)
    docs = [(i, "\n".join(" ".join(f"{draw.random()}" for _ in range(draw.choice([1, 3, 9, 13, 14]))) for _ in range(60))) for i in range(20)]
    own = line_chunks.described_lines(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    rows = own.select("words", line_chunks.chunks(F.col("words"), F.col("hashes")).alias("c")).collect()
    for r in rows:
        # A chunk counts if its bounds do not depend on lines outside of the passage.
        for a in range(60):
            z = a
            while z < 60 and sum(r.words[a:z + 1]) < 40:
                z += 1
            if z < 60:
                assert any((c.first >= a + 2 or r.words[c.first] >= 14) and a <= c.first and c.last <= z for c in r.c)


def test_very_long_text(spark):
    """Work grows with the lines, also where one text holds very many."""
    text = "\n".join(f"line {i} of a long text" for i in range(40_000))
    df = spark.createDataFrame([(1, text), (2, "own\n" + text + "\nown")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_chunks.deduplicated(df).collect()} == {1: text, 2: "own\nown"}


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(3, text), (3, text), (None, text), (5, "x\n" + text)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in line_chunks.deduplicated(df).collect())
    assert got == [("3", text), ("3", text), ("5", "x"), ("None", "")]
    assert line_chunks.deduplicated(df.limit(0)).collect() == []


def test_equal_hashes_of_different_bytes(spark, monkeypatch):
    """With a hash that always collides, the bytes alone decide."""
    monkeypatch.setattr(line_chunks, "_line_hash", lambda c: F.when(c.isNotNull(), F.lit(bytes(16))))
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_chunks.deduplicated(df).collect()} == plain_dedup(docs, 40)


def test_main_path_has_no_python(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    plan = line_chunks.deduplicated(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
