"""Line dedup by content-defined chunks.

The lines of a text are hashed, and a rolling hash over each line and the one
before it says where chunks of lines end; so chunks shift with the text, and a
passage in two documents is cut alike inside.  There are two cuts: one ends where
a bit of the rolling hash is set, the other where it is not, and a line with a
third of the least words is a chunk in both.  So among any lines with the least
words together is a whole chunk: if no line is that long there are four lines or
more, and of the three bits inside, which do not depend on what stands around,
two are equal and bound a chunk of one cut.

Chunks that occur twice anywhere are the anchors.  Around them, from every line
forwards and backwards, the shortest passages of lines with the least words are
compared by the hashes of their lines, whose bytes are compared in turn.  A
passage that stands earlier in the collection is removed, line by line.

Everything is DataFrame functions.  Of chunks and passages only hashes are
shuffled; of lines in repeated passages the bytes, one row per task and line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from msgflow.staging import stage

#: Repeated passages of at least so many words (pieces between single spaces) are removed.
LEAST_WORDS = 40

#: Lines whose bytes are compared are first sought by so many bits of their hash; a bound of the table that is broadcast.
HASH_BITS = 1 << 20

#: Bytes of a line's hash.
_WIDTH = 16


def _line_hash(line: Column) -> Column:
    return F.unhex(F.substring(F.sha2(line.cast("binary"), 256), 1, 2 * _WIDTH))


def _once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once however often it is named, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def _distinct(runs: Column) -> Column:
    """Distinct runs of lines, as numbers: of structs Spark compares all with all.

    The low half is the length, for Spark's hash of a number is one half xor the other.
    """
    numbers = F.array_distinct(F.transform(runs, lambda r: F.shiftleft(r["first"].cast("long"), 32) + r["last"] - r["first"]))
    return F.transform(numbers, lambda x: F.struct(
        F.shiftright(x, 32).cast("int").alias("first"),
        (F.shiftright(x, 32) + x.bitwiseAND(F.lit(0xFFFFFFFF))).cast("int").alias("last")))


def described_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, text_key, n_lines, and of the lines with words their numbers (from 0), words and hashes, as three arrays."""
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    own = own.where(F.col("text") != "").withColumn("text_key", F.xxhash64("text"))
    lines = F.transform(F.split("text", "\n", -1), lambda t, i: F.struct(
        i.alias("number"), F.size(F.array_remove(F.split(t, " ", -1), "")).alias("words"), _line_hash(t).alias("hash")))
    own = own.select("id", "text_key", lines.alias("lines")).withColumn("with_words", F.filter("lines", lambda x: x["words"] > 0))
    return own.select("id", "text_key", F.size("lines").alias("n_lines"), F.col("with_words.number").alias("numbers"),
                      F.col("with_words.words").alias("words"), F.col("with_words.hash").alias("hashes")).where(F.size("words") > 0)


def chunks(words: Column, hashes: Column, least_words: int = LEAST_WORDS) -> Column:
    """array<struct<first, last, chunk>>: first and last line of the chunks of both cuts, and a hash of each."""
    long = -(-least_words // 3)
    bits = F.transform(hashes, lambda h, i: F.pmod(F.shiftright(F.xxhash64(F.get(hashes, i - 1), h), 7), F.lit(2)))

    def cut(bits: Column) -> Column:
        def ends(bit: int) -> Column:
            return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda p: (
                (F.get(bits, p) == bit) | (F.get(words, p) >= long) | F.coalesce(F.get(words, p + 1) >= long, F.lit(True))))

        def between(last: Column) -> Column:
            return F.transform(last, lambda z, i: F.struct(
                F.when(i == 0, F.lit(0)).otherwise(F.get(last, i - 1) + 1).alias("first"), z.alias("last")))

        return _distinct(F.concat(_once(ends(0), between), _once(ends(1), between)))

    return F.transform(_once(bits, cut), lambda c: F.struct(
        c["first"], c["last"], F.xxhash64(F.slice(hashes, c["first"] + 1, c["last"] - c["first"] + 1)).alias("chunk")))


def _below(words: Column, least: int) -> Column:
    """How many of the first items have fewer than ``least`` words together."""
    def step(state: Column, w: Column) -> Column:
        more = state["sum"] + w
        return F.struct(more.alias("sum"), (state["n"] + (more < least).cast("int")).alias("n"))

    return F.aggregate(words, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n")), step, lambda s: s["n"])


def _onwards(words: Column, at: Column, least: int) -> Column:
    """The words of the lines from ``at`` on, as many as can matter."""
    return F.slice(words, at + 1, least)


def _backwards(words: Column, at: Column, least: int) -> Column:
    """The words of the lines from ``at`` back, as many as can matter."""
    begin = F.greatest(at - least + 1, F.lit(0))
    return F.reverse(F.slice(words, begin + 1, at - begin + 1))


def passages(words: Column, anchors: Column, least: int = LEAST_WORDS) -> Column:
    """array<struct<first, last>>: the shortest runs of lines with ``least`` words, from or up to a line, that hold an anchor."""
    n = F.size(words)
    starts = F.flatten(F.transform(anchors, lambda c: F.sequence(
        F.when(c["last"] == 0, F.lit(0)).otherwise(F.least(c["first"], c["last"] - _below(
            _backwards(words, F.greatest(c["last"] - 1, F.lit(0)), least), least))), c["first"])))
    stops = F.flatten(F.transform(anchors, lambda c: F.sequence(
        c["last"], F.greatest(c["last"], F.least(n - 1, c["first"] + _below(_onwards(words, c["first"] + 1, least), least))))))
    forwards = F.transform(F.array_distinct(starts), lambda s: F.struct(
        s.alias("first"), (s + _below(_onwards(words, s, least), least)).alias("last")))
    back = F.transform(F.array_distinct(stops), lambda e: F.struct(
        (e - _below(_backwards(words, e, least), least)).alias("first"), e.alias("last")))
    return _distinct(F.filter(F.concat(forwards, back), lambda p: (p["first"] >= 0) & (p["last"] < n)))


def repeated_lines(docs: DataFrame, doc_id: str, text: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text_key, and ``removed``: the numbers (from 0) of the lines that go, for documents that lose any."""
    own = stage(described_lines(docs, doc_id, text), "line-hashes")
    each = own.select("id", "text_key", F.explode(chunks(F.col("words"), F.col("hashes"), least_words)).alias("c"))
    each = stage(each.select("id", "text_key", "c.*"), "line-chunks")
    place = F.struct("id", "text_key", "first")
    twice = each.groupBy("chunk").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least != most").select("chunk")
    anchors = each.join(stage(twice, "line-anchors"), "chunk", "left_semi")
    anchors = anchors.groupBy(F.col("id").alias("of"), F.col("text_key").alias("key")).agg(
        F.collect_set(F.struct("first", "last")).alias("anchors"))
    near = own.join(anchors, (F.col("text_key") == F.col("key")) & F.col("id").eqNullSafe(F.col("of")))
    found = near.select("id", "text_key", "n_lines", "numbers", "hashes",
                        F.explode(passages(F.col("words"), F.col("anchors"), least_words)).alias("p"))
    lines = F.slice("hashes", F.col("p.first") + 1, F.col("p.last") - F.col("p.first") + 1)
    # A line without words goes with the one before it.
    stop = F.coalesce(F.get("numbers", F.col("p.last") + 1), F.col("n_lines")) - 1
    found = found.select("id", "text_key", F.get("numbers", F.col("p.first")).alias("first"), stop.alias("last"),
                         F.aggregate(lines, F.lit(b""), lambda s, h: F.concat(s, h)).alias("passage"))
    found = stage(found, "line-passages")
    firsts = _firsts(found)
    # Lines of one hash and different bytes: then passages are compared by the bytes themselves.
    each = F.explode(F.transform(F.sequence(F.lit(0), (F.length("passage") / _WIDTH - 1).cast("int")), lambda i: F.substring(
        "passage", i * _WIDTH + 1, F.lit(_WIDTH))))
    if not _different_bytes(docs, text, firsts.select(each.alias("hash")).distinct()).isEmpty():
        found = stage(_with_bytes(docs, doc_id, text, found.drop("passage").distinct()), "line-bytes")
        firsts = _firsts(found)
    met = found.join(firsts, "passage")
    other = (F.col("text_key") != F.col("at.text_key")) | ~F.col("id").eqNullSafe(F.col("at.id"))
    gone = met.where(other | (F.col("first") > F.col("at.last")))
    gone = gone.groupBy("id", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    every = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"]))))
    return gone.select(F.col("id").alias(doc_id), "text_key", F.sort_array(every).alias("removed"))


def _firsts(found: DataFrame) -> DataFrame:
    """Passages that occur twice and their first place, by document id (null last), text key and line; staged."""
    spot = F.struct(F.col("id").isNull().alias("none"), "id", "text_key", "first", "last")
    firsts = found.groupBy("passage").agg(F.min(spot).alias("at"), F.max(spot).alias("most")).where("at != most").drop("most")
    return stage(firsts, "line-firsts")


def _different_bytes(docs: DataFrame, text: str, hashes: DataFrame) -> DataFrame:
    """Those of the line hashes that stand for different bytes; a broadcast table of bits keeps most other lines out of the shuffle."""
    hashes = stage(hashes, "line-repeats")
    each = docs.select(F.explode(F.split(F.col(text), "\n", -1)).alias("line")).withColumn("hash", _line_hash(F.col("line")))
    bit = F.pmod(F.xxhash64("hash"), F.lit(HASH_BITS))
    bits = hashes.select(bit.alias("bit")).distinct()  # at most HASH_BITS rows
    some = each.withColumn("bit", bit).join(F.broadcast(bits), "bit", "left_semi").groupBy("hash", "line").agg(F.count("*").alias("n"))
    return some.join(hashes, "hash", "left_semi").groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")


def _with_bytes(docs: DataFrame, doc_id: str, text: str, found: DataFrame) -> DataFrame:
    """The passages with the bytes of their lines with words in the place of the hashes."""
    own = docs.select(F.col(doc_id).alias("of"), F.xxhash64(text).alias("key"), F.split(F.col(text), "\n", -1).alias("lines"))
    met = found.join(own, (F.col("text_key") == F.col("key")) & F.col("id").eqNullSafe(F.col("of")))
    lines = F.slice("lines", F.col("first") + 1, F.col("last") - F.col("first") + 1)
    lines = F.filter(lines, lambda t: F.size(F.array_remove(F.split(t, " ", -1), "")) > 0)
    return met.select(*found.columns, F.array_join(lines, "\n").cast("binary").alias("passage")).distinct()


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated passages gone from the text, and ``n_removed``, the number of lines each row lost.

    A passage is a run of lines with ``least_words`` words together; lines without words
    between them do not count.  Looked at are the shortest passages from each line on and
    up to each line.  One that stands at an earlier place goes: in a document with a
    smaller id (null ids last; equal ids by a hash of the text), or earlier in the same
    text and not overlapping.  So of a longer passage that stands earlier every line goes.
    Lines without words go with the line before them.  The lines that stay are joined again as
    they were; other columns, whatever their names, are untouched, but ``n_removed`` is
    replaced.  Rows equal in id and text are one document: they lose the same lines, the
    first its none.  Null and empty texts stay as they are (a text of empty lines has no
    words to lose); an empty table gives no rows.
    """
    gone = repeated_lines(docs, doc_id, text, least_words)
    gone = gone.select(F.col(doc_id).alias("__id"), F.col("text_key").alias("__key"), F.col("removed").alias("__removed"))
    joined = docs.drop("n_removed").withColumn("__own", F.xxhash64(F.col(text))).join(
        gone, (F.col("__own") == F.col("__key")) & F.col(doc_id).eqNullSafe(F.col("__id")), "left")
    joined = joined.withColumn("__lines", F.when(F.col("__removed").isNotNull(), F.split(F.col(text), "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__removed"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n")
    n = F.coalesce(F.size("__removed"), F.lit(0)).cast("long")
    return joined.withColumn(text, F.when(F.col("__removed").isNotNull(), kept).otherwise(F.col(text))).withColumn(
        "n_removed", n).drop("__own", "__id", "__key", "__removed", "__lines")
