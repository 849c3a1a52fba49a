"""Prefix trie of conversations: union-find over the LCP edges of sorted neighbours.

*Prefixes.*  A turn counts by a digest of role and text.  The digest of a prefix is a sum,
so a conversation of any length is added up over all tasks and only a number per task
is handed on.  The path of a conversation lists the depths where it loses company:
prefixes shared by fewer conversations than the prefix before.  For every entry another
conversation of at least that many turns left, so a path has at most sqrt(2 * turns of
the table) entries, however long the conversation.

*Forests.*  Conversations are sorted by path over all tasks, so the members of every prefix
stand together, and each is joined to the next by an edge of the depth they share.  A
task takes its edges in descending depth; union-find merges the components that an edge
of depth d joins, and the merged component is the branching node of depth d.  Nodes that
reach over a task's border lie on the path of its first or last conversation; of them
the task hands on one contracted row each, with sums, and rows of equal nodes are added.

*Measures.*  All are sums over a node's members: a conversation is a leaf if it shares
less than its length with the next one, begins a child where its edge is not deeper than
the node, and repeats the text between the node and its edge.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from msgflow.llm.words import mixed
from msgflow.staging import stage

#: Digests of prefixes are two sums modulo 2^62.
MASK = (1 << 62) - 1
#: Ids that are written into one piece of the text that is hashed.
PIECE = 4096


def _place(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` sorted over all tasks and staged, with ``part`` (the task) and ``at`` (the place, ascending)."""
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).withColumn(
        "part", F.shiftright("at", 33).cast("int"))


def rebuilt(turns: DataFrame, group: int, heads: int) -> DataFrame:
    """Conversations c that begin with the first h turns of c - c % group, and go on with their own after their first h.

    h is crc32 of the decimal c, modulo ``heads``; all turns of the other conversation if
    it has fewer, none if it is absent.  ``turns`` has conv_id, turn, role and text; they
    stand in the order of turn, null first, and those of one turn number in that of the
    MD5 of role and text; a repeated row is a turn of its own.  A null role or text counts as empty; rows
    without conv_id take no part; other columns are not read.

    Gives a row per turn: conv, len (turns in all), pos (from 1), a and b (a digest of role and text)
    and bytes (of the text in UTF-8), and for every conversation one at pos 0.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.octet_length(text).cast("long").alias("bytes"),
        F.md5(F.concat(F.length(role), F.lit(":"), role, text).cast("binary")).alias("md5"))
    placed = stage(_place(rows, "conv", "turn", "md5"), "trie-turns")
    runs = placed.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("conv")
    runs = runs.withColumn("own", F.sum("n").over(own)).withColumn(
        "before", F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.withColumn("h", F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads)))
    runs = stage(runs.withColumn("base", F.col("conv") - F.col("conv") % group), "trie-runs")
    first = runs.where("before = 0")
    of_base = first.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    convs = first.join(of_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = stage(convs.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")), "trie-convs")
    known = runs.join(convs.drop("base", "h"), "conv")
    digest = [F.conv(F.substring("md5", at, 15), 16, 10).cast("long").alias(name) for at, name in ((1, "a"), (16, "b"))]
    numbered = placed.join(known, ["conv", "part"]).withColumn("i", F.col("before") + F.col("at") - F.col("first") + 1)
    tails = numbered.where("i > h").select("conv", "len", (F.col("taken") + F.col("i") - F.col("h")).alias("pos"), *digest, "bytes")
    begun = numbered.where(F.col("i") < heads).select(F.col("conv").alias("base"), F.col("i").alias("pos"), *digest, "bytes")
    begun = begun.join(convs, "base").where("pos <= h").select("conv", "len", "pos", "a", "b", "bytes")
    roots = convs.select("conv", "len", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("a"),
                         F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("bytes"))
    return tails.unionByName(begun).unionByName(roots)


def _prefixes(rows: DataFrame) -> DataFrame:
    """Adds p and q (digest of the prefix), pp and qq (of the prefix before) and total (bytes of the prefix)."""

    def add_up(batches):
        held, sums = None, np.zeros(3, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, _, pos, a, b, size, part = (batch.column(i).to_numpy() for i in range(7))
            with np.errstate(over="ignore"):
                place = pos.astype(np.uint64)
                u = np.where(pos > 0, mixed(a.astype(np.uint64) ^ mixed(place + np.uint64(0x51ED))), np.uint64(0))
                v = np.where(pos > 0, mixed(b.astype(np.uint64) ^ mixed(place + np.uint64(0xC0FFEE))), np.uint64(0))
                begins = np.r_[held is None or conv[0] != held, conv[1:] != conv[:-1]]
                run = np.cumsum(begins) - begins[0]
                starts = np.flatnonzero(begins) if begins[0] else np.r_[0, np.flatnonzero(begins)]
                out = []
                for k, x in enumerate((u, v, size.astype(np.uint64))):
                    whole = np.cumsum(x)
                    before = (whole - x)[starts]
                    if not begins[0]:
                        before[0] -= sums[k]
                    out.append(whole - before[run])
                held, sums = conv[-1], np.array([x[-1] for x in out], np.uint64)
            masked = [(x & np.uint64(MASK)).view(np.int64) for x in (out[0], out[1], u, v)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(5), pa.array(part), *map(pa.array, masked), pa.array(out[2].view(np.int64))],
                                             ["conv", "len", "pos", "bytes", "part", "p", "q", "u", "v", "total"])

    sorted_ = _place(rows, "conv", "pos").select("conv", "len", "pos", "a", "b", "bytes", "part")
    summed = stage(sorted_.mapInArrow(add_up, "conv long, len long, pos long, bytes long, part int, p long, q long, u long, v long, total long"), "trie-sums")
    last = summed.groupBy("conv", "part").agg(F.max_by(F.struct("p", "q", "total"), "pos").alias("last"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    wide = [F.pmod(F.sum(F.col(f"last.{c}").cast("decimal(20,0)")).over(before), F.lit(MASK + 1).cast("decimal(20,0)")).cast("long").alias(f"_{c}")
            for c in ("p", "q")]
    # Conversations that go on in the next task: at most one for each task.
    handed = stage(last.select("conv", "part", *wide, F.sum("last.total").over(before).alias("_total")).where("_p is not null"), "trie-handed")
    rows = summed.join(F.broadcast(handed), ["conv", "part"], "left")

    def around(x: Column) -> Column:
        return x.bitwiseAND(F.lit(MASK))

    def whole(c: str) -> Column:
        return around(F.col(c) + F.coalesce(f"_{c}", F.lit(0)))

    rows = rows.select("conv", "len", "pos", "bytes", whole("p").alias("p"), whole("q").alias("q"), "u", "v",
                       (F.col("total") + F.coalesce("_total", F.lit(0))).alias("total"))
    return rows.withColumn("pp", around(F.col("p") - F.col("u"))).withColumn("qq", around(F.col("q") - F.col("v"))).drop("u", "v")


def _shared(prefixes: DataFrame) -> DataFrame:
    """The root and every prefix of two conversations or more, staged; ``top`` if fewer share it than the one before."""
    nodes = prefixes.groupBy("pos", "p", "q").agg(F.count("*").alias("n"), F.min("conv").alias("least"), F.min("pp").alias("pp"),
                                                  F.min("qq").alias("qq"), F.min("bytes").alias("bytes"), F.min("total").alias("total"))
    nodes = stage(nodes.where("n > 1 or pos = 0"), "trie-prefixes")
    above = nodes.select((F.col("pos") + 1).alias("pos"), F.col("p").alias("pp"), F.col("q").alias("qq"), F.col("n").alias("n_above"), F.col("least").alias("parent"))
    nodes = nodes.join(above, ["pos", "pp", "qq"], "left")
    return stage(nodes.withColumn("top", F.coalesce(F.col("n") < F.col("n_above"), F.lit(True))), "trie-shared")


class Forest:
    """The branching nodes of conversations that stand in the order of their paths.

    ``rows`` are (conv, len, path, depth, bytes): path entries (pos, p, q, bytes before), the
    depth down to which the conversation is shared, and its bytes down to there.
    ``before`` and ``after`` are the neighbours across the borders, or None.
    """

    def __init__(self, rows: list[tuple], before: tuple | None, after: tuple | None):
        self.rows = rows
        self.edges = [self._edge(before, rows[0]), *map(self._edge, rows, rows[1:]), self._edge(rows[-1], after)]
        self.up = list(range(len(rows)))
        n = len(rows)
        self.count, self.least, self.low = [1] * n, [r[0] for r in rows], list(range(n))
        self.leaves = [int(self.edges[i + 1][0] < rows[i][1]) for i in range(n)]
        self.deeper, self.bytes = [0] * n, [0] * n

    @staticmethod
    def _edge(x: tuple | None, y: tuple | None) -> tuple[int, int]:
        """(depth, bytes) of what neighbours share."""
        if x is None or y is None:
            return -1, 0
        path, other = x[2], y[2]
        k = 0
        while k < len(path) and k < len(other) and path[k][:3] == other[k][:3]:
            k += 1
        return (path[k][0] - 1, path[k][3]) if k < len(path) else (x[3], x[4])

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def _open(self) -> dict[int, set[int]]:
        """{depth: rows}: the nodes of the first and last row that go on beyond a border, and the root."""
        found: dict[int, set[int]] = {}
        for i, edge in ((0, self.edges[0][0]), (len(self.rows) - 1, self.edges[-1][0])):
            path = self.rows[i][2]
            for k, step in enumerate(path):
                if step[0] <= edge or not k:
                    found.setdefault(path[k + 1][0] - 1 if k + 1 < len(path) else self.rows[i][3], set()).add(i)
        return found

    def nodes(self):
        """Rows (pos, p, q, depth, bytes, n, least, leaves, children, repeated) of this forest, deepest first."""
        by_depth, reaching = {}, self._open()
        for i in range(1, len(self.rows)):
            by_depth.setdefault(self.edges[i][0], []).append(i)
        for depth in sorted(by_depth.keys() | reaching.keys(), reverse=True):
            children, joined = {}, {}
            for i in by_depth.get(depth, ()):
                a, b = self.root(i - 1), self.root(i)
                if self.count[a] < self.count[b]:
                    a, b = b, a
                self.up[b] = a
                self.count[a] += self.count[b]
                self.least[a], self.low[a] = min(self.least[a], self.least[b]), min(self.low[a], self.low[b])
                self.leaves[a] += self.leaves[b]
                self.deeper[a] += self.deeper[b]
                self.bytes[a] += self.bytes[b]
                children[a] = children.get(a, 0) + children.pop(b, 0) + (self.rows[i][1] > depth)
                joined[a] = joined.get(a, 0) + joined.pop(b, 0) + 1
            for a in {*children, *(self.root(i) for i in reaching.get(depth, ()))}:
                yield self._node(a, depth, children.get(a, 0))
            for a, n in joined.items():
                self.deeper[a] += n
                self.bytes[a] += n * self._bytes_at(a, depth)

    def _bytes_at(self, a: int, depth: int) -> int:
        row = self.rows[self.low[a]]
        return next((step[3] for step in row[2] if step[0] > depth), row[4])

    def _node(self, a: int, depth: int, children: int) -> tuple:
        low, size = self.low[a], self._bytes_at(a, depth)
        step = max((s for s in self.rows[low][2] if s[0] <= depth), key=lambda s: s[0])
        deeper, total = self.deeper[a], self.bytes[a]
        edge, edge_bytes = self.edges[0] if low == 0 else (-1, 0)
        if edge > depth:  # the edge over the border before is inside this node
            deeper, total = deeper + 1, total + edge_bytes
        elif self.rows[low][1] > depth:
            children += 1
        return (*step[:3], depth, size, self.count[a], self.least[a], self.leaves[a], children, total - deeper * size)


_NODE = "pos long, p long, q long, depth long, bytes long, n long, least long, leaves long, children long, repeated long"
_ROW = "conv long, len long, path array<struct<pos:bigint,p:bigint,q:bigint,above:bigint>>, depth long, bytes long"


def _branches(convs: DataFrame) -> DataFrame:
    """A row per branching node, by the forests of all tasks and the union of what reaches over their borders."""
    row = F.struct("conv", "len", "path", "depth", "bytes")
    placed = stage(_place(convs.withColumn("over", F.col("len") > F.col("depth")), "path", "over", "conv").select("part", "at", row.alias("row")), "trie-order")
    ends = placed.groupBy("part").agg(F.min_by("row", "at").alias("a"), F.max_by("row", "at").alias("z"))
    across = Window.partitionBy(F.lit(0)).orderBy("part")  # one row for each task
    ends = stage(ends.select("part", F.lag("z").over(across).alias("before"), F.lead("a").over(across).alias("after")), "trie-borders")

    def beside(name, turn):
        return ends.where(F.col(name).isNotNull()).select("part", F.lit(turn).alias("turn"), F.lit(0).cast("long").alias("at"), F.col(name).alias("row"))

    rows = placed.select("part", F.lit(0).alias("turn"), "at", "row").unionByName(beside("before", -1)).unionByName(beside("after", 1))
    rows = rows.repartition(max(1, ends.count()), "part").sortWithinPartitions("part", "turn", "at").select("part", "turn", "row.*")
    names = [x.split()[0] for x in _NODE.split(", ")]

    def emitted(rows, before, after):
        found = list(Forest(rows, before, after).nodes()) if rows else []
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(len(names))], names)

    def run(batches):
        now, own, before, after = None, [], None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for part, turn, conv, length, path, depth, size in zip(*columns):
                if part != now:
                    if own:
                        yield emitted(own, before, after)
                    now, own, before, after = part, [], None, None
                row = (conv, length, [(s["pos"], s["p"], s["q"], s["above"]) for s in path], depth, size)
                if turn == 0:
                    own.append(row)
                elif turn < 0:
                    before = row
                else:
                    after = row
        if own:
            yield emitted(own, before, after)

    made = rows.mapInArrow(run, _NODE)
    sums = [F.sum(c).alias(c) for c in ("n", "leaves", "children", "repeated")]
    return stage(made.groupBy("pos", "p", "q").agg(F.max("depth").alias("depth"), F.max("bytes").alias("bytes"), F.min("least").alias("least"), *sums), "trie-branches")


def _ends(convs: DataFrame) -> DataFrame:
    """(pos, p, q, ends): SHA-256 of the ids, ascending, of the conversations that end at a shared node.

    Ids are sorted over all tasks and written into pieces there; one task per node reads
    its pieces in order and hashes them, for a hash of one text cannot be made in parts.
    """
    last = F.element_at("path", -1)
    keys = ("pos", "p", "q")
    rows = convs.where("len = depth").select(*[last[k].alias(k) for k in keys], "conv")
    names = [*keys, "first", "text"]

    def written(batches):
        key, ids = None, []

        def out():
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in (*key, ids[0])], pa.array([",".join(map(str, ids))])], names)

        for batch in batches:
            for *own, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if own != key or len(ids) == PIECE:
                    if ids:
                        yield out()
                    key, ids = own, []
                ids.append(conv)
        if ids:
            yield out()

    def hashed(batches):
        key, sha = None, None

        def out():
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in key], pa.array([sha.hexdigest()])], [*keys, "ends"])

        for batch in batches:
            for *own, _, text in zip(*[c.to_pylist() for c in batch.columns]):
                if own != key:
                    if key is not None:
                        yield out()
                    key, sha = own, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
        if key is not None:
            yield out()

    pieces = rows.repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv").mapInArrow(written, "pos long, p long, q long, first long, text string")
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(hashed, "pos long, p long, q long, ends string")


def trie(rows: DataFrame) -> DataFrame:
    """A row per distinct prefix of the conversations of ``rows`` (as :func:`rebuilt` gives them), the empty one included.

    conv_id, the smallest member; depth; parent_conv_id (null for the root); n_convs;
    n_children; n_leaves, childless nodes of the subtree; saved_tokens, the bytes that the
    subtree's nodes save, (n_convs - 1) times those of their last text; and ends_sha256 of the
    ids, joined by commas, of members with no further turn.  Equal conversations share all
    nodes, an empty one is a member of the root alone, and no rows give no nodes.
    Turns are equal if 120 bits of their MD5 are.
    """
    prefixes = _prefixes(rows)
    shared = _shared(prefixes)
    root = shared.where("pos = 0").select("least").first()
    marked = prefixes.join(shared.select("pos", "p", "q", "top"), ["pos", "p", "q"], "left")
    marked = stage(marked, "trie-marked")
    step = F.when(F.col("top"), F.struct("pos", "p", "q", (F.col("total") - F.col("bytes")).alias("above")))
    convs = marked.where("top is not null").groupBy("conv").agg(
        F.max("len").alias("len"), F.sort_array(F.collect_list(step)).alias("path"), F.max(F.struct("pos", "total")).alias("deepest"))
    convs = stage(convs.select("conv", "len", "path", F.col("deepest.pos").alias("depth"), F.col("deepest.total").alias("bytes")), "trie-paths")
    branches = _branches(convs).join(_ends(convs), ["pos", "p", "q"], "left")
    # Nodes of one member's path differ in n, and those with one least member are on its path.
    low = branches.select("least", "n", "depth", F.col("bytes").alias("bytes_low"), "leaves", "children", "repeated", "ends")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    at_branch = F.col("pos") == F.col("depth")
    inner = shared.join(low, ["least", "n"]).select(
        F.col("least").alias("conv_id"), F.col("pos").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(at_branch, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("repeated") + (F.col("n") - 1) * (F.col("bytes_low") - F.col("total") + F.col("bytes"))).alias("saved_tokens"),
        F.when(at_branch & F.col("ends").isNotNull(), F.col("ends")).otherwise(nothing).alias("ends_sha256"))
    above = shared.where("pos > 0").select((F.col("pos") + 1).alias("pos"), F.col("p").alias("pp"), F.col("q").alias("qq"), F.col("least").alias("above"))
    tails = marked.where("top is null").join(above, ["pos", "pp", "qq"], "left")
    least = F.lit(root.least if root else None).cast("long")
    single = tails.select(
        F.col("conv").alias("conv_id"), F.col("pos").alias("depth"),
        F.when(F.col("pos") == 1, least).otherwise(F.coalesce("above", "conv")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        (F.col("pos") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("pos") == F.col("len"), F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(nothing).alias("ends_sha256"))
    return inner.unionByName(single)
