"""Prefix trie of conversations, kept as a z-fast trie and filled in batches.

A turn is a symbol, a conversation a sequence of turns.  The trie is compacted: its nodes are the places where
sequences end or part, and an edge holds all turns between two of them.  A prefix is named by 128 bits (an exclusive
or of hashes of each turn and its place, so a long conversation is cut into blocks and nobody walks along it).

Each node is stored in a table under its *handle*: the prefix whose length is the two-fattest number (the one with
the most trailing zero bits) in the interval from its parent's length, exclusive, to its own, inclusive.  A sequence
finds where it leaves the trie by fat binary search: it probes the table at the two-fattest length of the interval
that is left, goes on below the node it finds if it agrees with all of it, and above that length if there is none.
So a search takes about log2(length) joins, not one for each turn.  A second key, the first prefix of each edge,
leads into the edge in which the sequence leaves; there the last common prefix is looked up.

Sequences come in batches.  A batch searches the trie as it is, all its sequences at once; what lies below their exits
is new, and is grouped by prefix within the batch only.  Edges that are left in their middle are split there, new nodes
are added, and the handles are made again.  At the end the edges are expanded: every prefix is a row that takes its
numbers from the node below it.  Sums over subtrees are made by pointer jumping, in log2(depth) rounds.

Equal conversations are one sequence with a number of members, so copies are combined before anything is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.tables import narrow
from recollect.plans.materialize import stored
from recollect.plans.ranks import ranked
from recollect.plans.running import highest, running
from recollect.plans.running import Running
from recollect.plans.spread import spread_join

#: Sequences are dealt to so many batches; so many probes of a search are one job.
BATCHES, PROBES = 2, 3
#: Turns of one conversation, and ids whose list is one piece of text, that one task handles together.
TURN_BLOCK, ID_BLOCK = 65_536, 4_096
KEY = ["k1", "k2"]


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] with the most trailing zero bits."""
    top = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.lit(-1).cast("bigint"), top.cast("int")).bitwiseAND(high)


def symbols(role: Column, text: Column) -> list[Column]:
    """Two hashes and the bytes of a turn; null is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return [
        F.xxhash64(F.lit("one"), role, text).alias("s1"), F.xxhash64(F.lit("two"), role, text).alias("s2"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    ]


def numbered_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, s1, s2, bytes): the turns of each conversation in order, numbered from 1."""
    rows = narrow(turns, conv_id=id_col, turn=turn_col, role=role_col, text=text_col).filter("conv_id is not null")
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", *symbols(F.col("role"), F.col("text")))
    return ranked(rows, ["conv_id"], [F.asc_nulls_first("turn"), "s1", "s2"], "depth").drop("turn")


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, up1, up2, bytes, upto): names of each prefix and of the one before it, bytes so far."""
    own = [F.xxhash64(F.lit(n), "s1", "s2", "depth") for n in (1, 2)]
    src = rows.select("conv_id", "depth", own[0].alias("p1"), own[1].alias("p2"), "bytes", F.floor(F.col("depth") / TURN_BLOCK).alias("block"))
    here = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = src.groupBy("conv_id", "block").agg(F.bit_xor("p1").alias("t1"), F.bit_xor("p2").alias("t2"), F.sum("bytes").alias("tb"))
    carry = totals.select(
        "conv_id", "block", F.coalesce(F.bit_xor("t1").over(before), F.lit(0)).alias("c1"),
        F.coalesce(F.bit_xor("t2").over(before), F.lit(0)).alias("c2"), F.coalesce(F.sum("tb").over(before), F.lit(0)).alias("cb"),
    )
    local = src.select("*", F.bit_xor("p1").over(here).alias("l1"), F.bit_xor("p2").over(here).alias("l2"), F.sum("bytes").over(here).alias("lb"))
    k1, k2 = F.col("l1").bitwiseXOR(F.col("c1")), F.col("l2").bitwiseXOR(F.col("c2"))
    return local.join(carry, ["conv_id", "block"]).select(
        "conv_id", "depth", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("p1")).alias("up1"),
        k2.bitwiseXOR(F.col("p2")).alias("up2"), "bytes", (F.col("lb") + F.col("cb")).alias("upto"),
    )


def _at(names: DataFrame, *, seq: str, depth: str, k1: str, k2: str) -> DataFrame:
    """The names of prefixes under other column names, for a look-up by sequence and depth."""
    return names.select(F.col("seq").alias(seq), F.col("depth").alias(depth), F.col("k1").alias(k1), F.col("k2").alias(k2))


def handles(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(h1, h2, is_handle, end, e1, e2, top, owner): each node under the name of its handle and of its edge's first prefix."""
    places = F.array(
        F.struct(F.lit(True).alias("is_handle"), two_fattest(F.col("top"), F.col("depth")).alias("at")),
        F.struct(F.lit(False).alias("is_handle"), (F.col("top") + 1).alias("at")),
    )
    rows = nodes.select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), F.col("depth").alias("end"), "top", "owner", F.explode(places).alias("p"))
    rows = rows.select("e1", "e2", "end", "top", "owner", "p.is_handle", "p.at")
    return rows.join(_at(names, seq="owner", depth="at", k1="h1", k2="h2"), ["owner", "at"]).drop("at")


def exits(batch: DataFrame, table: DataFrame, names: DataFrame) -> DataFrame:
    """(seq, n, shared, e1, e2, end, top, owner): how many turns each sequence shares with the trie, and the edge it leaves, if any.

    ``batch`` has (seq, n); null edge columns mean that it leaves at a node.
    """
    edge = ["e1", "e2", "end", "top", "owner"]
    by_handle = table.filter("is_handle").select("h1", "h2", *[F.col(c).alias(f"at_{c}") for c in edge])
    types = dict(table.dtypes)
    state = batch.select("seq", "n", F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b"), *[F.lit(None).cast(types[c]).alias(c) for c in edge])
    longest = batch.agg(F.max("n")).first()[0] or 0
    for probe in range(1, longest.bit_length() + 1):  # each probe leaves less than half of the lengths
        # sequences that are done ask at no length and so meet nothing
        asking = F.expr("a < b and end is null")
        asked = state.withColumn("f", F.when(asking, two_fattest(F.col("a"), F.col("b"))))
        named = asked.join(_at(names, seq="seq", depth="f", k1="h1", k2="h2"), ["seq", "f"], "left")
        hit = named.join(by_handle, ["h1", "h2"], "left")
        seen = hit.join(_at(names, seq="seq", depth="at_end", k1="o1", k2="o2"), ["seq", "at_end"], "left")
        whole = F.expr("at_end <= n and o1 = at_e1 and o2 = at_e2")
        missed, through = F.expr("f is not null and at_end is null"), F.coalesce(whole, F.lit(False))
        leaves = F.col("at_end").isNotNull() & ~through
        state = seen.select(
            "seq", "n", F.when(through, F.col("at_end")).otherwise(F.col("a")).alias("a"),
            F.when(missed, F.col("f") - 1).when(through, F.greatest("b", "at_end")).otherwise(F.col("b")).alias("b"),
            *[F.when(leaves, F.col(f"at_{c}")).otherwise(F.col(c)).alias(c) for c in edge],
        )
        if probe % PROBES == 0:
            state = stored(state, "search")
    found = stored(state, "search")
    # no node was found below: the edge that begins with the next turn, if there is one
    inside, ends = found.filter("end is not null"), found.filter("end is null and a >= n")
    below = found.filter("end is null and a < n").select("seq", "n", "a", "b").withColumn("next", F.col("a") + 1)
    below = below.join(_at(names, seq="seq", depth="next", k1="h1", k2="h2"), ["seq", "next"])
    below = below.join(table.filter("not is_handle").drop("is_handle"), ["h1", "h2"], "left")
    cols = ["seq", "n", "a", *edge]
    left = stored(inside.select(*cols).unionByName(below.select(*cols)).unionByName(ends.select(*cols)), "exits")
    # inside an edge: the last prefix shared with the sequence that owns it
    walk = left.filter("end is not null").join(names.select("seq", "depth", "k1", "k2"), "seq")
    walk = walk.filter("depth > a and depth <= end").select("seq", "depth", "k1", "k2", "owner")
    labels = _at(names, seq="owner", depth="depth", k1="l1", k2="l2")
    agreed = spread_join(walk, labels, ["owner", "depth"], "inner", "seq").filter("k1 = l1 and k2 = l2")
    agreed = agreed.groupBy("seq").agg(F.max("depth").alias("shared"))
    return left.join(agreed, "seq", "left").withColumn("shared", F.coalesce("shared", "a")).drop("a")


def add_batch(nodes: DataFrame | None, batch: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, new prefixes) after the sequences of ``batch`` (seq, n, k1, k2: their last prefix) are inserted.

    ``nodes`` are (k1, k2, depth, top, owner): last prefix and length of a node, length of its parent, and a
    sequence that goes through it.
    """
    if nodes is None:
        left = batch.select("seq", "n", F.lit(0).cast("bigint").alias("shared"))
    else:
        left = stored(exits(batch.select("seq", "n"), stored(handles(nodes, names), "handles"), names), "exits")
    mine = names.join(batch.select("seq"), "seq", "left_semi")
    below = mine.join(left.select("seq", "shared"), "seq").filter("depth > shared")
    fresh = below.groupBy("k1", "k2").agg(
        F.first("depth").alias("depth"), F.min("seq").alias("owner"), F.first("bytes").alias("bytes"),
        F.first("upto").alias("upto"), F.first("up1").alias("up1"), F.first("up2").alias("up2"),
    )
    fresh = stored(fresh, "prefixes")
    parting = fresh.groupBy(F.col("up1").alias("k1"), F.col("up2").alias("k2")).count().filter("count > 1").select(*KEY)
    explicit = fresh.join(parting.unionByName(batch.select(*KEY)).distinct(), KEY, "left_semi").select(*KEY, "depth", "owner")
    # parents: the explicit prefix before it on the owner's way, or where the owner left the trie
    passing = below.join(explicit.select(*KEY), KEY, "left_semi").select("seq", "depth", "k1", "k2")
    starts = left.select("seq", F.col("shared").alias("depth"), F.lit(None).cast("bigint").alias("k1"), F.lit(None).cast("bigint").alias("k2"))
    path = running(
        passing.unionByName(starts), ["seq"], ["depth"], F.floor(F.col("depth") / TURN_BLOCK),
        top=highest(F.col("depth"), inclusive=False),
    )
    added = explicit.join(path.select(F.col("seq").alias("owner"), *KEY, "top"), ["owner", *KEY]).select(*KEY, "depth", "top", "owner")
    if nodes is None:
        return stored(added, "nodes"), fresh
    # edges left in their middle
    cut = left.filter("end is not null and shared > top and shared < end").select("seq", "shared", "e1", "e2", "top", "owner")
    cut = cut.join(_at(names, seq="seq", depth="shared", k1="k1", k2="k2"), ["seq", "shared"])
    cut = cut.groupBy("e1", "e2", "shared").agg(*[F.first(c).alias(c) for c in ("top", "owner", "k1", "k2")])
    lowest = cut.groupBy(F.col("e1").alias("k1"), F.col("e2").alias("k2")).agg(F.max("shared").alias("cut"))
    kept = nodes.join(lowest, KEY, "left").withColumn("top", F.coalesce("cut", "top")).drop("cut")
    between = running(cut, ["e1", "e2"], ["shared"], F.floor(F.col("shared") / TURN_BLOCK), above=highest(F.col("shared"), inclusive=False))
    between = between.select(*KEY, F.col("shared").alias("depth"), F.coalesce("above", "top").alias("top"), "owner")
    return stored(kept.unionByName(between).unionByName(added), "nodes"), fresh


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """Sums of (convs, leaves, length, weight) and the smallest member of each node's subtree, the node included.

    ``nodes`` have k1, k2 and the name of their parent (a1, a2; null for the root).
    """
    sums = {c: F.sum(c) for c in ("convs", "leaves", "length", "weight")} | {"member": F.min("member")}
    while True:
        nodes = stored(nodes, "subtrees")
        jumps = nodes.filter("a1 is not null")
        if jumps.isEmpty():
            return nodes.drop("a1", "a2")
        gained = jumps.groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(*[f.alias(f"more_{c}") for c, f in sums.items()])
        above = nodes.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        up = spread_join(jumps, above, ["a1", "a2"], "left", "k1").drop("a1", "a2").withColumnsRenamed({"b1": "a1", "b2": "a2"})
        rows = up.unionByName(nodes.filter("a1 is null")).join(gained, KEY, "left")
        added = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in sums if c != "member"}
        nodes = rows.withColumns(added | {"member": F.least("member", "more_member")}).drop(*[f"more_{c}" for c in sums])


def id_checksums(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): SHA-256 of the ascending decimal ids joined by commas, of each name in ``ends`` (k1, k2, conv_id).

    Lists are made in pieces of a range of ids; one task only ever runs along the pieces of a name.
    """
    block = F.floor(F.col("conv_id") / ID_BLOCK)
    listed = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    pieces = stored(ends.groupBy(*KEY, block.alias("block")).agg(F.array_join(listed, ",").alias("piece")), "pieces")
    several = pieces.groupBy(*KEY).agg(F.count(F.lit(1)).alias("pieces")).filter("pieces > 1").select(*KEY)
    single = pieces.join(several, KEY, "left_anti").select(*KEY, F.sha2("piece", 256).alias("ends_sha256"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None
        for batch in batches:
            names, sums = [], []
            for k1, k2, piece in zip(*(batch.column(c).to_pylist() for c in (*KEY, "piece")), strict=True):
                if (k1, k2) != name:
                    if name is not None:
                        names.append(name)
                        sums.append(digest.hexdigest())
                    name, digest = (k1, k2), hashlib.sha256(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
            yield _sums(names, sums)
        if name is not None:
            yield _sums([name], [digest.hexdigest()])

    long = pieces.join(several, KEY, "left_semi").repartition(*KEY).sortWithinPartitions(*KEY, "block")
    return single.unionByName(long.mapInArrow(chain, "k1 bigint, k2 bigint, ends_sha256 string"))


def _sums(names: list[tuple[int, int]], sums: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([n[0] for n in names], pa.int64()), pa.array([n[1] for n in names], pa.int64()), pa.array(sums, pa.string())],
        names=[*KEY, "ends_sha256"],
    )


def prefix_trie(turns: DataFrame, members: DataFrame | None = None, batches: int = BATCHES) -> DataFrame:
    """One row per distinct prefix of the conversations in ``turns`` (conv_id, depth from 1, s1, s2, bytes; ``numbered_turns``).

    conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves (childless prefixes below
    or at it), saved_tokens (below and at it, (members - 1) * bytes of the last turn) and ends_sha256 (of the ids of
    the conversations that end there).  The root has depth 0 and no parent.

    ``members`` (conv_id) may name conversations without turns; they end at the root.  Rows without conv_id take no
    part, null roles and texts are empty, turns with equal numbers are ordered by a hash of role and text, repeated
    turns count as often as they are there, texts may have any length, other columns are not looked at.  Without
    conversations there is no row, not even the root.  Ids are integers.
    """
    names = stored(prefixes(turns), "prefix-names")
    lasts = names.groupBy("conv_id").agg(F.max_by(F.struct("depth", *KEY, "upto"), "depth").alias("end"))
    lasts = lasts.select("conv_id", F.col("end.depth").alias("n"), "end.k1", "end.k2", "end.upto")
    if members is not None:
        ids = members.select(F.col("conv_id").cast("bigint").alias("conv_id")).filter("conv_id is not null").distinct()
        zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n", "k1", "k2", "upto")]
        lasts = ids.join(lasts, "conv_id", "left").select("conv_id", *zero)
    lasts = stored(lasts, "ends")
    distinct = lasts.groupBy("n", *KEY, "upto").agg(F.min("conv_id").alias("seq"), F.count(F.lit(1)).alias("convs"))
    distinct = stored(distinct, "sequences")
    names = stored(names.withColumnRenamed("conv_id", "seq").join(distinct.select("seq"), "seq", "left_semi"), "prefix-names")
    turn = F.pmod(F.xxhash64("seq"), F.lit(batches))
    nodes, expanded = None, None
    for i in range(batches):
        batch = distinct.filter((F.col("n") > 0) & (turn == i)).select("seq", "n", *KEY)
        nodes, fresh = add_batch(nodes, batch, names)
        expanded = fresh if expanded is None else expanded.unionByName(fresh)

    # every prefix, with the length of the node at or below it on the same edge
    marked = expanded.join(nodes.select(*KEY, F.col("depth").alias("node"), "top"), KEY, "left")
    marked = stored(marked.withColumn("back", -F.col("depth")), "expanded")
    block = F.floor(F.col("back") / TURN_BLOCK)
    every = running(marked, ["owner"], ["back"], block, edge=Running("min", F.col("node"))).drop("back", "node", "top")
    every = stored(every, "expanded")

    # nodes with their parents, what ends there and how long their edges are
    first = every.join(nodes.select("owner", F.col("depth").alias("edge"), (F.col("top") + 1).alias("depth")), ["owner", "edge", "depth"])
    first = first.select("owner", F.col("edge").alias("depth"), F.col("up1").alias("a1"), F.col("up2").alias("a2"), (F.col("upto") - F.col("bytes")).alias("above"))
    ends = distinct.select(*KEY, "convs", F.col("seq").alias("member"), (F.col("convs") * F.col("upto")).alias("weight"))
    last = marked.filter("node is not null").select(*KEY, "depth", "owner", "upto", "top")
    tree = last.join(first, ["owner", "depth"]).withColumn("length", F.col("upto") - F.col("above"))
    tree = tree.select(*KEY, "owner", "depth", "top", "a1", "a2", "upto", "length")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = lasts.limit(1).select(*[
        {"a1": none, "a2": none, "owner": none, "top": none}.get(c, zero).alias(c) for c in tree.columns
    ])
    tree = tree.unionByName(root)
    children = tree.filter("a1 is not null").groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.count(F.lit(1)).alias("children"))
    tree = tree.join(children, KEY, "left").join(ends, KEY, "left")
    tree = tree.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("children", "convs", "weight")})
    tree = stored(tree.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(0).cast("bigint")), "tree")
    sums = subtree_sums(tree.select(*KEY, "a1", "a2", "convs", "member", "leaves", "length", "weight"))
    sums = sums.withColumnRenamed("length", "lengths")
    full = tree.select(*KEY, "owner", "depth", "top", "a1", "a2", "upto", "length", "children").join(sums, KEY)
    parents = full.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("member").alias("parent"))
    full = spread_join(full, parents, ["a1", "a2"], "left", "k1").join(id_checksums(lasts.select("conv_id", *KEY)), KEY, "left")
    full = stored(full.drop("k1", "k2", "a1", "a2"), "nodes")

    nothing = F.sha2(F.lit(""), 256)

    def shown(node: Column, depth: Column, before: Column) -> list[Column]:
        """Output columns of a prefix of length ``depth`` with ``before`` bytes above its last turn, on the edge of a node."""
        below = F.col("lengths") - F.col("length") + F.col("upto") - before
        return [
            F.col("member").alias("conv_id"), depth.cast("bigint").alias("depth"),
            F.when(depth == F.col("top") + 1, F.col("parent")).otherwise(F.when(depth > 0, F.col("member"))).alias("parent_conv_id"),
            F.col("convs").alias("n_convs"), F.when(node, F.col("children")).otherwise(1).cast("bigint").alias("n_children"),
            F.col("leaves").alias("n_leaves"), (F.col("weight") - F.col("convs") * before - below).alias("saved_tokens"),
            F.when(node, F.coalesce("ends_sha256", nothing)).otherwise(nothing).alias("ends_sha256"),
        ]

    ways = full.filter("owner is not null").withColumnRenamed("depth", "edge").withColumnRenamed("upto", "node_upto")
    rows = every.select("owner", F.col("depth").alias("at"), "edge", "bytes", F.col("upto").alias("at_upto"))
    rows = rows.join(ways.withColumnRenamed("node_upto", "upto"), ["owner", "edge"])
    inner = rows.select(*shown(F.col("at") == F.col("edge"), F.col("at"), F.col("at_upto") - F.col("bytes")))
    return inner.unionByName(full.filter("owner is null").select(*shown(F.lit(True), F.col("depth"), F.lit(0))))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Fixed by the contract: the first h turns come from conversation c - c % 5, h = crc32(c) % 9, the rest are c's own."""
    sizes = turns.groupBy("conv_id").agg(F.max("depth").alias("size"))
    ids = sizes.select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    ids = stored(ids.join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left"), "borrowers")
    h, taken = F.col("h"), F.least("h", F.coalesce("base_size", F.lit(0)))
    lent = turns.filter("depth <= 8").withColumnRenamed("conv_id", "base").join(ids.select("conv_id", "base", "h"), "base")
    lent = lent.filter("depth <= h").select("conv_id", "depth", "s1", "s2", "bytes")
    own = spread_join(turns, ids.select("conv_id", "h", taken.alias("taken")), ["conv_id"], "inner", "depth").filter("depth > h")
    return lent.unionByName(own.select("conv_id", (F.col("depth") - h + F.col("taken")).cast("bigint").alias("depth"), "s1", "s2", "bytes"))


def trie_digest(conversations: DataFrame) -> DataFrame:
    turns = stored(numbered_turns(conversations), "turns")
    return prefix_trie(rebuilt(turns), turns.select("conv_id"))


SQL = r"""
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END), 4294967295::BIGINT) % 9 AS h
  FROM ids),
t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c, count(*) AS n FROM t GROUP BY c),
b AS (
  SELECT crc.c, t.i AS d, role, text FROM crc JOIN t ON t.c = crc.c - crc.c % 5 AND t.i <= h
  UNION ALL
  SELECT crc.c, t.i - h + least(h, coalesce(s.n, 0)) AS d, role, text FROM crc JOIN t ON t.c = crc.c AND t.i > h LEFT JOIN sizes s ON s.c = crc.c - crc.c % 5),
p AS (
  SELECT c, d, strlen(text) AS bytes, sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS k FROM b),
ways AS (
  SELECT c, d, bytes, k, coalesce(lag(k) OVER w, 'root') AS up, lead(k) OVER w IS NULL AS last FROM p WINDOW w AS (PARTITION BY c ORDER BY d)
  UNION ALL
  SELECT ids.c, 0, 0, 'root', NULL, NOT EXISTS (SELECT 1 FROM b WHERE b.c = ids.c) FROM ids),
nodes AS (
  SELECT k, any_value(up) AS up, any_value(d) AS d, min(c) AS c, count(*) AS n, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends FROM ways GROUP BY k),
kids AS (SELECT up AS k, count(*) AS children FROM nodes WHERE up IS NOT NULL GROUP BY up),
full_nodes AS (SELECT nodes.*, coalesce(children, 0) AS children FROM nodes LEFT JOIN kids USING (k)),
below AS (SELECT DISTINCT a.k AS top, z.k AS k FROM ways a JOIN ways z ON a.c = z.c AND z.d >= a.d),
sums AS (
  SELECT top, sum(CASE WHEN children = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * bytes) AS saved
  FROM below JOIN full_nodes USING (k) GROUP BY top)
SELECT f.c::BIGINT AS conv_id, f.d::BIGINT AS depth, u.c::BIGINT AS parent_conv_id, f.n::BIGINT AS n_convs, f.children::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_nodes f JOIN sums ON sums.top = f.k LEFT JOIN nodes u ON u.k = f.up
"""
