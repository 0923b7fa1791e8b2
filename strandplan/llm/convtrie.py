"""Prefix trie of conversations by partition refinement.

All conversations start in one class. A round takes a window of further turns of the conversations that are still
active and splits each class turn by turn: a class keeps together what agrees on the turn. A class's label is its
smallest conversation, which names the trie's node together with the depth. Conversations that are alone in their
class at a window's end are retired; what they have left becomes a unary chain in one pass at the end. Windows
double up to ``WINDOW`` turns, so rounds grow with the logarithm of the longest shared prefix, then with its
length over ``WINDOW``; each round reads only the turns that active conversations still have.

Then the rounds are folded back, deepest first: a conversation carries what the nodes that it names have below
them, and a node sums what its members carry. Only grouped sums and equi-joins meet a class, so a class that holds
most conversations is summed before it is shuffled, and turns travel as digests of 16 bytes, never as texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandplan.operators.numbering import places_in
from strandplan.plans.session import bounded_batches, written

#: Turns that a round splits by at most.
WINDOW = 64
#: The rebuilding of the contract's query: conversations of a block share heads of fewer than so many turns.
BLOCK, HEADS = 100, 6
#: Ids that one row of a digest's input holds.
IDS = 1 << 15
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_key(role: Column, text: Column) -> Column:
    """128 bits of SHA-256 of a turn's role and text; the role's length keeps the two apart."""
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(said, 256), 1, 32))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, depth, turn, chars)``: the turns of each conversation, numbered from 1.

    Null turns come first; turns that tie stand in the order of role and digest, so repeated rows are as many
    turns. A null role or text is an empty one. Rows without a ``conv_id`` belong to no conversation. Other columns
    are not looked at, whatever their names.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), role.alias("_role"), turn_key(role, text).alias("turn"), F.length(text).cast("long").alias("chars")
    )
    placed = places_in(rows, "conv_id", F.col("_turn").asc_nulls_first(), "_role", "turn", name="depth")
    return placed.select("conv_id", "depth", "turn", "chars")


def rebuilt_turns(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(``ordered_turns`` of the rebuilt conversations, ``(conv_id, turns)`` of all of them).

    Conversation c starts with the first h turns of conversation c - c % block, h = crc32(c) % heads, and goes on
    with its own behind its first h. A head is repeated for the at most ``2 * block`` conversations that share it.
    """
    own = turns.groupBy("conv_id").agg(F.max("depth").alias("own"))
    base = own.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    plan = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(base, "base", "left")
    plan = plan.withColumn("head", F.least("h", F.coalesce("base_turns", F.lit(0))))
    plan = written(plan.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns")), "trie-plan")
    tails = turns.join(plan.select("conv_id", "h", "head"), "conv_id").where(F.col("depth") > F.col("h"))
    tails = tails.select("conv_id", (F.col("depth") - F.col("h") + F.col("head")).alias("depth"), "turn", "chars")
    first = turns.where(F.col("depth") < heads).withColumnRenamed("conv_id", "base")
    shared = first.join(plan.where("head > 0").select("conv_id", "base", "head"), "base").where(F.col("depth") <= F.col("head"))
    return written(tails.unionByName(shared.select("conv_id", "depth", "turn", "chars")), "trie-turns"), plan.select("conv_id", "turns")


def _split(live: DataFrame, last: int) -> DataFrame:
    """One round: ``(conv_id, depth, label, n, ended, chars, turns, parent)``, a row for each active conversation and turn up to ``last``.

    A turn's key is the digest of the class before and all turns since, so equal keys of a depth are one class.
    """
    steps = F.sort_array(F.collect_list(F.struct("depth", "turn", "chars")))
    members = live.where(F.col("depth") <= last).groupBy("conv_id", "label", "turns").agg(steps.alias("steps"))
    seed = F.array(F.unhex(F.sha2(F.col("label").cast("string"), 256)))
    keys = F.aggregate("steps", seed, lambda ks, s: F.concat(ks, F.array(F.unhex(F.sha2(F.concat(F.element_at(ks, -1), s["turn"]), 256)))))
    walked = members.select("conv_id", F.col("label").alias("before"), "turns", "steps", keys.alias("keys"))
    walked = walked.select("conv_id", "before", "turns", "keys", F.posexplode("steps").alias("at", "step"))
    walked = walked.select("conv_id", "before", "turns", F.col("step.depth").alias("depth"), F.col("step.chars").alias("chars"), F.get("keys", F.col("at") + 1).alias("key"))
    walked = written(walked, "trie-walk")
    classes = walked.groupBy("depth", "key").agg(F.min("conv_id").alias("label"), F.count("*").alias("n"), F.sum((F.col("turns") == F.col("depth")).cast("long")).alias("ended"))
    # Written, so that the join stands between two plain exchanges and adaptive execution can split a class that holds most rows.
    placed = walked.join(written(classes, "trie-classes"), ["depth", "key"])
    parent = F.coalesce(F.lag("label").over(Window.partitionBy("conv_id").orderBy("depth")), F.col("before"))
    return placed.select("conv_id", "depth", "label", "n", "ended", "chars", "turns", parent.alias("parent"))


def _fold(placed: DataFrame, carried: DataFrame) -> DataFrame:
    """A round's rows with what each conversation carries up to its node: ``(..., saved, leaf, opened, opens)``.

    ``saved`` sums the nodes that the conversation names from here on, ``leaf`` says whether it names a childless
    node, ``opens`` whether it names the node of the row, ``opened`` whether it names the next one.
    """
    each = Window.partitionBy("conv_id").orderBy("depth")
    onward = each.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    opens = F.col("label") == F.col("conv_id")
    rows = placed.withColumn("opens", opens).join(carried, "conv_id", "left")
    # A conversation without carry that has turns left was retired: its tail is a chain of its own.
    retired = F.col("carried_saved").isNull() & (F.col("turns") > F.col("depth"))
    last = F.col("turns") == F.col("depth")
    leaf = F.when(last, opens & (F.col("ended") == F.col("n"))).otherwise(F.coalesce("carried_leaf", F.lit(True)))
    own = F.when(opens, (F.col("n") - 1) * F.col("chars")).otherwise(0)
    return rows.withColumns({"_leaf": leaf, "_own": own}).select(
        "conv_id", "depth", "label", "n", "turns", "parent", "opens", F.last("_leaf").over(onward).alias("leaf"),
        (F.sum("_own").over(onward) + F.coalesce("carried_saved", F.lit(0))).alias("saved"),
        F.coalesce(F.lead("opens").over(each), F.when(last, False), F.col("carried_opens"), retired).alias("opened"),
    )


def _id_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (label, depth) in order as rows of at most ``IDS`` ids."""
    names = ["label", "depth", "first", "ids"]
    now, ids = None, []

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=names)

    for batch in batches:
        for node, run in groupby(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True), key=lambda r: r[:2]):
            for r in run:
                if ids and (node != now or len(ids) == IDS):
                    yield row()
                    ids = []
                now = node
                ids.append(r[2])
    if ids:
        yield row()


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids; a digest takes rows in order, so what a task holds is one row."""
    names = ["label", "depth", "ends_sha256"]
    now, state = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([state.hexdigest()])], names=names)

    for batch in batches:
        for label, depth, ids in zip(batch.column("label").to_pylist(), batch.column("depth").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if (label, depth) != now:
                if now:
                    yield row()
                now, state = (label, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if now:
        yield row()


def ends_digests(ends: DataFrame) -> DataFrame:
    """``(label, depth, ends_sha256)`` of ``(label, depth, conv_id)``: the ids that end at a node, ascending, comma-joined.

    The ids are packed in ranges, so a node where most conversations end is spread over tasks; SHA-256 itself takes
    its input in order, so one task reads such a node's packed rows as a stream.
    """
    bounded_batches(ends.sparkSession)
    order = ["label", "depth", "conv_id"]
    packed = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_id_rows, "label long, depth long, first long, ids string")
    dealt = packed.repartition("label", "depth").sortWithinPartitions("label", "depth", "first")
    return dealt.mapInArrow(_digests, "label long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The trie of ``turns (conv_id, depth, turn, chars)`` of the conversations ``convs (conv_id, turns)``, a row a node: ``NODE``.

    A node is named by its smallest member and its depth, the root has depth 0 and no parent. ``saved_tokens`` sums
    over the subtree what its nodes' turns would cost again in every member but one. Both tables are read several
    times, so they should be written ones. Conversations without turns are members of the root alone; without any
    conversation there is no root either, and the result is empty.
    """
    spark = turns.sparkSession
    root = convs.agg(F.min("conv_id").alias("label"), F.count("*").alias("n"), F.sum((F.col("turns") == 0).cast("long")).alias("ended")).where("n > 0")
    live = turns.join(convs, "conv_id").join(F.broadcast(root.select("label")))  # one row
    rounds, last, wide = [], 0, 1
    while True:
        last, wide = last + wide, min(2 * wide, window)
        placed = written(_split(live, last), "trie-round")
        rounds.append((placed, last))
        active = placed.where((F.col("depth") == last) & (F.col("n") > 1) & (F.col("turns") > last)).select("conv_id", "label")
        live = written(live.where(F.col("depth") > last).drop("label").join(active, "conv_id"), "trie-live")
        if live.isEmpty():
            break
    carried = spark.createDataFrame([], "conv_id long, carried_saved long, carried_leaf boolean, carried_opens boolean")
    folded, nodes, chains, top = [], [], [], None
    for k, (placed, last) in reversed(list(enumerate(rounds))):
        back = written(_fold(placed, carried), "trie-fold")
        folded.append(back)
        top = back.where(F.col("depth") == (1 if k == 0 else rounds[k - 1][1] + 1))
        carried = top.select("conv_id", F.col("saved").alias("carried_saved"), F.col("leaf").alias("carried_leaf"), F.col("opens").alias("carried_opens"))
        nodes.append(back.groupBy("label", "depth").agg(
            F.max(F.when(F.col("opens"), F.col("parent"))).alias("parent_conv_id"), F.max("n").alias("n_convs"), F.sum(F.col("opened").cast("long")).alias("n_children"),
            F.sum(F.col("leaf").cast("long")).alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
        ))
        chains.append(back.where((F.col("depth") == last) & (F.col("n") == 1) & (F.col("turns") > last)).select("conv_id", F.col("depth").alias("kept"), "turns"))
    every = folded[0]
    for back in folded[1:]:
        every = every.unionByName(back)
    below = top.agg(F.coalesce(F.sum(F.col("opens").cast("long")), F.lit(0)).alias("n_children"), F.greatest(F.coalesce(F.sum(F.col("leaf").cast("long")), F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    whole = root.crossJoin(below).select("label", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    shared, chain = whole, chains[0]
    for part in nodes:
        shared = shared.unionByName(part)
    for part in chains[1:]:
        chain = chain.unionByName(part)
    ends = every.where(F.col("turns") == F.col("depth")).select("label", "depth", "conv_id")
    empty = convs.where("turns = 0").crossJoin(F.broadcast(root.select("label"))).select("label", F.lit(0).cast("long").alias("depth"), "conv_id")
    shared = shared.join(ends_digests(ends.unionByName(empty)), ["label", "depth"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    shared = shared.withColumnRenamed("label", "conv_id").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    over = F.col("depth") == F.col("turns")
    alone = turns.select("conv_id", "depth").join(chain, "conv_id").where(F.col("depth") > F.col("kept")).select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (~over).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(over, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("ends_sha256"),
    )
    return shared.select(*NODE).unionByName(alone.select(*NODE))


def conversation_trie(conversations: DataFrame, block: int = BLOCK, heads: int = HEADS, window: int = WINDOW) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations (``rebuilt_turns``) of a table ``(conv_id, turn, role, text)``."""
    turns, convs = rebuilt_turns(written(ordered_turns(conversations), "trie-own"), block, heads)
    return prefix_trie(turns, convs, window)


def _crc32_sql(text: str) -> str:
    """DuckDB has no crc32: eight shifts a byte, the polynomial reversed."""
    bits = "list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295]::BIGINT[], {codes}), lambda crc, byte: {bits}), 4294967295)"


def op11_sql() -> str:
    """DuckDB: nodes are distinct digests of prefixes; a subtree is found by the paths of the conversations that name its nodes."""
    return f"""
WITH o AS (SELECT conv_id::BIGINT AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
        md5(coalesce(role, '')) || md5(coalesce(text, '')) AS k, length(coalesce(text, ''))::BIGINT AS chars FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, max(p) AS own, {_crc32_sql('c::VARCHAR')} % {HEADS} AS h, c - c % {BLOCK} AS b FROM o GROUP BY c),
l AS (SELECT h.*, least(h.h, coalesce(x.own, 0)) AS head FROM h LEFT JOIN h x ON x.c = h.b),
r AS (SELECT l.c, o.p AS d, o.k, o.chars FROM l JOIN o ON o.c = l.b AND o.p <= l.head
      UNION ALL SELECT l.c, o.p - l.h + l.head, o.k, o.chars FROM l JOIN o ON o.c = l.c AND o.p > l.h),
paths AS (SELECT c, 0 AS d, '' AS pre, 0 AS chars FROM l
          UNION ALL SELECT c, d, md5(string_agg(k, ',') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)), chars FROM r),
lens AS (SELECT c, max(d) AS len FROM paths GROUP BY c),
n AS (SELECT d, pre, min(c) AS label, count(*) AS n_convs, any_value(chars) AS chars,
        coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = d), '') AS ends FROM paths JOIN lens USING (c) GROUP BY d, pre),
m AS (SELECT paths.c, paths.d, n.label FROM paths JOIN n USING (d, pre)),
up AS (SELECT n.*, m.label AS parent FROM n LEFT JOIN m ON m.c = n.label AND m.d = n.d - 1),
kids AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM up WHERE d > 0 GROUP BY ALL),
f AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids ON kids.parent = up.label AND kids.d = up.d),
s AS (SELECT m.label, m.d, sum((f.n_convs - 1) * f.chars) AS saved, count(*) FILTER (f.n_children = 0) AS leaves
      FROM f JOIN m ON m.c = f.label AND m.d <= f.d GROUP BY ALL)
SELECT f.label AS conv_id, f.d::BIGINT AS depth, f.parent AS parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256 FROM f JOIN s ON s.label = f.label AND s.d = f.d
"""
