"""Conversation prefix trie by SQL ROLLUP over positional turn-id columns.

Conversations are cut into blocks of ``WIDTH`` turns, one row of turn ids ``t1,
..., tw`` each.  ``GROUP BY block, x1, x2, ROLLUP (t1, ..., tw)`` aggregates all
prefixes of all blocks together; ``grouping_id()`` tells the depth of a group.
``x1, x2`` stand for the turns of the blocks before: the xor of 120 bits of the
md5 of every (block number, its turns), a running value per conversation, so that
no block waits for another and the number of Spark stages is the same whatever
the longest conversation.

What a node adds to all nodes above it goes by its smallest member: a second
ROLLUP sums a block's own nodes, and each row of a block brings what its
conversation's nodes add in later blocks (a running sum from its end).

A turn id is the md5 of (role, text) with the text's length in code points; a
node's key is the md5 of its depth and of x1, x2 as they stand after its last turn.

Skew: a prefix of any number of conversations is one row per map task (partial
aggregation); positions inside a conversation come from running counts over
ranges of all turns, so a conversation of any length is split over tasks, and
its turns lie in blocks of at most 32.

Defined cases: rows with NULL conv_id belong to no conversation; NULL role or
text is empty; turns are ordered by ``turn``, NULL first, equal ones by the md5
of (role, text); repeated rows are repeated turns; a conversation without turns
is a member of the root alone; no conversations give no rows, not even a root;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainline.operators.ranking import running_count
from grainline.session import materialize

#: Turns of a block: a row becomes one more than these in the ROLLUP.
WIDTH = 8
_TURNS = [f"t{j}" for j in range(1, WIDTH + 1)]
#: How many first turns conversations take from that which leads their hundred.
SHARED = 5


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes of md5 and 4 bytes of the text's code points."""
    size = F.length(role).cast("string")
    return F.unhex(F.concat(F.md5(F.concat(size, F.lit(":"), role, text)), F.lpad(F.hex(F.length(text)), 8, "0")))


def _code_points(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 17, 4)), 16, 10).cast("long")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn): turns of each conversation numbered from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select("conv_id", F.col("turn").alias("at"), turn_id(role, text).alias("turn"))
    counted = turns.groupBy("conv_id", "at", "turn").agg(F.count(F.lit(1)).alias("n"))
    placed = running_count(counted, [F.col("conv_id"), F.col("at").asc_nulls_first(), F.col("turn")], "n", "before")
    placed = materialize(placed, "trie-turns")
    start = placed.groupBy("conv_id").agg(F.min("before").alias("start"))
    # a repeated turn is one row with its count up to here
    place = F.col("before") - F.col("start")
    return placed.join(start, "conv_id").select("conv_id", F.explode(F.sequence(place + 1, place + F.col("n"))).alias("pos"), "turn")


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, turns) of the rebuilt conversations: the first h turns of
    conversation c - c % 100, then c's own after its first h, with
    h = crc32(c) % 6.  members: (conv_id, n_turns); turns: (conv_id, pos, turn)."""
    own = materialize(numbered_turns(conversations), "trie-own")
    sizes = materialize(own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "trie-sizes")
    heads = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = (sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
            .withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1))
            .join(heads, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))))
    plan = materialize(plan.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), "trie-plan")
    lead = own.filter((F.col("pos") <= SHARED) & (F.col("conv_id") % 100 == 0)).withColumnRenamed("conv_id", "base")
    shared = plan.join(lead, "base").filter("pos <= h").select("conv_id", "pos", "turn")
    rest = own.join(plan.select("conv_id", "h", "taken"), "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn")
    return plan.select("conv_id", "n_turns"), materialize(shared.union(rest), "trie-rebuilt")


def _block_bits(turns: list[str | Column]) -> list[Column]:
    """Two longs of 60 bits of the md5 of the block's number and first turns."""
    none = F.unhex(F.lit(""))
    digest = F.md5(F.concat(F.concat(F.col("block").cast("string"), F.lit(":")).cast("binary"), *[F.coalesce(t, none) for t in turns]))
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]


def _key(depth: Column, x1: Column, x2: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth, x1, x2)))


def _level_key(level: Column, turns: list[str | Column]) -> Column:
    """Node of the block's first ``level`` turns (the later ones are NULL)."""
    h1, h2 = _block_bits(turns)
    x1, x2 = (F.when(level > 0, F.col(x).bitwiseXOR(h)).otherwise(F.col(x)) for x, h in (("x1", h1), ("x2", h2)))
    return _key(F.col("block") * WIDTH + level, x1, x2)


def _blocks(members: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, block, t1, ..., x1, x2): a row per conversation and
    block; a conversation without turns has an empty first block."""
    at = F.pmod(F.col("pos") - 1, F.lit(WIDTH))
    block = F.floor((F.col("pos") - 1) / WIDTH).cast("long")
    wide = turns.groupBy("conv_id", block.alias("block")).agg(*[F.max(F.when(at == j, F.col("turn"))).alias(n) for j, n in enumerate(_TURNS)])
    rows = members.join(wide, "conv_id", "left").withColumn("block", F.coalesce("block", F.lit(0).cast("long")))
    h1, h2 = _block_bits(_TURNS)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({"h1": h1, "h2": h2}).withColumns(
        {f"x{i}": F.coalesce(F.bit_xor(f"h{i}").over(before), F.lit(0).cast("long")) for i in (1, 2)}).drop("h1", "h2")


def _rolled(rows: DataFrame, aggregates: str) -> DataFrame:
    """One row per prefix of the blocks' columns, with its ``level``.  A later
    block's level 0 is the last level of the block before."""
    cols = ", ".join(_TURNS)
    out = rows.sparkSession.sql(
        f"SELECT block, x1, x2, {cols}, {WIDTH} - bit_count(grouping_id()) AS level, {aggregates} FROM {{rows}} GROUP BY block, x1, x2, ROLLUP ({cols})", rows=rows)
    filled = sum((F.col(n).isNotNull().cast("int") for n in _TURNS), F.lit(0))
    return out.filter((F.col("level") == filled) & ((F.col("level") > 0) | (F.col("block") == 0)))


def prefix_trie(members: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trie of (conv_id, n_turns) members with their (conv_id, pos, turn) rows.

    Returns ``nodes`` (node, parent, depth, turn, conv_id, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens), one row per distinct prefix, and ``ends``
    (node, conv_id), one row per member: the node of its last turn."""
    wide = materialize(_blocks(members, turns), "trie-blocks")
    level, start = F.col("level"), F.col("block") * WIDTH
    above = [F.when(level > j, F.col(n)) for j, n in enumerate(_TURNS, 1)]
    nodes = (_rolled(wide, "count(*) AS n_convs, min(conv_id) AS conv_id, max(n_turns) AS longest")
             .withColumn("turn", F.coalesce(*[F.col(n) for n in reversed(_TURNS)])).withColumn("depth", start + level)
             .withColumn("node", _level_key(level, _TURNS))
             .withColumn("parent", F.when(level > 0, _level_key(level - 1, above))))
    nodes = materialize(nodes, "trie-nodes")
    last = wide.filter(F.col("n_turns") <= start + WIDTH)
    ends = last.select(_level_key(F.col("n_turns") - start, _TURNS).alias("node"), "conv_id")

    # what each node adds to those above it, in its block and in those before
    added = nodes.select("conv_id", "block", "x1", "x2", *_TURNS, (F.col("longest") == F.col("depth")).cast("long").alias("leaf"),
                         ((F.col("n_convs") - 1) * F.coalesce(_code_points(F.col("turn")), F.lit(0))).alias("saved"))
    sums = added.groupBy("conv_id", "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = (wide.join(sums, ["conv_id", "block"], "left").withColumns({c: F.sum(c).over(later) for c in ("leaf", "saved")})
               .filter("leaf is not null"))
    cols = ["block", "x1", "x2", *_TURNS, "leaf", "saved"]
    totals = (_rolled(added.select(*cols).union(carried.select(*cols)), "sum(leaf) AS n_leaves, sum(saved) AS saved_tokens")
              .select(_level_key(level, _TURNS).alias("node"), "n_leaves", "saved_tokens"))
    nodes = nodes.select("node", "parent", "depth", "turn", "conv_id", "n_convs")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    own = nodes.join(totals, "node").join(children, "node", "left")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = own.join(parents, "parent", "left").select(
        "node", "parent", F.col("depth").cast("long").alias("depth"), "turn", "conv_id", "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens")
    return materialize(out, "trie"), materialize(ends, "trie-ends")


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest is over one text, so a node's ids meet
    at last; before, they are joined in runs of ids that lie within 4,096."""
    runs = (ends.groupBy("node", F.shiftright("conv_id", 12).alias("run"))
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")))
    texts = runs.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("run", "ids"))).alias("runs"))
    return texts.select("node", F.sha2(F.array_join(F.col("runs.ids"), ",").cast("binary"), 256).alias("ends_sha256"))


def turn_texts(conversations: DataFrame) -> DataFrame:
    """(turn, role, text) of every distinct turn, for the nodes' ``turn`` ids."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.select(turn_id(role, text).alias("turn"), role.alias("role"), text.alias("text")).dropDuplicates(["turn"])


def trie_report(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, one row per node, with the digest
    of the conversations that end there."""
    nodes, ends = prefix_trie(*rebuild(conversations))
    return nodes.join(ends_digest(ends), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
