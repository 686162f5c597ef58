"""Prefix trie of conversations, with totals of every subtree by parallel tree contraction.

A node is a distinct sequence of first turns. It is known by its depth and 128 bits: the exclusive or of
hashes of (position, turn) along the sequence. That sum can be taken in any order, so a conversation is
cut into blocks of turns, and the node before a turn follows from the node at it; no conversation, however
long, is walked in one task. Positions come from one sort of all turns over all tasks.

Totals of subtrees are found by contraction. Each round compresses and rakes:

* compress: a node with one child is taken out, and keeps "my total is this much more than the total of
  that node below". Chains are summed run by run in windows of at most ``RUN`` nodes; what is left of a
  chain, its runs, is halved in joins until every run points at the chain's lower end;
* rake: a node without children has its whole total; it is written down and added to its parent's.

A tree loses at least half of its nodes a round, so the rounds are few also for deep and lopsided trees.
Then, from the last round to the first, the nodes that were taken out are expanded again: each adds what it
kept to the total of the node below it.

Defined cases: null turns come first; turns that agree in number are taken by role and then by the text's
SHA-256, and rows that agree in everything are turns of their own; null roles and texts are empty; rows
without a conversation id are left out, ids are integers; a conversation or text of any length is whole; no
rows give no nodes, not even the root; extra columns, whatever their names, are left out.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from troughline.llm.base import python_ready, stage

#: Nodes of a chain that one window sums.
RUN = 256
#: Turns of a conversation in one block of the running hash.
BLOCK = 1024
#: Range of conversation ids whose ends at one node are joined to one string.
CHUNK = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODE = ["depth", "hi", "lo"]
_PLACE = (1 << 33) - 1  # low bits of Spark's increasing id: the row in its partition


def _turns(df, conv, turn, role, text):
    """Narrow rows: a text stands as its length and 120 bits of its SHA-256, which also order ties."""
    sha = F.sha2(F.coalesce(df[text].cast("string"), F.lit("")), 256)
    rows = df.select(
        df[conv].cast("long").alias("conv"),
        df[turn].alias("turn"),
        F.coalesce(df[role].cast("string"), F.lit("")).alias("role"),
        F.char_length(F.coalesce(df[text].cast("string"), F.lit(""))).cast("long").alias("chars"),
        F.substring(sha, 1, 30).alias("sha"),
    )
    half = [F.conv(F.substring("sha", at, 15), 16, 10).cast("long").alias(name) for at, name in ((1, "ta"), (16, "tb"))]
    return rows.where(F.col("conv").isNotNull()).select("conv", "turn", "role", "chars", *half)


def _sorted(turns):
    """All turns in order over all partitions, stored, and for each (conversation, partition) where it lies."""
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("ta"), F.asc("tb")]
    mid = F.monotonically_increasing_id()
    rows = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mid", mid)
    rows = rows.withColumn("part", F.shiftright("mid", 33)).withColumn("at", F.col("mid").bitwiseAND(F.lit(_PLACE)))
    rows = stage(rows.drop("mid", "turn"), "turns")
    pieces = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    within = Window.partitionBy("conv")
    pieces = pieces.select(
        "conv", "part", "first",
        (F.sum("n").over(within.orderBy("part")) - F.col("n")).alias("before"),
        F.sum("n").over(within).alias("n"),
    )
    return rows, stage(pieces, "pieces")


def _ranked(rows, pieces, *extra):
    """Turns with their rank in the conversation (from 1)."""
    rank = F.col("before") + F.col("at") - F.col("first") + 1
    return rows.join(pieces, ["conv", "part"]).select("conv", rank.alias("rank"), "role", "chars", "ta", "tb", "n", *extra)


def original(df, conv="conv_id", turn="turn", role="role", text="text"):
    """Turns (conv, pos, len, role, chars, ta, tb) and conversations (conv, len) as they are in ``df``."""
    rows, pieces = _sorted(_turns(df, conv, turn, role, text))
    turns = _ranked(rows, pieces).select("conv", F.col("rank").alias("pos"), F.col("n").alias("len"), "role", "chars", "ta", "tb")
    return turns, pieces.select("conv", F.col("n").alias("len")).distinct()


def rebuilt(df, base, shared, most, conv="conv_id", turn="turn", role="role", text="text"):
    """The same, each conversation rebuilt to share its first turns with another.

    ``base`` and ``shared`` are SQL text over ``conv``: conversation ``conv`` begins with the first ``shared``
    turns (``most`` at most) of conversation ``base``, fewer if that has fewer, and goes on with its own
    turns after its first ``shared``.
    """
    rows, pieces = _sorted(_turns(df, conv, turn, role, text))
    convs = pieces.select("conv", "n").distinct()
    convs = convs.select("conv", "n", F.expr(base).alias("base"), F.expr(shared).cast("long").alias("h"))
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    shift = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.join(bases, "base", "left").select(
        "conv", "base", "h", shift.alias("shift"), (shift + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len")
    )
    convs = stage(convs, "rebuilt")
    columns = ["role", "chars", "ta", "tb"]
    placed = pieces.join(convs, "conv")
    own = _ranked(rows, placed, "h", "shift", "len").where("rank > h")
    own = own.select("conv", (F.col("rank") - F.col("h") + F.col("shift")).alias("pos"), "len", *columns)
    heads = _ranked(rows, pieces.join(convs.select(F.col("base").alias("conv")).distinct(), "conv")).where(F.col("rank") <= most)
    heads = heads.select(F.col("conv").alias("base"), F.col("rank").alias("pos"), *columns)
    given = convs.join(heads, "base").where("pos <= h").select("conv", "pos", "len", *columns)
    return own.union(given), convs.select("conv", "len")


def _steps(turns):
    """Per turn the node that it ends (hi, lo) and the node before it (phi, plo); depth is its position."""
    key = [F.col(c) for c in ("pos", "role", "ta", "tb")]
    rows = turns.withColumn("h1", F.xxhash64(*key)).withColumn("h2", F.xxhash64(*key[::-1]))
    rows = rows.withColumn("block", F.expr(f"pos div {BLOCK}"))
    upto = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("x1", F.expr("bit_xor(h1)").over(upto)).withColumn("x2", F.expr("bit_xor(h2)").over(upto))
    rows = rows.drop("role", "ta", "tb")
    # the blocks before: one row a block; only conversations of more than one have any
    long = rows.where(F.col("len") >= BLOCK)
    blocks = long.groupBy("conv", "block").agg(F.expr("bit_xor(h1)").alias("c1"), F.expr("bit_xor(h2)").alias("c2"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(
        "conv", "block",
        *[F.coalesce(F.expr(f"bit_xor({c})").over(earlier), F.lit(0)).alias(c) for c in ("c1", "c2")],
    )
    nothing = F.lit(0).cast("long")
    rows = rows.where(F.col("len") < BLOCK).withColumns({"c1": nothing, "c2": nothing}).unionByName(
        long.join(carry, ["conv", "block"]))
    hi, lo = F.col("x1").bitwiseXOR(F.col("c1")), F.col("x2").bitwiseXOR(F.col("c2"))
    return rows.select(
        "conv", F.col("pos").alias("depth"), hi.alias("hi"), lo.alias("lo"),
        hi.bitwiseXOR(F.col("h1")).alias("phi"), lo.bitwiseXOR(F.col("h2")).alias("plo"),
        "chars", (F.col("pos") == F.col("len")).alias("last"),
    )


def _ends(steps, convs):
    """Per node with conversations that end there: the digest of their ids, ascending.

    Ids are joined to strings of at most ``CHUNK``; one task reads the strings of a node in order, since the
    digest of a whole can only be taken in order, and holds one of them at a time.
    """
    turnless = convs.where("len = 0").select("conv", *[F.lit(0).cast("long").alias(c) for c in _NODE])
    rows = steps.where("last").select("conv", *_NODE).union(turnless)
    ids = F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids")
    chunks = rows.withColumn("chunk", F.expr(f"conv div {CHUNK}")).groupBy(*_NODE, "chunk").agg(ids)
    chunks = chunks.repartition(*_NODE).sortWithinPartitions(*_NODE, "chunk")

    def digests(batches):
        def finished(nodes, found):
            columns = [pa.array([n[k] for n in nodes], pa.int64()) for k in range(3)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string())], names=[*_NODE, "ends_sha256"])

        current = running = None
        for batch in batches:
            nodes, found = [], []
            for *node, ids in zip(*[batch.column(c).to_pylist() for c in (*_NODE, "ids")]):
                if node != current:
                    if current is not None:
                        nodes.append(current)
                        found.append(running.hexdigest())
                    current, running = node, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.encode())
            yield finished(nodes, found)
        if current is not None:
            yield finished([current], [running.hexdigest()])

    return chunks.mapInArrow(digests, "depth long, hi long, lo long, ends_sha256 string")


# --- contraction ------------------------------------------------------------------------------------
#
# Nodes are named by (c, d): smallest member and depth. ``leaves`` and ``saved`` are what a node has gathered so
# far; ``e_leaves`` and ``e_saved`` lie on the edge to its parent (pc, pd): what the parent gets besides the
# node's own total, on behalf of nodes between the two that were taken out.


def _on(left, right):
    """Condition that names two pairs of columns as the same node."""
    return (F.col(left[0]) == F.col(right[0])) & (F.col(left[1]) == F.col(right[1]))


def _with_children(active):
    """Each node with its number of children ``k``, the only child (cc, cd) if it is one, and what lies on the edges."""
    children = active.where("pc is not null").groupBy(F.col("pc").alias("uc"), F.col("pd").alias("ud")).agg(
        F.count(F.lit(1)).alias("k"), F.min("c").alias("cc"), F.min("d").alias("cd"),
        F.sum("e_leaves").alias("x_leaves"), F.sum("e_saved").alias("x_saved"))
    found = active.join(children, _on(("c", "d"), ("uc", "ud")), "left").drop("uc", "ud")
    return found.withColumn("k", F.coalesce("k", F.lit(0)))


def _runs(unary):
    """Nodes with one child, each with the node below its run (tc, td), and what it has more than that node.

    A run is a stretch of a chain inside one window: nodes of one smallest member and successive depths.
    """
    block = Window.partitionBy("c", "block").orderBy("d")
    follows = (F.lag("cc").over(block) == F.col("c")) & (F.lag("cd").over(block) == F.col("d"))
    rows = unary.withColumn("block", F.expr(f"d div {RUN}"))
    rows = rows.withColumn("head", ~F.coalesce(follows, F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.col("head").cast("long")).over(block))
    down = Window.partitionBy("c", "block", "run").orderBy("d").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.select(
        "c", "d", "pc", "pd", "e_leaves", "e_saved", "head",
        F.last("cc").over(down).alias("tc"), F.last("cd").over(down).alias("td"),
        F.sum(F.col("leaves") + F.col("x_leaves")).over(down).alias("a_leaves"),
        F.sum(F.col("saved") + F.col("x_saved")).over(down).alias("a_saved"),
    )


def _hopped(rows, heads):
    """Rows that point at the head of a run point on to where that head points; ``hop`` tells which did."""
    ahead = heads.select(
        F.col("c").alias("hc"), F.col("d").alias("hd"), F.col("tc").alias("to_c"), F.col("td").alias("to_d"),
        F.col("a_leaves").alias("more_leaves"), F.col("a_saved").alias("more_saved"))
    return rows.join(ahead, _on(("tc", "td"), ("hc", "hd")), "left").withColumns({
        "tc": F.coalesce("to_c", "tc"), "td": F.coalesce("to_d", "td"),
        "a_leaves": F.col("a_leaves") + F.coalesce("more_leaves", F.lit(0)),
        "a_saved": F.col("a_saved") + F.coalesce("more_saved", F.lit(0)),
        "hop": F.col("to_c").isNotNull(),
    }).select(*rows.columns, "hop")


def _compressed(tree):
    """Take out all nodes with one child: (what is left, what was taken out, or None if nothing was).

    ``tree`` comes from ``_with_children``. Taken out are (c, d, tc, td, a_leaves, a_saved).
    """
    rest = tree.where("k <> 1")
    if tree.where("k = 1").isEmpty():
        return rest, None
    unary = stage(_runs(tree.where("k = 1")), "runs")
    heads = unary.where("head")
    tops = heads
    hopped = stage(_hopped(heads, heads), "heads")
    if not hopped.where("hop").isEmpty():
        # chains of several runs: every head of a run is pointed on to the end of its chain
        inner = heads.select(F.col("tc").alias("ic"), F.col("td").alias("id"))
        while not hopped.where("hop").isEmpty():
            ends = hopped.drop("hop")
            hopped = stage(_hopped(ends, ends), "heads")
        ends = hopped.drop("hop")
        unary = stage(_hopped(unary, ends).drop("hop"), "runs")
        tops = ends.join(inner, _on(("c", "d"), ("ic", "id")), "left_anti")
    moved = tops.select(
        F.col("tc").alias("mc"), F.col("td").alias("md"), F.col("pc").alias("new_pc"), F.col("pd").alias("new_pd"),
        (F.col("e_leaves") + F.col("a_leaves")).alias("new_leaves"), (F.col("e_saved") + F.col("a_saved")).alias("new_saved"))
    own = F.col("mc").isNull()
    rest = rest.join(moved, _on(("c", "d"), ("mc", "md")), "left").withColumns({
        "pc": F.when(own, F.col("pc")).otherwise(F.col("new_pc")),
        "pd": F.when(own, F.col("pd")).otherwise(F.col("new_pd")),
        "e_leaves": F.when(own, F.col("e_leaves")).otherwise(F.col("new_leaves")),
        "e_saved": F.when(own, F.col("e_saved")).otherwise(F.col("new_saved")),
    }).select(*tree.columns)
    return rest, unary.select("c", "d", "tc", "td", "a_leaves", "a_saved")


_ACTIVE = ["c", "d", "pc", "pd", "leaves", "saved", "e_leaves", "e_saved"]


def _raked(rest):
    """Take the leaves off: (what is left, totals of the leaves)."""
    leaves = rest.where("k = 0")
    gifts = leaves.where("pc is not null").groupBy(F.col("pc").alias("gc"), F.col("pd").alias("gd")).agg(
        F.sum(F.col("leaves") + F.col("e_leaves")).alias("g_leaves"), F.sum(F.col("saved") + F.col("e_saved")).alias("g_saved"))
    left = rest.where("k > 1").join(gifts, _on(("c", "d"), ("gc", "gd")), "left").withColumns({
        "leaves": F.col("leaves") + F.coalesce("g_leaves", F.lit(0)),
        "saved": F.col("saved") + F.coalesce("g_saved", F.lit(0)),
    })
    return left.select(*_ACTIVE), leaves.select("c", "d", "leaves", "saved")


def subtree_totals(nodes):
    """(c, d, leaves, saved) summed over the subtree of every node.

    ``nodes`` is (c, d, pc, pd, leaves, saved): name, parent's name (null: a root), own values.
    """
    nothing = F.lit(0).cast("long")
    active = nodes.withColumns({"e_leaves": nothing, "e_saved": nothing}).select(*_ACTIVE)
    totals, taken = [], []
    while True:
        tree = stage(_with_children(active), "tree")
        if tree.isEmpty():
            break
        rest, out = _compressed(tree)
        if out is not None:
            taken.append(out)
            rest = stage(rest, "rest")
        left, done = _raked(rest)
        totals.append(done)
        active = stage(left, "left")
    if not totals:
        return nodes.select("c", "d", "leaves", "saved")
    known = totals[0]
    for more in totals[1:]:
        known = known.union(more)
    for out in reversed(taken):
        below = known.select(F.col("c").alias("bc"), F.col("d").alias("bd"), "leaves", "saved")
        again = out.join(below, _on(("tc", "td"), ("bc", "bd"))).select(
            "c", "d", (F.col("a_leaves") + F.col("leaves")).alias("leaves"), (F.col("a_saved") + F.col("saved")).alias("saved"))
        known = known.union(stage(again, "expanded"))
    return known


def prefix_trie(turns, convs):
    """One row for each node of the trie of ``turns`` and ``convs``, as ``original`` or ``rebuilt`` give them.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the
    subtree: members less one, times code points of the node's last text) and ends_sha256.
    """
    spark = turns.sparkSession
    python_ready(spark)
    steps = stage(_steps(turns), "steps")
    nodes = steps.groupBy(*_NODE).agg(
        F.min("conv").alias("c"), F.count(F.lit(1)).alias("n"), F.first("phi").alias("phi"),
        F.first("plo").alias("plo"), F.first("chars").alias("chars"))
    nothing = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("c"), F.count(F.lit(1)).alias("n")).where("n > 0").select(
        *[nothing.alias(x) for x in _NODE], "c", "n", nothing.alias("phi"), nothing.alias("plo"), nothing.alias("chars"))
    nodes = stage(nodes.union(root), "nodes")
    # the root's children can be a great part of all nodes, so its name is no key of the join
    inner = nodes.where("depth > 1")
    parents = nodes.where("depth > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("c").alias("pc"))
    named = inner.join(parents, ["depth", "phi", "plo"])
    top = nodes.where("depth = 0").first()
    first = nodes.where("depth = 1").withColumn("pc", F.lit(top.c if top else None).cast("long"))
    columns = [*_NODE, "c", "n", "chars", "pc"]
    named = named.select(*columns).union(first.select(*columns)).union(
        nodes.where("depth = 0").withColumn("pc", F.lit(None).cast("long")).select(*columns))
    named = stage(named, "named")

    children = named.where("depth > 0").groupBy(F.col("pc").alias("kc"), (F.col("depth") - 1).alias("kd")).agg(
        F.count(F.lit(1)).alias("n_children"))
    named = stage(named.join(children, _on(("c", "depth"), ("kc", "kd")), "left").select(
        *columns, F.coalesce("n_children", nothing).alias("n_children")), "named")
    own = named.select(
        "c", F.col("depth").alias("d"), "pc", F.when(F.col("depth") > 0, F.col("depth") - 1).alias("pd"),
        (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved"))
    totals = subtree_totals(own).select(F.col("c").alias("sc"), F.col("d").alias("sd"), "leaves", "saved")
    found = named.join(totals, _on(("c", "depth"), ("sc", "sd"))).join(_ends(steps, convs), _NODE, "left")
    return found.select(
        F.col("c").alias("conv_id"), "depth", F.col("pc").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
