"""Parent-child rows of unknown depth to full hierarchies.

Bottom-up: in each round the nodes without unfinished children are peeled and send their subtree
sizes and heights to their parents; nodes that are never peeled lie on cycles. Top-down: in
reverse peel order each node takes its parent's path and adds its own name. A tree of up to
TREE_ROWS nodes, by count, is peeled whole in one task. A larger one is peeled in rounds over the
cluster, where a round's join holds only the nodes peeled in it and those peeled later, which get few
towards the roots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from auditloom.session import materialise, ship

#: Nodes of a tree that one task peels; larger trees are peeled in rounds.
TREE_ROWS = 200_000
#: Most rounds that run as one job. The first rounds, which hold most nodes, run in jobs of 1, 2 and 4 when
#: peeling and one by one when paths are assigned, so few rows are carried along.
ROUNDS_PER_JOB = 8
SINGLE_ROUNDS = 4
CYCLE = "(cycle)"
_NODE = ["tree", "name", "parent", "pending", "size", "height", "round"]


def latest_definitions(rows: DataFrame) -> DataFrame:
    """``(tree, name, parent)``: of several rows of a type the one loaded last, then of the highest row id.

    ``parent`` is trimmed of white space; empty is null. Rows without registry or name yield nothing.
    """
    return (
        rows.where(F.col("registry").isNotNull() & F.col("name").isNotNull())
        .groupBy(F.col("registry").alias("tree"), F.col("name"))
        .agg(F.max(F.struct(F.col("loaded_at"), F.col("row_id"), F.col("parent"))).alias("m"))
        .select("tree", "name", F.regexp_replace(F.col("m.parent"), r"^[\s ]+|[\s ]+$", "").alias("parent"))
        .withColumn("parent", F.when(F.col("parent") != "", F.col("parent")))
    )


def _linked(defs: DataFrame) -> DataFrame:
    """Nodes with the number of their children; a parent that no row defines becomes null.

    Each child sends one row to its parent's key and one to its own, so a parent with very many
    children is counted before the shuffle.
    """
    counts = defs.where(F.col("parent").isNotNull()).groupBy("tree", F.col("parent").alias("name")).agg(F.count("*").alias("pending"))
    nodes = defs.join(counts, ["tree", "name"], "left").withColumn("pending", F.coalesce("pending", F.lit(0)).cast("long"))
    known = defs.join(counts, ["tree", "name"], "left_semi").select("tree", F.col("name").alias("parent"), F.lit(True).alias("_known"))
    return nodes.join(known, ["tree", "parent"], "left").select(
        "tree",
        "name",
        F.when(F.col("_known"), F.col("parent")).alias("parent"),
        "pending",
        F.lit(1).cast("long").alias("size"),
        F.lit(0).alias("height"),
        F.lit(None).cast("int").alias("round"),
    )


def _peel_once(nodes: DataFrame, r: int) -> DataFrame:
    """One round in one shuffle: nodes and the messages of the nodes peeled now meet by key."""
    now = F.col("round").isNull() & (F.col("pending") == 0)
    own = F.struct(
        F.col("name").alias("name"),
        F.col("parent").alias("parent"),
        F.lit(True).alias("node"),
        F.col("pending").alias("pending"),
        F.col("size").alias("size"),
        F.col("height").alias("height"),
        F.when(now, F.lit(r)).otherwise(F.col("round")).alias("round"),
    )
    sent = F.struct(
        F.col("parent").alias("name"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast("boolean").alias("node"),
        F.lit(-1).cast("long").alias("pending"),
        F.col("size").alias("size"),
        (F.col("height") + 1).alias("height"),
        F.lit(None).cast("int").alias("round"),
    )
    rows = nodes.select("tree", F.explode(F.when(now & F.col("parent").isNotNull(), F.array(own, sent)).otherwise(F.array(own))).alias("m"))
    return (
        rows.select("tree", "m.*")
        .groupBy("tree", "name")
        .agg(
            F.max("parent").alias("parent"),
            F.max("node").alias("node"),
            F.sum("pending").alias("pending"),
            F.sum("size").alias("size"),
            F.max("height").alias("height"),
            F.max("round").alias("round"),
        )
        .where("node")
        .select(*_NODE)
    )


def peel(defs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``(peeled nodes with their round, nodes on cycles, number of rounds)``."""
    live, done, r, steps = _linked(defs), [], 0, 1
    while True:
        step = live
        for i in range(steps):
            step = _peel_once(step, r + i)
        r += steps
        seen = Observation()  # counted while written
        state = materialise(step.observe(seen, F.count("round").alias("done"), F.count(F.lit(1)).alias("all")))
        part = state.where(F.col("round").isNotNull())
        rest = state.where(F.col("round").isNull())
        done.append(part)
        if seen.get["done"] in (0, seen.get["all"]):
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return out, rest, r
        live, steps = rest, min(2 * steps, ROUNDS_PER_JOB)


def _blocks(rounds: list[int]) -> list[list[int]]:
    """Rounds, descending, in the groups that one job handles."""
    out: list[list[int]] = []
    for r in rounds:
        if out and r >= SINGLE_ROUNDS and len(out[-1]) < ROUNDS_PER_JOB:
            out[-1].append(r)
        else:
            out.append([r])
    return out


_ROW = "tree string, name string, parent string, status string, root string, depth int, path string, names array<string>, size long, height int"


def _peel_tree(key, part):
    """All of one tree in a task: leaves are peeled and send sizes and heights up, reverse peel order assigns paths."""
    import pyarrow as pa

    names = part["name"].to_pylist()
    at = {n: i for i, n in enumerate(names)}
    up = [at.get(p) if p is not None else None for p in part["parent"].to_pylist()]
    n = len(names)
    pending, size, height = [0] * n, [1] * n, [0] * n
    for p in up:
        if p is not None:
            pending[p] += 1
    order = [i for i in range(n) if not pending[i]]
    for i in order:  # grows while leaves are peeled
        p = up[i]
        if p is not None:
            size[p] += size[i]
            height[p] = max(height[p], height[i] + 1)
            pending[p] -= 1
            if not pending[p]:
                order.append(p)
    paths: list[list[str] | None] = [None] * n
    status = ["cycle"] * n
    for i in reversed(order):
        above = paths[up[i]] if up[i] is not None else []
        status[i] = "below_cycle" if above is None else "tree"
        if above is not None:
            paths[i] = [*above, names[i]]
    cols = [
        [key[0].as_py()] * n, names, [names[p] if p is not None else None for p in up], status, [p[0] if p else None for p in paths], [len(p) if p else None for p in paths],
        ["/".join(p) if p else CYCLE for p in paths], paths, size, height,
    ]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int32()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=[c.split()[0] for c in _ROW.split(", ")])


def hierarchy(rows: DataFrame) -> DataFrame:
    """``(tree, name, parent, status, root, depth, path, names, size, height)``, one row per node.

    ``status`` is ``tree``, ``cycle`` (on a cycle) or ``below_cycle``; the latter two have the path
    ``(cycle)`` and no root, depth or names. A root has depth 1. ``size`` counts the node
    and its descendants, for nodes on cycles only those already peeled below them. An empty input
    gives an empty result.
    """
    defs = materialise(latest_definitions(rows))
    large = materialise(defs.groupBy("tree").agg(F.count("*").alias("n")).where(F.col("n") > TREE_ROWS).select("tree"))
    ship(defs.sparkSession)
    some = not large.isEmpty()
    own = defs.join(large, "tree", "left_anti") if some else defs
    out = own.groupBy("tree").applyInArrow(_peel_tree, _ROW)
    return out.unionByName(_in_rounds(defs.join(large, "tree", "left_semi"))) if some else out


def _in_rounds(defs: DataFrame) -> DataFrame:
    """The hierarchy of trees too large for one task."""
    nodes, cyclic, _ = peel(defs)
    peeled = materialise(nodes, partition_by="round")
    rounds = sorted((x[0] for x in peeled.select("round").distinct().collect()), reverse=True)  # one small number a round
    carried = ["tree", "name", "parent", "size", "height"]
    root_rows = peeled.where(F.col("parent").isNull()).select(*carried, F.array("name").alias("names"))
    done: list[DataFrame] = []
    for block in _blocks(rounds):
        now = peeled.where(F.col("round").isin(*block) & F.col("parent").isNotNull())
        # climb within the block to the first node above it; the names passed on the way are kept
        climbed = now.select(*carried, F.col("parent").alias("up"), F.array("name").alias("below"))
        for _ in block[1:]:
            step = now.select("tree", F.col("name").alias("up"), F.col("parent").alias("_next"))
            climbed = climbed.join(step, ["tree", "up"], "left").select(
                *carried, F.coalesce("_next", "up").alias("up"), F.when(F.col("_next").isNotNull(), F.array_prepend("below", F.col("up"))).otherwise(F.col("below")).alias("below")
            )
        above = root_rows.where("height > 0").select("tree", F.col("name").alias("up"), F.col("names").alias("_names"))
        for d in done:
            above = above.unionByName(d.select("tree", F.col("name").alias("up"), F.col("names").alias("_names")))
        done.append(materialise(climbed.join(above, ["tree", "up"]).select(*carried, F.concat("_names", "below").alias("names"))))
    paths = root_rows
    for d in done:
        paths = paths.unionByName(d)
    ok = paths.select(
        "tree", "name", "parent", F.lit("tree").alias("status"), F.col("names")[0].alias("root"), F.size("names").alias("depth"),
        F.array_join("names", "/").alias("path"), "names", "size", "height",
    )
    lost = (
        peeled.where(F.col("parent").isNotNull())
        .join(paths.select("tree", "name"), ["tree", "name"], "left_anti")
        .select(*carried, F.lit("below_cycle").alias("status"))
        .unionByName(cyclic.select(*carried, F.lit("cycle").alias("status")))
    )
    bad = lost.select(
        "tree", "name", "parent", "status", F.lit(None).cast("string").alias("root"), F.lit(None).cast("int").alias("depth"),
        F.lit(CYCLE).alias("path"), F.lit(None).cast("array<string>").alias("names"), "size", "height",
    )
    return ok.unionByName(bad)


def descendants(h: DataFrame) -> DataFrame:
    """``(tree, ancestor, descendant, distance)`` for all nodes that have a path.

    Rows, not lists: a root's descendants may be a third of the table. They follow from the
    paths without a join or a shuffle.
    """
    t = h.where(F.col("names").isNotNull())
    return t.select("tree", F.col("name").alias("descendant"), F.size("names").alias("_d"), F.posexplode("names").alias("_i", "ancestor")).select(
        "tree", "ancestor", "descendant", (F.col("_d") - 1 - F.col("_i")).alias("distance")
    ).where("distance > 0")
