"""The closure of a tree as a table: unfolded from an order of the nodes, kept up by changes.

A closure has a row (ancestor_id, descendant_id, depth) for each pair on one path, and each node with itself at depth 0.
A flat tree's pairs are written: one join for each doubling of the depth puts rows of up to 2**k levels on top of the
ancestors that are exactly 2**k levels up. So are those of nodes that have several parents, at any depth.

A deep tree has far more pairs than nodes - a chain of n has n * (n + 1) / 2 -, so its pairs are neither shuffled nor stored.
The nodes are numbered so that all that is below a node has the numbers right after its own. A node's number, its size (nodes
below it and itself) and its level then tell all its pairs: nodes are filed in blocks of neighbouring numbers, a node is
sent once to each block that its numbers reach, and is unfolded there to a row for each descendant. Blocks are the larger the
more pairs there are, so that a node is sent to few of them on average.

Levels, sizes and numbers come from jumps that double: in each round every node meets the one that its jump ends at, and the
round's table takes the place of the one before. Siblings are added up over ranges of (parent, id), so neither a node's
children nor the roots meet in one task.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.lineage import release, replaced, shuffles_dropped, written

COLUMNS = ("ancestor_id", "descendant_id", "depth")

#: Levels from which a tree's pairs are no longer written.
FLAT = 8

#: Nodes of a block, blocks that a node is sent to on average while blocks can grow, pairs that a task unfolds, and the bits of a row's place in its range.
BLOCK, MEETINGS, TASK_PAIRS, PART_BITS = (1 << 10, 1 << 14), 4, 20_000_000, 33


class NotATree(ValueError):
    """Parents that form a circle, or that aren't there."""


def _longer(paths: DataFrame, jumps: DataFrame, step: int) -> DataFrame:
    """Paths of step + 1 to 2 * step levels: those of 1 to step levels above the nodes that jumps reach."""
    below = jumps.select(F.col("ancestor_id").alias("middle"), F.col("descendant_id").alias("below"))
    joined = paths.filter("depth > 0").withColumnRenamed("descendant_id", "middle").join(below, "middle")
    return joined.select("ancestor_id", F.col("below").alias("descendant_id"), (F.col("depth") + step).alias("depth"))


def _paths(given: DataFrame, owner: str, levels: int | None = None) -> DataFrame | None:
    """The closure of given (id, up) with each round's pairs written. levels: None comes back if there are so many or more; without, ids may stand in several rows, and a pair has a row for each path."""
    edges = given.filter("up IS NOT NULL").select(F.col("up").alias("ancestor_id"), F.col("id").alias("descendant_id"), F.lit(1).alias("depth"))
    parts, step, longest = [edges], 1, None if levels else edges.count()
    while not (jumps := parts[-1].filter(F.col("depth") == step)).isEmpty():
        if levels and step >= levels:
            release(given.sparkSession, owner)
            return None
        if longest is not None and step > longest:
            raise NotATree("parents form a circle")
        parts.append(written(_longer(reduce(DataFrame.union, parts), jumps, step), owner))
        step *= 2
    ids, pairs = given.select(F.col("id").alias("descendant_id")), reduce(DataFrame.union, parts)
    if not levels:  # each of an id's rows is at the foot of all paths to it
        pairs = pairs.join(ids, "descendant_id").select(*COLUMNS)
    return ids.select(F.col("descendant_id").alias("ancestor_id"), "descendant_id", F.lit(0).alias("depth")).union(pairs)


def _further(jumps: DataFrame, total: str) -> DataFrame:
    """jumps (id, up, ...) twice as far; total, a sum over the nodes that a jump passes, takes in those that the next one passes. Rows without up are done."""
    far = jumps.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col(total).alias("more"))
    going = jumps.filter("up IS NOT NULL").join(far, "up").withColumn(total, F.col(total) + F.col("more"))
    return jumps.filter("up IS NULL").union(going.select(*[F.col("further" if c == "up" else c).alias(c) for c in jumps.columns]))


def _measured(edges: DataFrame, owner: str) -> tuple[DataFrame, int]:
    """edges (id, up) as id, level (nodes above) and size (nodes below and itself), and the rounds this took."""
    nodes, rounds = edges.count(), 0
    state = written(edges.select("id", "up", F.col("up").isNotNull().cast("int").alias("level"), F.lit(1).cast("long").alias("size")), owner)
    while not (jumping := state.filter("up IS NOT NULL")).isEmpty():
        if 1 << rounds > nodes:
            raise NotATree("parents form a circle")
        # A node has counted what is less than a jump below it; those that jump to it have counted the next jump's worth.
        added = jumping.groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("added"))
        counted = _further(state, "level").join(added, "id", "left").withColumn("size", F.col("size") + F.coalesce("added", F.lit(0))).drop("added")
        state, rounds = replaced(counted, owner), rounds + 1
    return state.select("id", "level", "size"), rounds


def _numbered(edges: DataFrame, sizes: DataFrame, rounds: int, owner: str) -> DataFrame:
    """id and number: a node's comes right before those of all below it. sizes: id, size; rounds: those that jumps take to the roots."""
    dealt = edges.join(sizes, "id").select("id", "up", "size").repartitionByRange("up", "id").sortWithinPartitions("up", "id")
    laid = written(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftrightunsigned("at", PART_BITS)), f"{owner} laid")
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = laid.groupBy("part").agg(F.sum("size").alias("size"))  # a row a range
    starts = parts.select("part", before(Window.orderBy("part")).alias("start"))
    summed = laid.withColumn("sum", before(Window.partitionBy("part").orderBy("at"))).join(F.broadcast(starts), "part").select("id", "up", (F.col("start") + F.col("sum")).alias("sum"))
    children = summed.filter("up IS NOT NULL")
    eldest = children.groupBy("up").agg(F.min("sum").alias("least"))
    # How far a child's number is from its parent's; roots come first, so theirs is the sum itself.
    steps = children.join(eldest, "up").select("id", "up", (F.col("sum") - F.col("least") + 1).alias("number"))
    state = written(summed.filter("up IS NULL").select("id", "up", F.col("sum").alias("number")).union(steps), owner)
    release(edges.sparkSession, f"{owner} laid")
    for _ in range(rounds):
        state = replaced(_further(state, "number"), owner)
    return state.select("id", "number")


def _unfolded(placed: DataFrame, owner: str) -> DataFrame:
    """The pairs of placed: id, number, size, level, and own, whether a node has a row with itself."""
    nodes, levels = placed.agg(F.count("*"), F.coalesce(F.sum("level"), F.lit(0))).first()
    width = min(max(BLOCK[0], levels // (MEETINGS * max(1, nodes))), BLOCK[1])
    inside = F.sort_array(F.collect_list(F.struct("number", "id", "level")))
    blocks = written(placed.groupBy(F.expr(f"number DIV {width}").alias("block")).agg(inside.alias("inside")), owner)
    reach = placed.select("id", "level", (F.col("number") + (~F.col("own")).cast("int")).alias("first"), (F.col("number") + F.col("size") - 1).alias("last"))
    sent = reach.withColumn("block", F.explode(F.expr(f"sequence(first DIV {width}, last DIV {width})")))
    start = F.greatest(F.col("first") - F.col("block") * width, F.lit(0))
    end = F.least(F.col("last") - F.col("block") * width, F.lit(width - 1))
    sent = sent.select("block", "id", "level", (start + 1).cast("int").alias("start"), (end - start + 1).cast("int").alias("length"))
    tasks = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), (nodes + levels) // TASK_PAIRS)
    met = sent.repartition(max(1, min(tasks, -(-nodes // width))), "block").join(blocks, "block")
    rows = met.select(F.col("id").alias("ancestor_id"), "level", F.explode(F.slice("inside", F.col("start"), F.col("length"))).alias("below"))
    return rows.select("ancestor_id", F.col("below.id").alias("descendant_id"), (F.col("below.level") - F.col("level")).alias("depth"))


def _ordered(known: DataFrame, owner: str) -> DataFrame:
    """The closure of a forest (id, up), unfolded from an order of its nodes."""
    kind = dict(known.dtypes)["id"]
    absent = known.filter("up IS NOT NULL").select(F.col("up").alias("id")).distinct().join(known.select("id"), "id", "left_anti")
    edges = written(known.select("id", "up", F.lit(True).alias("own")).union(absent.select("id", F.lit(None).cast(kind), F.lit(False))), f"{owner} given")
    measured, rounds = _measured(edges.select("id", "up"), f"{owner} measured")
    numbers = _numbered(edges.select("id", "up"), measured.select("id", "size"), rounds, f"{owner} numbered")
    return _unfolded(written(edges.select("id", "own").join(measured, "id").join(numbers, "id"), owner), owner)


def closure(nodes: DataFrame) -> DataFrame:
    """SET-10: the closure of a forest (id, parent_id). A parent that is no node itself is an ancestor without a row of its own.

    A circle raises NotATree, after as many rounds as a path of all nodes would take. Where an id stands in several rows,
    each with a parent of its own, a pair has a row for each path. A null id has a row with itself alone.
    """
    spark, owner, kind = nodes.sparkSession, f"closure {uuid.uuid4().hex}", dict(nodes.dtypes)["id"]
    with shuffles_dropped(spark):
        try:
            given = written(nodes.select("id", F.col("parent_id").cast(kind).alias("up")), f"{owner} given")
            known, null = given.filter("id IS NOT NULL"), F.col("id").isNull()
            unknown, most = given.groupBy("id").count().agg(F.coalesce(F.sum(F.when(null, F.col("count"))), F.lit(0)), F.max(F.when(~null, F.col("count")))).first()
            out = _paths(known, owner, None if most and most > 1 else FLAT)
            if out is None:
                out = _ordered(known, owner)
                release(spark, f"{owner} given")
        except Exception:
            for table in ("", " given"):
                release(spark, owner + table)
            raise
        finally:
            for interim in (" measured", " numbered", " numbered laid"):
                release(spark, owner + interim)
    alone = spark.range(unknown).select(*[F.lit(None).cast(k).alias(c) for c, k in zip(COLUMNS, (kind, kind, "int"), strict=True)])
    return out.union(alone.withColumn("depth", F.lit(0))) if unknown else out


def inserted(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """SET-11: tree with new nodes (id, parent_id) - leaves or whole subtrees, below nodes of the tree or beside them.

    Only the new nodes' own closure is built; where it ends at a node of the tree, that node's ancestors are put on top.
    """
    new = written(closure(nodes))
    tops = new.filter("depth > 0").join(nodes.select(F.col("id").alias("ancestor_id")), "ancestor_id", "left_anti")
    known = tree.filter("depth = 0").select("ancestor_id")
    if not tops.join(known, "ancestor_id", "left_anti").isEmpty():
        raise NotATree("a parent is not there")
    above = tree.filter("depth > 0").select(F.col("ancestor_id").alias("up"), F.col("descendant_id").alias("ancestor_id"), F.col("depth").alias("more"))
    longer = tops.join(above, "ancestor_id").select(F.col("up").alias("ancestor_id"), "descendant_id", (F.col("depth") + F.col("more")).alias("depth"))
    return reduce(DataFrame.union, [tree.select(*COLUMNS), new.select(*COLUMNS), longer])


def below(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """id of all nodes at or below the roots (id)."""
    return tree.join(roots.select(F.col("id").alias("ancestor_id")), "ancestor_id", "left_semi").select(F.col("descendant_id").alias("id")).distinct()


def deleted(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """SET-12: tree without the roots (id) and all below them."""
    gone = below(tree, roots).select(F.col("id").alias("descendant_id"))
    return tree.join(gone, "descendant_id", "left_anti").select(*COLUMNS)


def moved(tree: DataFrame, moves: DataFrame) -> DataFrame:
    """SET-11/12: tree with each node of moves (id, parent_id) under its new parent, null for none, and all below it with it.

    The moved subtrees are taken out and put in again as new ones, so moves may go into each other's subtrees; a node
    moved below itself raises NotATree.
    """
    gone = below(tree, moves)
    edges = tree.filter("depth = 1").select(F.col("descendant_id").alias("id"), F.col("ancestor_id").alias("old"))
    target = moves.select("id", F.col("parent_id").alias("new"), F.lit(True).alias("moves"))
    nodes = gone.join(edges, "id", "left").join(target, "id", "left").select("id", F.when(F.col("moves"), F.col("new")).otherwise(F.col("old")).alias("parent_id"))
    return inserted(written(deleted(tree, moves)), written(nodes))
