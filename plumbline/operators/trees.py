"""Forests by their Euler tours, potentials along them, constraint graphs and unwrapped surfaces.

Depth costs nothing extra: a forest of any shape is ranked by pointer jumping, in rounds that grow with
the logarithm of its size, and components carry offsets to their root through star contraction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import wrapped
from plumbline.operators.graphs import _stars, components, maximum_forest, numbered, settled, stored
from plumbline.operators.sampling import global_rank


def rooted(forest: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(node, parent, eid, root, pot, size, a, b) of a forest's edges (eid, i, j, d), each tree hung from its smallest node.

    pot is the sum of d from the root (walking i to j adds d, j to i takes it away), size the nodes of
    the subtree, a and b the XOR of the subtree's ``marks`` (node, a, b; 0 without). Each edge is walked
    once in either direction; the tour's next arc is the one after this arc's twin around its node, so
    ranks around all nodes together give it, and sums to the end of the tour come by pointer jumping.
    """
    arcs = forest.select("eid", F.col("i").alias("s"), F.col("j").alias("t"), "d").unionByName(forest.select("eid", F.col("j").alias("s"), F.col("i").alias("t"), (-F.col("d")).alias("d")))
    arcs = stored(global_rank(arcs, ["s", "eid"], "at"))
    around = arcs.groupBy("s").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    tops = components(forest, "i", "j")
    twin = arcs.groupBy("eid").agg((F.min("at") + F.max("at")).alias("both"))
    walk = arcs.join(twin, "eid").withColumn("twin", F.col("both") - F.col("at")).drop("both")
    node = around.join(tops, around["s"] == tops["node"]).select(F.col("s").alias("n"), "first", "last", F.col("component").alias("root"))
    # the arc after this one leaves t: the next around it after the twin
    walk = walk.join(node, walk["t"] == node["n"]).withColumn("next", F.when(F.col("twin") < F.col("last"), F.col("twin") + 1).otherwise(F.col("first")))
    # the tour starts with the root's first arc and ends before it
    walk = walk.withColumn("next", F.when((F.col("t") == F.col("root")) & (F.col("next") == F.col("first")), F.lit(None)).otherwise(F.col("next"))).drop("n", "first", "last")
    if marks is None:
        walk = walk.withColumns({"a": F.lit(0).cast("long"), "b": F.lit(0).cast("long")})
    else:
        own = marks.join(around, marks["node"] == around["s"]).select(F.col("first").alias("at"), "a", "b")
        walk = walk.join(own, "at", "left").fillna(0, ["a", "b"])
    walk = stored(walk)
    sums = walk.select("at", "next", F.lit(1).cast("long").alias("n"), F.col("d").cast("long").alias("d"), "a", "b")
    while not sums.where("next IS NOT NULL").isEmpty():
        ahead = sums.select(F.col("at").alias("next"), F.col("next").alias("then"), F.col("n").alias("n2"), F.col("d").alias("d2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        met = sums.join(ahead, "next", "left")
        plus = lambda c: (F.col(c) + F.coalesce(c + "2", F.lit(0))).alias(c)
        xor = lambda c: F.col(c).bitwiseXOR(F.coalesce(c + "2", F.lit(0))).alias(c)
        sums = stored(met.select("at", F.col("then").alias("next"), plus("n"), plus("d"), xor("a"), xor("b")))
    there = walk.select("at", "twin", "s", "t", "eid", "root", F.col("d").alias("step"), F.col("a").alias("ma"), F.col("b").alias("mb")).join(sums.drop("next"), "at")
    back = there.select(F.col("at").alias("twin"), F.col("n").alias("bn"), F.col("a").alias("ba"), F.col("b").alias("bb"), F.col("ma").alias("bma"), F.col("mb").alias("bmb"))
    down = there.join(back, "twin").where("n > bn")
    # between the way down and the way back, that included, every node of the subtree is left
    inside = lambda own, mark, other, omark: F.col(own).bitwiseXOR(F.col(mark)).bitwiseXOR(F.col(other)).bitwiseXOR(F.col(omark))
    out = down.select(F.col("t").alias("node"), F.col("s").alias("parent"), "eid", "root", (F.col("step") - F.col("d")).alias("pot"), ((F.col("n") - F.col("bn") + 1) / 2).cast("long").alias("size"), inside("a", "ma", "ba", "bma").alias("a"), inside("b", "mb", "bb", "bmb").alias("b"))
    every = arcs.groupBy("s").agg(F.count("*").alias("w")).join(tops, F.col("s") == F.col("node")).groupBy("component").agg(F.count("*").alias("size"))
    zero = F.lit(0).cast("long")
    kinds = dict(out.dtypes)
    roots = every.select(F.col("component").alias("node"), F.lit(None).cast(kinds["parent"]).alias("parent"), F.lit(None).cast(kinds["eid"]).alias("eid"), F.col("component").alias("root"), zero.alias("pot"), "size", zero.alias("a"), zero.alias("b"))
    return out.unionByName(roots)


def with_shares(tree: DataFrame, sized: DataFrame) -> DataFrame:
    """``tree`` (node, root, ...) with size, the nodes of each subtree, and share, that of the whole tree. sized: (node, size)."""
    whole = tree.where("parent IS NULL").join(sized.select("node", "size"), "node").select("root", F.col("size").alias("whole"))
    return tree.join(sized.select("node", "size"), "node").join(whole, "root").withColumn("share", F.col("size") / F.col("whole")).drop("whole")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Some spanning forest (ties: the smaller eid); loops and parallel edges stay out."""
    return maximum_forest(edges, None)


def bridges(edges: DataFrame) -> DataFrame:
    """Edges whose loss disconnects. Every edge outside a spanning forest gets two 64-bit digests at both ends; the XOR over the nodes below a forest edge is that of the edges which leave the subtree: zero twice means none does. edges: eid, i, j, d."""
    forest = stored(spanning_forest(edges))
    other = edges.join(forest.select("eid"), "eid", "left_anti")
    mark = other.select(F.explode(F.array("i", "j")).alias("node"), F.xxhash64("eid", F.lit(1)).alias("a"), F.xxhash64("eid", F.lit(2)).alias("b"))
    marks = mark.groupBy("node").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    alone = rooted(forest.select("eid", "i", "j", F.lit(0).cast("long").alias("d")), marks).where("eid IS NOT NULL AND a = 0 AND b = 0")
    return edges.join(alone.select("eid"), "eid", "left_semi")


def merged_constraints(constraints: DataFrame, i: str, j: str, d: str, weight: Column | None = None) -> DataFrame:
    """(eid, i, j, d, w): parallel constraints as one edge that is worth the most supported d (ties: the smallest) and weighs what all of them do. Constraints of a node with itself stay out; eid follows (w falling, i, j), so ties of weight go to the smaller names."""
    rows = constraints.select(F.col(i).alias("i"), F.col(j).alias("j"), F.col(d).cast("long").alias("d"), (F.lit(1) if weight is None else weight).alias("w")).where("i <> j")
    flip = F.col("i") > F.col("j")
    rows = rows.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.when(flip, -F.col("d")).otherwise(F.col("d")).alias("d"), "w")
    each = rows.groupBy("i", "j", "d").agg(F.sum("w").alias("k"))
    one = each.groupBy("i", "j").agg(F.min_by("d", F.struct(-F.col("k"), F.col("d"))).alias("d"), F.sum("k").alias("w"))
    return global_rank(one.withColumn("__w", -F.col("w")), ["__w", "i", "j"], "eid").drop("__w")


def solved(constraints: DataFrame, i: str, j: str, d: str, anchor: str | None = None, rounds: int = 1000, pinned: bool = True) -> DataFrame:
    """(node, root, val, anchored): values with val[j] - val[i] = d where the constraints agree.

    They start from the potentials of the forest of greatest support; then each node moves to the value
    that most of its constraints imply (a value among the winners stays, else the smallest), the nodes of
    ``i`` and those of ``j`` taking turns, until nothing moves. One node of each component is the anchor
    and stays at 0: ``anchor`` where it is in it, else the smallest. No node may be on both sides: then
    every turn adds support, and the turns end. An anchor that the forest hangs from a wrong constraint
    never leaves it while it is ``pinned``; else it moves as the others do, and all of its component are
    shifted in the end so that it is at 0.
    """
    rows = stored(constraints.select(F.col(i).alias("i"), F.col(j).alias("j"), F.col(d).cast("long").alias("d")))
    if not rows.select(F.col("i").alias("n")).distinct().join(rows.select(F.col("j").alias("n")).distinct(), "n", "left_semi").isEmpty():
        raise ValueError("a node is on both sides of the constraints")
    rows, names = numbered(rows, ["i", "j"])
    each = stored(rows.groupBy("i", "j", "d").agg(F.count("*").alias("w")))
    # eid follows the weight, so the forest of the smallest eids is that of the greatest support
    forest = stored(maximum_forest(stored(merged_constraints(each, "i", "j", "d", F.col("w"))), None))
    tree = stored(potentials(forest, "i", "j", "d").select("node", F.col("component").alias("root"), F.col("pot").alias("val")))
    chosen = F.col("node") == F.lit(anchor)
    if names is not None:
        held = names.where(chosen).first()
        chosen = F.col("node") == F.lit(held and held.id)
    top = tree.groupBy("root").agg(F.coalesce(F.max(F.when(chosen, F.col("node"))), F.col("root")).alias("anchor"))
    shift = tree.join(top, "root")
    base = shift.where(F.col("node") == F.col("anchor")).select("root", F.col("val").alias("base"))
    now = stored(shift.join(base, "root").select("node", F.col("anchor").alias("root"), (F.col("val") - F.col("base")).alias("val"), (F.col("node") == F.col("anchor")).alias("anchored")))
    for _ in range(rounds):
        moved = 0
        for own, other, sign in (("i", "j", -1), ("j", "i", 1)):
            votes = each.join(now, each[other] == now["node"]).groupBy(F.col(own).alias("n"), (F.col("val") + sign * F.col("d")).alias("implied")).agg(F.sum("w").alias("k"))
            best = votes.groupBy("n").agg(F.max("k").alias("most"), F.min_by("implied", F.struct(-F.col("k"), F.col("implied"))).alias("least"))
            mine = votes.select("n", F.col("implied").alias("val"), "k")
            here = now.join(best, now["node"] == best["n"], "left").drop("n").join(mine.withColumnRenamed("n", "node"), ["node", "val"], "left")
            stays = (F.lit(pinned) & F.col("anchored")) | F.col("most").isNull() | (F.coalesce("k", F.lit(-1)) == F.col("most"))
            new = stored(here.select("node", "root", F.when(stays, F.col("val")).otherwise(F.col("least")).alias("val"), "anchored", (~stays & (F.col("val") != F.col("least"))).alias("moved")))
            moved += new.where("moved").count()
            now = new.drop("moved")
        if not moved:
            if not pinned:
                base = now.where("anchored").select("root", F.col("val").alias("base"))
                now = now.join(base, "root").withColumn("val", F.col("val") - F.col("base"))
            if names is not None:
                for c in ("node", "root"):
                    now = now.withColumnRenamed(c, "id").join(names.withColumnRenamed("node", c), "id").drop("id")
            return now.select("node", "root", "val", "anchored")
    raise RuntimeError(f"values still move after {rounds} rounds")


def constraint_residuals(constraints: DataFrame, i: str, j: str, d: str, values: DataFrame) -> DataFrame:
    """``constraints`` with root and residual: what val[j] - val[i] is over d. A constraint with a node that has no value has neither."""
    a = values.select(F.col("node").alias("__i"), F.col("val").alias("__vi"), "root")
    b = values.select(F.col("node").alias("__j"), F.col("val").alias("__vj"))
    met = constraints.join(a, F.col(i) == F.col("__i"), "left").join(b, F.col(j) == F.col("__j"), "left")
    return met.withColumn("residual", F.col("__vj") - F.col("__vi") - F.col(d)).drop("__i", "__j", "__vi", "__vj")


def residual_summary(residuals: DataFrame, values: DataFrame, tie: str | None = None, prefix: str = "") -> DataFrame:
    """One row: constraints with |residual| 0, 1 and 2 or more, edges that hold a disagreement, nodes, components, constraints beyond a forest, the nodes named ``prefix``... tied to the component of ``tie``, and a verdict.

    INCONSISTENT with a residual of 2 or more, CONSISTENT if there is none of 1 either and some constraint is beyond a forest, else UNVERIFIED.
    """
    r = F.abs("residual")
    e = residuals.agg(F.count("*").alias("constraints"), F.count_if(r == 0).alias("exact"), F.count_if(r == 1).alias("one"), F.count_if(r >= 2).alias("more"))
    pairs = residuals.groupBy("i", "j").agg(F.max(r).alias("most")).agg(F.count("*").alias("edges"), F.count_if(F.col("most") >= 1).alias("disagreeing_edges"))
    tied = F.lit(0).cast("long") if tie is None else F.count_if((F.col("root") == tie) & F.col("node").startswith(prefix) & (F.col("node") != tie))
    v = values.agg(F.count("*").alias("nodes"), F.count_distinct("root").alias("components"), tied.alias("tied"))
    out = e.join(pairs).join(v)
    spare = F.col("constraints") - (F.col("nodes") - F.col("components"))
    verdict = F.when(F.col("more") > 0, "INCONSISTENT").when((F.col("one") == 0) & (spare > 0), "CONSISTENT").otherwise("UNVERIFIED")
    return out.withColumn("redundant", spare).withColumn("verdict", verdict)


def accuracy_up_to_shift(values: DataFrame, truth: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, nodes, shift, agreeing, accuracy, edges, edges_right, edge_accuracy) of each component: nodes whose value is their true one plus the shift that most of the component agrees on (ties: the smallest), and edges whose two values differ as the true ones do. values: node, root, val; truth: node, true; edges: i, j. Nodes without a truth are not counted."""
    known = settled(values.join(truth, "node").select("node", "root", "val", "true", (F.col("val") - F.col("true")).alias("shift")))
    each = known.groupBy("root", "shift").agg(F.count("*").alias("n"))
    nodes = each.groupBy("root").agg(F.sum("n").alias("nodes"), F.min_by("shift", F.struct(-F.col("n"), F.col("shift"))).alias("shift"), F.max("n").alias("agreeing"))
    a = known.select(F.col("node").alias("i"), "root", F.col("shift").alias("si"))
    b = known.select(F.col("node").alias("j"), F.col("shift").alias("sj"))
    right = edges.select("i", "j").join(a, "i").join(b, "j").groupBy("root").agg(F.count("*").alias("edges"), F.count_if(F.col("si") == F.col("sj")).alias("edges_right"))
    out = nodes.join(right, "root", "left").fillna(0, ["edges", "edges_right"])
    return out.withColumn("accuracy", F.col("agreeing") / F.col("nodes")).withColumn("edge_accuracy", F.when(F.col("edges") > 0, F.col("edges_right") / F.col("edges")))


def _with_root(pairs: DataFrame, keep_own: bool, most: int) -> DataFrame:
    """pairs (u, v, d) with m, the smallest v of each u (or u itself), and dm, the d to it. Hubs, at most 512, are broadcast and their pairs dealt out."""
    low = pairs.groupBy("u").agg(F.min(F.struct("v", "d")).alias("x"), F.count("*").alias("w"))
    own = F.lit(keep_own) & (F.col("u") < F.col("x.v"))
    low = low.select("u", "w", F.when(own, F.col("u")).otherwise(F.col("x.v")).alias("m"), F.when(own, F.lit(0)).otherwise(F.col("x.d")).alias("dm"))
    cut = most // 512
    to = F.struct("m", "dm")
    heavy = low.where(F.col("w") > cut).select(F.col("u").alias("hu"), to.alias("heavy"))
    light = low.where(F.col("w") <= cut).select(F.col("u").alias("lu"), to.alias("light"), F.lit(0).alias("ls"))
    met = pairs.join(F.broadcast(heavy), pairs["u"] == heavy["hu"], "left")
    met = met.withColumn("salt", F.when(F.col("hu").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("v"), F.lit(9973))))
    met = met.join(light, (met["u"] == light["lu"]) & (met["salt"] == light["ls"]), "left")
    return met.select("u", "v", "d", F.coalesce("heavy", "light").alias("to")).select("u", "v", "d", "to.m", "to.dm")


def potentials(edges: DataFrame, i: str, j: str, d: str) -> DataFrame:
    """(node, component, pot): each node's component by its smallest node, and val[node] - val[component], where walking i to j adds d. Where edges of a component contradict each other, some of them hold (see ``contradicted``). Star contraction: rounds grow with the logarithm of the component."""
    flip = F.col(i) < F.col(j)
    now = edges.where(F.col(i) != F.col(j)).select(F.greatest(i, j).alias("u"), F.least(i, j).alias("v"), F.when(flip, F.col(d)).otherwise(-F.col(d)).cast("long").alias("d"))
    one = lambda df: stored(df.groupBy("u", "v").agg(F.min("d").alias("d")))
    now = one(now)
    while True:
        n, stars = _stars(now)
        if stars:
            roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"), F.lit(0).cast("long").alias("pot"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"), F.col("d").alias("pot")).unionByName(roots)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"), (-F.col("d")).alias("d")))
        large = one(_with_root(both, True, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("dm") - F.col("d")).alias("d")))
        met = stored(_with_root(large, False, 2 * n))
        now = one(met.select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("dm") - F.col("d")).alias("d")).unionByName(met.select("u", F.col("m").alias("v"), F.col("dm").alias("d"))).where("u > v"))


def contradicted(edges: DataFrame, i: str, j: str, d: str, found: DataFrame) -> DataFrame:
    """(component): those with a cycle that does not close, so with an edge that their potentials miss."""
    a, b = found.select(F.col("node").alias("__i"), "component", F.col("pot").alias("__a")), found.select(F.col("node").alias("__j"), F.col("pot").alias("__b"))
    met = edges.join(a, F.col(i) == F.col("__i")).join(b, F.col(j) == F.col("__j"))
    loops = edges.where((F.col(i) == F.col(j)) & (F.col(d) != 0)).join(a, F.col(i) == F.col("__i")).select("component")
    return met.where(F.col("__b") - F.col("__a") != F.col(d)).select("component").unionByName(loops).distinct()


def unwrapped_pieces(grid: DataFrame, keys: list[str], angle: str, max_step: float) -> DataFrame:
    """(keys, row, col, piece, phi, excluded): the angle (radians) of each valid cell, continuous over its 4-connected piece.

    Cells whose angle is null are holes. Rows are summed up run by run; where runs touch downwards, the
    whole turns between them are a potential over the graph of runs. A piece with a step wider than
    ``max_step`` is excluded as large_angular_step, one whose turns do not close around a loop (it
    encircles the axis) as encircles_axis; phi is null there. A piece is named by its first cell (row,
    col); phi of the first cell of its first run is its own angle.
    """
    step = wrapped(F.col(angle) - F.lag(angle).over(Window.partitionBy(*keys, "row").orderBy("col")))
    row = Window.partitionBy(*keys, "row").orderBy("col")
    cells = grid.where(F.col(angle).isNotNull()).select(*keys, "row", "col", angle)
    cells = cells.withColumn("__new", F.coalesce(F.lag("col").over(row) != F.col("col") - 1, F.lit(True))).withColumn("__step", F.when(F.col("__new"), F.lit(0.0)).otherwise(step))
    cells = cells.withColumn("__start", F.max(F.when(F.col("__new"), F.col("col"))).over(row)).withColumn("__sum", F.sum("__step").over(row))
    # within a run: the run's first angle and the steps since
    run = Window.partitionBy(*keys, "row", "__start")
    cells = cells.withColumn("__phi", F.sum(F.when(F.col("__new"), F.col(angle))).over(run) + F.col("__sum") - F.min(F.when(F.col("__new"), F.col("__sum"))).over(run))
    cells = cells.withColumn("__run", F.struct(*keys, "row", F.col("__start").alias("col")))
    cells = settled(cells.withColumn("__wide", F.abs("__step") > max_step).select(*keys, "row", "col", angle, "__run", "__phi", "__wide"))
    below = cells.select(*keys, (F.col("row") - 1).alias("row"), "col", F.col(angle).alias("__theta"), F.col("__run").alias("__under"), F.col("__phi").alias("__down"))
    down = wrapped(F.col("__theta") - F.col(angle))
    turns = F.round((down - (F.col("__down") - F.col("__phi"))) / (2 * math.pi)).cast("long")
    touch = settled(cells.join(below, [*keys, "row", "col"]).groupBy(F.col("__run").alias("i"), F.col("__under").alias("j"), turns.alias("d")).agg(F.max(F.abs(down) > max_step).alias("wide")))
    found = settled(potentials(touch, "i", "j", "d"))
    closed = contradicted(touch, "i", "j", "d", found).select(F.col("component").alias("piece"), F.lit(True).alias("around"))
    cells = cells.join(found, cells["__run"] == found["node"], "left").withColumn("piece", F.coalesce("component", "__run"))
    wide = touch.where("wide").join(found, touch["i"] == found["node"]).select(F.col("component").alias("piece")).unionByName(cells.where("__wide").select("piece")).distinct().withColumn("wide", F.lit(True))
    out = cells.join(closed, "piece", "left").join(wide, "piece", "left")
    why = F.when(F.col("wide"), "large_angular_step").when(F.col("around"), "encircles_axis")
    return out.select(*keys, "row", "col", F.struct("piece.row", "piece.col").alias("piece"), F.when(why.isNull(), F.col("__phi") + 2 * math.pi * F.coalesce("pot", F.lit(0))).alias("phi"), why.alias("excluded"))


def augmented_walks(edges: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """(length, walks): walks of 2 to ``length`` nodes from the ids of ``starts``, in the graph with every edge's reverse added; repeated edges count as often as they are there. edges: i, j; starts: id. Counts are exact decimals."""
    both = settled(edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).where("i IS NOT NULL AND j IS NOT NULL"))
    ends = starts.where("id IS NOT NULL").select(F.col("id").alias("n")).distinct().withColumn("c", F.lit(1).cast("decimal(38,0)"))
    out = None
    for k in range(2, length + 1):
        ends = settled(both.join(ends, both["i"] == ends["n"]).groupBy(F.col("j").alias("n")).agg(F.sum("c").cast("decimal(38,0)").alias("c")))
        here = ends.agg(F.lit(k).alias("length"), F.coalesce(F.sum("c"), F.lit(0)).cast("decimal(38,0)").alias("walks"))
        out = here if out is None else out.unionByName(here)
    return out


def growth_preflight(edges: DataFrame, ids: DataFrame, walks: DataFrame, warning: int, high: int) -> DataFrame:
    """One row: listed ids, edges, ids that edges name but the list lacks (missing), listed ids without an edge (isolated), the most walks of any length, and the risk: blocked with missing ids, high from ``high`` walks, warning from ``warning``, else low."""
    ends = edges.select(F.explode(F.array("i", "j")).alias("id")).where("id IS NOT NULL").distinct()
    listed = ids.select("id").where("id IS NOT NULL").distinct()
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(listed, "ids")
    for p in (n(edges, "edges"), n(ends.join(listed, "id", "left_anti"), "missing"), n(listed.join(ends, "id", "left_anti"), "isolated"), walks.agg(F.max("walks").alias("peak"))):
        out = out.join(p)
    return out.withColumn("risk", F.when(F.col("missing") > 0, "blocked").when(F.col("peak") >= high, "high").when(F.col("peak") >= warning, "warning").otherwise("low"))
