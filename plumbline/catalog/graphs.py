"""Graphs: components, bridges, potentials, refinement, walks, closures."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.fixtures import EDGES, GRID, edges, grid, table
from plumbline.catalog.registry import query
from plumbline.catalog.voxels import _rounded
from plumbline.operators import graphs as op
from plumbline.operators import surfaces, trees

_REACH = f"WITH RECURSIVE {EDGES}, b AS (SELECT i AS s, j AS t FROM edges UNION ALL SELECT j, i FROM edges), r(n, l) AS (SELECT s, s FROM b UNION SELECT b.t, r.l FROM r JOIN b ON b.s = r.n WHERE r.l < b.t), comp AS (SELECT n AS node, min(l) AS component FROM r GROUP BY n)"


@query(f"{_REACH} SELECT node, component FROM comp")
def g01_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.components(edges(spark, sf_dir), "i", "j")


@query(f"{_REACH} SELECT (SELECT count(*) FROM edges) AS edges, count(*) AS nodes, count(DISTINCT component) AS components, (SELECT count(*) FROM edges) - count(*) + count(DISTINCT component) AS redundancy FROM comp")
def g02_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    c = op.components(e, "i", "j").agg(F.count("*").alias("nodes"), F.count_distinct("component").alias("components"))
    return e.agg(F.count("*").alias("edges")).join(c).withColumn("redundancy", F.col("edges") - F.col("nodes") + F.col("components"))


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and nations' neighbours as a sparse graph: an order links its customer to the customer of the next order of the same status, priority and day; ids are order keys."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_orderstatus", "o_orderpriority", F.to_date("o_orderdate")).orderBy("o_orderkey")
    return o.select(F.col("o_orderkey").alias("eid"), F.col("o_custkey").alias("i"), F.lead("o_custkey").over(w).alias("j"), (F.col("o_orderkey") % 5).alias("d"), F.col("o_totalprice").alias("w")).where("j IS NOT NULL AND i <> j")


@query()
def g03_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against removal of each edge on a small graph."""
    return trees.bridges(_sparse(spark, sf_dir))


@query()
def g04_bfs_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels and potentials of a breadth-first tree, with the size of each subtree and its share of the tree. Tested against a queue on a small graph."""
    tree = op.settled(op.bfs_forest(_sparse(spark, sf_dir)))
    hung = tree.where("eid IS NOT NULL").select("eid", F.col("parent").alias("i"), F.col("node").alias("j"), F.lit(0).cast("long").alias("d"))
    return trees.with_shares(tree, trees.rooted(hung))


@query()
def g05_maximum_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against Kruskal's rule on a small graph."""
    return op.maximum_forest(_sparse(spark, sf_dir), "w")


def _start(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = edges(spark, sf_dir)
    nodes = e.select(F.explode(F.array("i", "j")).alias("node")).distinct()
    return e, nodes.select("node", F.lit(0).cast("long").alias("val"))


@query()
def g06_mode_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.mode_refined(*_start(spark, sf_dir))


_TRUTH = "t AS (SELECT i, j, d, w, d - ((-(substr(j, 2)::BIGINT % 12)) - (-(substr(i, 2)::BIGINT % 12))) AS residual FROM edges)"


def _true_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e, v = _start(spark, sf_dir)
    return e, v.withColumn("val", -(F.substring("node", 2, 20).cast("long") % 12))


@query(f"WITH {EDGES}, {_TRUTH} SELECT count(*) AS edges, count(*) FILTER (residual = 0) AS exact, count(*) FILTER (abs(residual) = 1) AS one, count(*) FILTER (abs(residual) >= 2) AS more, CASE WHEN count(*) FILTER (residual <> 0) = 0 THEN 'consistent' ELSE 'contradictions' END AS verdict FROM t")
def g07_residual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.abs("residual")
    g = op.residuals(*_true_values(spark, sf_dir)).agg(F.count("*").alias("edges"), F.count_if(r == 0).alias("exact"), F.count_if(r == 1).alias("one"), F.count_if(r >= 2).alias("more"))
    return g.withColumn("verdict", F.when(F.col("exact") == F.col("edges"), "consistent").otherwise("contradictions"))


@query("WITH n AS (SELECT 's' || s_suppkey AS node, s_suppkey % 12 AS truth, (s_suppkey % 12) + 3 + (s_suppkey % 17 = 0)::INTEGER AS val FROM supplier), c AS (SELECT val - truth AS shift, count(*) AS n FROM n GROUP BY ALL) SELECT max(n) AS agreeing, sum(n)::BIGINT AS nodes, round(max(n) / sum(n), 6) AS accuracy FROM c")
def g08_accuracy_up_to_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes right up to the shift that most agree on."""
    k = F.col("s_suppkey")
    n = table(spark, sf_dir, "supplier").select(((k % 12 + 3 + F.when(k % 17 == 0, 1).otherwise(0)) - k % 12).alias("shift"))
    c = n.groupBy("shift").agg(F.count("*").alias("n"))
    return _rounded(c.agg(F.max("n").alias("agreeing"), F.sum("n").alias("nodes"), (F.max("n") / F.sum("n")).alias("accuracy")))


@query(f"""WITH {EDGES}, b AS (SELECT i, j FROM edges UNION ALL SELECT j, i FROM edges), w1 AS (SELECT j AS n, count(*)::HUGEINT AS c FROM b GROUP BY j), w2 AS (SELECT j AS n, sum(c)::HUGEINT AS c FROM w1 JOIN b ON i = n GROUP BY j), w3 AS (SELECT j AS n, sum(c)::HUGEINT AS c FROM w2 JOIN b ON i = n GROUP BY j), w4 AS (SELECT j AS n, sum(c)::HUGEINT AS c FROM w3 JOIN b ON i = n GROUP BY j)
SELECT 1 AS length, sum(c)::DECIMAL(38, 0) AS walks FROM w1 UNION ALL SELECT 2, sum(c)::DECIMAL(38, 0) FROM w2 UNION ALL SELECT 3, sum(c)::DECIMAL(38, 0) FROM w3 UNION ALL SELECT 4, sum(c)::DECIMAL(38, 0) FROM w4""")
def g09_walk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.walk_counts(edges(spark, sf_dir), 4)


@query("WITH RECURSIVE p AS (SELECT c_custkey AS c, c_custkey // 3 AS a FROM customer WHERE c_custkey > 0), r(node, ancestor, depth) AS (SELECT c, a, 1 FROM p UNION ALL SELECT r.node, p.a, r.depth + 1 FROM r JOIN p ON p.c = r.ancestor) SELECT node, ancestor, min(depth)::INTEGER AS depth FROM r GROUP BY ALL")
def g10_lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("c"), F.expr("c_custkey div 3").alias("a"))
    return op.closure(p, "c", "a")


@query()
def g11_checkable_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that something else can contradict: support of two or more, or not a bridge; with their component."""
    e = _sparse(spark, sf_dir)
    free = trees.bridges(e).select("eid").withColumn("bridge", F.lit(True))
    c = op.components(e, "i", "j").withColumnRenamed("node", "i")
    out = e.join(free, "eid", "left").join(c, "i").withColumn("bridge", F.coalesce("bridge", F.lit(False)))
    return out.select("eid", "component", "bridge", ((F.col("w") >= 400000) | ~F.col("bridge")).alias("checkable"))


@query(f"WITH {GRID}, d AS (SELECT surface, row, col, z * 0.01::DOUBLE % 1 - lag(z * 0.01::DOUBLE % 1) OVER (PARTITION BY surface, row ORDER BY col) AS d FROM grid), u AS (SELECT surface, row, d - round(d) AS w FROM d) SELECT surface, row, round(sum(w), 4)::DOUBLE AS net, count(*) FILTER (abs(w) > 0.25) AS wide FROM u GROUP BY ALL")
def g12_phase_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases unwrapped along the rows of each surface: net phase and steps too wide to trust."""
    from pyspark.sql import Window

    phase, w = (F.col("z") * 0.01) % 1, Window.partitionBy("surface", "row").orderBy("col")
    d = grid(spark, sf_dir).select("surface", "row", F.when(F.lag("col").over(w) == F.col("col") - 1, phase - F.lag(phase).over(w)).alias("d"))
    w = F.col("d") - F.round("d")
    return _rounded(d.groupBy("surface", "row").agg(F.round(F.sum(w), 4).alias("net"), F.count_if(F.abs(w) > 0.25).alias("wide")))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as readings of a constraint graph: supplier i, part j and a difference d that is off for some; several readings of one pair disagree."""
    item, s, p = table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), F.col("l_partkey")
    off = F.when(F.col("l_linenumber") == 7, 1).when(F.col("l_quantity") > 49, 3).otherwise(0)
    return item.select(F.concat(F.lit("s"), s.cast("string")).alias("i"), F.concat(F.lit("p"), p.cast("string")).alias("j"), ((p % 12) - (s % 12) + off).cast("long").alias("d"))


@query()
def g05_constraint_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a pair merged to the most supported difference, and the forest of greatest support; tested against loops."""
    return op.maximum_forest(trees.merged_constraints(_readings(spark, sf_dir), "i", "j", "d"), "w")


@query()
def g06_solved_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored values that start from the forest's potentials and move to what most readings imply; tested against loops."""
    return trees.solved(_readings(spark, sf_dir), "i", "j", "d", anchor="p1")


@query("WITH r AS (SELECT 's' || l_suppkey AS i, 'p' || l_partkey AS j, CASE WHEN l_linenumber = 7 THEN 1 WHEN l_quantity > 49 THEN 3 ELSE 0 END AS off FROM lineitem), e AS (SELECT count(*) AS constraints, count(*) FILTER (off = 0) AS exact, count(*) FILTER (off = 1) AS one, count(*) FILTER (off >= 2) AS more FROM r), p AS (SELECT count(*) AS edges, count(*) FILTER (most >= 1) AS disagreeing_edges FROM (SELECT i, j, max(off) AS most FROM r GROUP BY ALL)), n AS (SELECT unnest([i, j]) AS node FROM r), v AS (SELECT count(DISTINCT node) AS nodes, 1::BIGINT AS components, count(DISTINCT node) FILTER (node LIKE 's%') AS tied FROM n) SELECT *, constraints - (nodes - components) AS redundant, CASE WHEN more > 0 THEN 'INCONSISTENT' WHEN one = 0 AND constraints > nodes - components THEN 'CONSISTENT' ELSE 'UNVERIFIED' END AS verdict FROM e, p, v")
def g07_solved_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of what the solved values leave: the SQL knows how far each reading was put off, which the solver has to find out."""
    r = _readings(spark, sf_dir)
    values = op.settled(trees.solved(r, "i", "j", "d", anchor="p1", pinned=False))
    return trees.residual_summary(trees.constraint_residuals(r, "i", "j", "d", values), values, tie="p1", prefix="s")


@query(f"{_REACH}, t AS (SELECT 's' || s_suppkey AS node, s_suppkey % 12 AS real_value FROM supplier UNION ALL SELECT 'p' || p_partkey, p_partkey % 12 FROM part), k AS (SELECT comp.node, component AS root, length(component) + (substr(comp.node, 2)::BIGINT % 17 = 0)::INTEGER AS shift FROM comp JOIN t USING (node)), c AS (SELECT root, shift, count(*) AS n FROM k GROUP BY ALL), most AS (SELECT root, sum(n)::BIGINT AS nodes, max(n) AS agreeing FROM c GROUP BY root), s AS (SELECT root, min(shift) AS shift FROM c JOIN most USING (root) WHERE n = agreeing GROUP BY root), right_ones AS (SELECT a.root, count(*) AS edges, count(*) FILTER (a.shift = z.shift) AS edges_right FROM edges JOIN k a ON a.node = i JOIN k z ON z.node = j GROUP BY a.root) SELECT root, nodes, shift, agreeing, edges, edges_right, round(agreeing / nodes, 6) AS accuracy, round(edges_right / edges, 6) AS edge_accuracy FROM most JOIN s USING (root) JOIN right_ones USING (root)")
def g08_component_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a graph's nodes against a table of truths, each component up to its own shift: nodes and edges that are right."""
    e = edges(spark, sf_dir)
    true = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), (F.col("s_suppkey") % 12).alias("true"))
    true = true.unionByName(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), (F.col("p_partkey") % 12).alias("true")))
    wrong = F.when(F.substring("node", 2, 20).cast("long") % 17 == 0, 1).otherwise(0)
    found = op.components(e, "i", "j").join(true, "node").select("node", F.col("component").alias("root"), (F.col("true") + F.length("component") + wrong).alias("val"))
    return _rounded(trees.accuracy_up_to_shift(found, true, e))


@query("WITH e AS (SELECT o_custkey AS i, (o_orderkey % 700) + 1 AS j FROM orders WHERE o_orderpriority = '1-URGENT'), ids AS (SELECT c_custkey AS id FROM customer), b AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e), w2 AS (SELECT j AS n, count(*)::HUGEINT AS c FROM b JOIN ids ON id = i GROUP BY j), w3 AS (SELECT j AS n, sum(c)::HUGEINT AS c FROM w2 JOIN b ON i = n GROUP BY j), w4 AS (SELECT j AS n, sum(c)::HUGEINT AS c FROM w3 JOIN b ON i = n GROUP BY j), p AS (SELECT max(w)::DECIMAL(38, 0) AS peak FROM (SELECT sum(c) AS w FROM w2 UNION ALL SELECT sum(c) FROM w3 UNION ALL SELECT sum(c) FROM w4)), x AS (SELECT DISTINCT unnest([i, j]) AS id FROM e) SELECT (SELECT count(*) FROM ids) AS ids, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM x WHERE id NOT IN (SELECT id FROM ids)) AS missing, (SELECT count(*) FROM ids WHERE id NOT IN (SELECT id FROM x)) AS isolated, peak, CASE WHEN (SELECT count(*) FROM x WHERE id NOT IN (SELECT id FROM ids)) > 0 THEN 'blocked' WHEN peak >= 100000000 THEN 'high' WHEN peak >= 1000000 THEN 'warning' ELSE 'low' END AS risk FROM p")
def g09_growth_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between urgent orders' customers, both ways: ids that are missing or isolated, the most walks, and the risk of growing along them."""
    e = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("i"), (F.col("o_orderkey") % 700 + 1).alias("j"))
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return trees.growth_preflight(e, ids, trees.augmented_walks(e, ids, 4), 1_000_000, 100_000_000)


@query()
def g12_unwrapped_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The angle of each surface cell, continuous over its piece. A surface is cut into bands of 15 rows and two sides: to the left a spiral with holes, to the right a flat sheet around the axis, whose loops do not close; tested against flood filling."""
    g = grid(spark, sf_dir).where("valid OR col % 2 = 0").withColumn("band", F.expr("row div 15")).withColumn("side", (F.col("col") >= 50).cast("int"))
    down, along = F.col("row") % 15 - 7.0, F.col("col") - 74.5
    turn = F.col("col") * 0.17 + F.col("row") * 0.05
    angle = F.when(F.col("side") == 0, F.atan2(F.sin(turn), F.cos(turn))).when(F.sqrt(down * down + along * along) >= 3, F.atan2(down, along))
    out = trees.unwrapped_pieces(g.withColumn("angle", angle), ["surface", "band", "side"], "angle", 1.0)
    return out.select("surface", "band", "side", "row", "col", F.col("piece.row").alias("piece_row"), F.col("piece.col").alias("piece_col"), F.round("phi", 9).alias("phi"), "excluded")


@query(f"WITH {EDGES}, d AS (SELECT node, count(*) AS degree FROM (SELECT unnest([i, j]) AS node FROM edges) GROUP BY node), r AS (SELECT degree, row_number() OVER (ORDER BY degree, node) AS k, count(*) OVER () AS n FROM d) SELECT any_value(n) AS n, max(CASE WHEN k = greatest(1, ceil(n * 0.5::DOUBLE)) THEN degree END) AS q50, max(CASE WHEN k = greatest(1, ceil(n * 0.9::DOUBLE)) THEN degree END) AS q90 FROM r")
def a62_degree_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank picks from the histogram of degrees: ranks are summed over distinct degrees, not over nodes."""
    from pyspark.sql import Window

    h = op.degrees(edges(spark, sf_dir)).groupBy("degree").agg(F.count("*").alias("m"))
    h = h.withColumn("upto", F.sum("m").over(Window.orderBy("degree"))).withColumn("n", F.sum("m").over(Window.partitionBy(F.lit(0))))
    at = lambda q: F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("n") * q)), F.col("degree")))
    return h.agg(F.first("n").alias("n"), at(0.5).alias("q50"), at(0.9).alias("q90"))


def _grid_components(cells: DataFrame, diagonal: bool = False) -> DataFrame:
    """Cells with their component: rows collapse into runs, runs that touch downwards are edges."""
    touch, runs = surfaces.cell_edges(cells, ["surface"], 100, diagonal)
    named = op.components(touch, "run", "under")
    return runs.join(named, runs["run"] == named["node"], "left").select("surface", "row", "col", F.coalesce("component", "run").alias("label"))


@query(f"WITH RECURSIVE {GRID}, c AS (SELECT row * 100 + col AS n, row, col, surface FROM grid WHERE p >= 0.75), r(n, l) AS (SELECT n, n FROM c UNION SELECT d.n, r.l FROM r JOIN c ON c.n = r.n JOIN c d ON d.surface = c.surface AND abs(d.row - c.row) + abs(d.col - c.col) = 1 WHERE r.l < d.n), k AS (SELECT n, min(l) AS label FROM r GROUP BY n) SELECT surface, label, count(*) AS area FROM k JOIN c USING (n) GROUP BY ALL")
def a76_region_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-connected components of the cells over a threshold, with their areas (also the grid form of G01)."""
    return _grid_components(grid(spark, sf_dir).where("p >= 0.75").select("surface", "row", "col")).groupBy("surface", "label").agg(F.count("*").alias("area"))


@query()
def a48_betti_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces (b0, corners joined) and holes (b1 = b0 - V + E - F) of the cells at or above each threshold; tested against flood filling."""
    g = grid(spark, sf_dir)
    chi = surfaces.euler(g, ["surface"], "p", [0.3, 0.6, 0.9])
    out = None
    for t in (0.3, 0.6, 0.9):
        n = _grid_components(g.where(F.col("p") >= t).select("surface", "row", "col"), diagonal=True).groupBy("surface").agg(F.count_distinct("label").alias("b0")).withColumn("t", F.lit(t))
        out = n if out is None else out.unionByName(n)
    return chi.join(out, ["surface", "t"]).select("surface", "t", "euler", "b0", (F.col("b0") - F.col("euler")).alias("b1"))


@query()
def a49_threshold_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the peak of each component at the highest threshold: area and centre of the component that holds it, threshold by threshold downwards, growth and drift against the threshold above, and whether a stronger peak has taken it over; tested against flood filling."""
    from pyspark.sql import Window

    g = grid(spark, sf_dir)
    out = peaks = None
    for t in (0.75, 0.65, 0.55):
        cells = op.settled(_grid_components(g.where(F.col("p") >= t).select("surface", "row", "col")).join(g.select("surface", "row", "col", "p"), ["surface", "row", "col"]))
        top = F.max_by(F.struct("row", "col"), F.struct("p", -F.col("row"), -F.col("col")))
        parts = cells.groupBy("surface", "label").agg(F.count("*").alias("area"), F.avg("row").alias("cy"), F.avg("col").alias("cx"), top.alias("own"))
        if peaks is None:
            peaks = op.settled(parts.select("surface", F.col("own.row").alias("row"), F.col("own.col").alias("col")))
        held = cells.join(peaks, ["surface", "row", "col"]).join(parts, ["surface", "label"])
        taken = (F.col("own.row") != F.col("row")) | (F.col("own.col") != F.col("col"))
        held = held.select("surface", "row", "col", F.lit(t).alias("t"), "area", "cy", "cx", taken.alias("taken_over"))
        out = held if out is None else out.unionByName(held)
    w = Window.partitionBy("surface", "row", "col").orderBy(F.desc("t"))
    drift = F.sqrt(F.pow(F.col("cy") - F.lag("cy").over(w), 2) + F.pow(F.col("cx") - F.lag("cx").over(w), 2))
    return out.withColumns({"growth": F.col("area") / F.lag("area").over(w), "drift": drift})


@query("WITH c AS (SELECT o_custkey % 40 AS label, o_orderpriority AS side FROM orders), n AS (SELECT label, count(*) FILTER (side = '1-URGENT') AS a, count(*) FILTER (side = '2-HIGH') AS b, count(*) AS seeds FROM c GROUP BY label), e AS (SELECT *, a >= 60 AND b >= 60 AND seeds >= 0.027 * sum(seeds) OVER () AS eligible FROM n) SELECT label, a AS \"1-URGENT\", b AS \"2-HIGH\", seeds, eligible, eligible AND count(*) FILTER (eligible) OVER () = 1 AS chosen FROM e")
def t06_seeded_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("label"), F.col("o_orderpriority").alias("side"))
    return op.seeded_component(c, "label", "side", ["1-URGENT", "2-HIGH"], 60, 0.027)
