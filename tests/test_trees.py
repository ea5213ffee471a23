"""Euler tours, potentials, constraint graphs and unwrapping against loops."""

import math
import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from plumbline import catalog
from plumbline.operators import trees

DATA = "/root/testdata/sf0.001"


def hang(edges):
    """(parent, eid, root, pot, size) of each node of a forest by a queue from each tree's smallest node."""
    near = defaultdict(list)
    for e, i, j, d in edges:
        near[i].append((j, e, d))
        near[j].append((i, e, -d))
    out, size = {}, {}
    for root in sorted(near):
        if root in out:
            continue
        out[root], todo, order = (None, None, root, 0), deque([root]), [root]
        while todo:
            n = todo.popleft()
            for m, e, d in near[n]:
                if m not in out:
                    out[m] = (n, e, root, out[n][3] + d)
                    todo.append(m)
                    order.append(m)
        for n in reversed(order):
            size[n] = size.get(n, 1)
            if out[n][0] is not None:
                size[out[n][0]] = size.get(out[n][0], 1) + size[n]
    return {n: (*x, size[n]) for n, x in out.items()}


@pytest.mark.parametrize("kind", ["random", "star", "chain"])
def test_rooted_is_a_walk_from_the_root(spark, kind):
    rng = random.Random(4)
    names = list(range(2000))
    rng.shuffle(names)
    up = {"random": lambda k: rng.randrange(k), "star": lambda k: 0, "chain": lambda k: k - 1}[kind]
    edges = [(k, names[up(k)], names[k], rng.randint(-5, 5)) if k % 2 else (k, names[k], names[up(k)], rng.randint(-5, 5)) for k in range(1, 2000) if k % 700]
    got = trees.rooted(spark.createDataFrame(edges, "eid long, i long, j long, d long"))
    assert {r.node: (r.parent, r.eid, r.root, r.pot, r.size) for r in got.collect()} == hang(edges)
    shares = {r.node: r.share for r in trees.with_shares(got.drop("size"), got).collect()}
    want = hang(edges)
    assert all(shares[n] == pytest.approx(x[4] / want[x[2]][4]) for n, x in want.items())


def test_rooted_sums_marks_of_subtrees(spark):
    edges = [(1, 0, 1, 0), (2, 1, 2, 0), (3, 1, 3, 0), (4, 0, 4, 0)]
    marks = [(n, 1 << n, 1 << (n + 8)) for n in range(5)]
    got = trees.rooted(spark.createDataFrame(edges, "eid long, i long, j long, d long"), spark.createDataFrame(marks, "node long, a long, b long"))
    assert {r.node: r.a for r in got.collect() if r.parent is not None} == {1: 0b1110, 2: 0b100, 3: 0b1000, 4: 0b10000}


def test_potentials_and_contradictions(spark):
    rng = random.Random(2)
    edges = []
    for part in range(6):
        true = {part * 100 + n: rng.randint(-9, 9) for n in range(30)}
        nodes = list(true)
        for k in range(1, 30):
            for other in {rng.randrange(k), rng.randrange(k)}:
                i, j = rng.sample([nodes[k], nodes[other]], 2)
                edges.append((i, j, true[j] - true[i] + (1 if part == 3 and k == 7 else 0)))
    df = spark.createDataFrame(edges + [(500, 500, 0), (0, 0, 0)], "i long, j long, d long")
    found = trees.potentials(df, "i", "j", "d")
    got = {r.node: (r.component, r.pot) for r in found.collect()}
    assert {c for c, _ in got.values()} == {0, 100, 200, 300, 400, 500}
    assert {r.component for r in trees.contradicted(df, "i", "j", "d", found).collect()} <= {300}
    assert all(got[j][1] - got[i][1] == d for i, j, d in edges if i // 100 != 3)


def solve(rows, anchor):
    """The same turns by loops."""
    pairs = defaultdict(Counter)
    for i, j, d in rows:
        pairs[i, j][d] += 1
    label = {n: n for p in pairs for n in p}

    def top(n):
        while label[n] != n:
            n = label[n]
        return n

    tree = []
    for (i, j), c in sorted(pairs.items(), key=lambda x: (-sum(x[1].values()), min(x[0]), max(x[0]))):
        if top(i) != top(j):
            label[max(top(i), top(j))] = min(top(i), top(j))
            low, high = min(i, j), max(i, j)
            best = min(((-k, d if i < j else -d) for d, k in c.items()))[1]
            tree.append((len(tree), low, high, best))
    hung = hang(tree)
    members = defaultdict(list)
    for n, x in hung.items():
        members[x[2]].append(n)
    val, fixed = {}, set()
    for root, own in members.items():
        a = anchor if anchor in own else root
        fixed.add(a)
        val.update({n: hung[n][3] - hung[a][3] for n in own})
    while True:
        moved = False
        for side in (0, 1):
            new = dict(val)
            for n in val:
                votes = Counter()
                for p, c in pairs.items():
                    if p[side] == n:
                        for d, k in c.items():
                            votes[val[p[1 - side]] + (d if side else -d)] += k
                if votes and n not in fixed:
                    most = max(votes.values())
                    if votes[val[n]] != most:
                        new[n] = min(x for x, k in votes.items() if k == most)
            moved |= new != val
            val = new
        if not moved:
            return val


@pytest.mark.parametrize("seed", [1, 2])
def test_solved(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(160):
        i, j = rng.randrange(14), rng.randrange(9)
        rows.append((f"n{i}", f"f{j}" if i % 2 == j % 2 else f"f{j + 20}", i - j + rng.choice([0, 0, 0, 1, 4])))
    df = spark.createDataFrame(rows, "i string, j string, d long")
    got = trees.solved(df, "i", "j", "d", anchor="f3")
    assert {r.node: r.val for r in got.collect()} == solve(rows, "f3")
    assert {r.node: r.val for r in got.where("anchored").collect()}["f3"] == 0
    with pytest.raises(ValueError):
        trees.solved(spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "i string, j string, d long"), "i", "j", "d")


def test_verdicts(spark):
    def verdict(rows):
        df = spark.createDataFrame(rows, "i string, j string, d long")
        v = trees.solved(df, "i", "j", "d", anchor="absolute")
        return trees.residual_summary(trees.constraint_residuals(df, "i", "j", "d", v), v, tie="absolute", prefix="relative:").first()

    good = [("n1", "absolute", 1), ("n2", "absolute", 2), ("n1", "relative:b", 4), ("n2", "relative:b", 5)]
    assert (verdict(good).verdict, verdict(good).tied, verdict(good).redundant) == ("CONSISTENT", 1, 1)
    assert verdict([*good, ("n2", "relative:b", 9)]).verdict == "INCONSISTENT"
    assert verdict(good[:3]).verdict == "UNVERIFIED"


def unwrap(cells, limit):
    """phi and reason of each cell by flood filling; (r, c) -> angle."""
    turn = lambda a: (a + math.pi) % (2 * math.pi) - math.pi
    out, left = {}, set(cells)
    while left:
        first = min(left)
        phi, todo, why = {first: cells[first]}, deque([first]), set()
        while todo:
            r, c = todo.popleft()
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in cells:
                    step = turn(cells[n] - cells[r, c])
                    if abs(step) > limit:
                        why.add("large_angular_step")
                    if n not in phi:
                        phi[n] = phi[r, c] + step
                        todo.append(n)
                    elif abs(phi[n] - phi[r, c] - step) > 1:
                        why.add("encircles_axis")
        reason = max(why) if why else None  # a wide step counts first
        for n, x in phi.items():
            out[n] = (first, None if reason else x, reason)
        left -= set(phi)
    return out


def test_unwrap_query_is_as_flood_filling(spark):
    got = catalog.queries()["g12_unwrapped_pieces"](spark, DATA).collect()
    # a piece's angles are fixed up to whole turns
    seen, reasons = defaultdict(dict), Counter()
    for r in got:
        seen[r.surface, r.band, r.side][r.row, r.col] = r

    def angle(row, col):
        return math.atan2(row % 15 - 7, col - 74.5) if col >= 50 else math.atan2(math.sin(col * 0.17 + row * 0.05), math.cos(col * 0.17 + row * 0.05))

    for cells in seen.values():
        want = unwrap({k: angle(*k) for k in cells}, 1.0)
        for k, r in cells.items():
            first, phi, why = want[k]
            reasons[r.excluded] += 1
            assert (r.piece_row, r.piece_col) == first and r.excluded == why
            if phi is not None:
                base = cells[first]
                assert abs((r.phi - base.phi) - (phi - want[first][1])) < 1e-6
                assert abs(math.remainder(r.phi - angle(*k), 2 * math.pi)) < 1e-6
    assert reasons["encircles_axis"] and reasons[None]


def test_unwrap_across_the_branch_cut_around_a_hole_and_over_wide_steps(spark):
    strip = [("strip", 0, c, math.remainder(0.6 * 2 * math.pi + c * 2 * math.pi / 50, 2 * math.pi)) for c in range(51)]
    sheet = [("sheet", r, c, math.atan2(r - 10, c - 10)) for r in range(21) for c in range(21) if math.hypot(r - 10, c - 10) >= 3]
    half = [("half", *x[1:]) for x in sheet if x[1] > 10]
    wide = [("wide", 0, c, 2.0 * c) for c in range(3)]
    df = spark.createDataFrame(strip + sheet + half + wide + [("strip", 3, 3, None)], "s string, row int, col int, a double")
    got = defaultdict(list)
    for r in trees.unwrapped_pieces(df, ["s"], "a", 1.0).orderBy("s", "row", "col").collect():
        got[r.s].append(r)
    phi = [r.phi for r in got["strip"]]
    assert len(phi) == 51 and all(b > a for a, b in zip(phi, phi[1:], strict=False)) and abs(phi[-1] - phi[0] - 2 * math.pi) < 1e-9
    assert {r.excluded for r in got["sheet"]} == {"encircles_axis"} and {r.phi for r in got["sheet"]} == {None}
    assert {r.excluded for r in got["half"]} == {None} and {r.excluded for r in got["wide"]} == {"large_angular_step"}


def test_walks_and_preflight(spark):
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (4, 4)], "i long, j long")
    ids = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 9)], "id long")
    near = defaultdict(list)
    for i, j in ((1, 2), (1, 2), (2, 3), (4, 4)):
        near[i].append(j)
        near[j].append(i)
    now, want = Counter({k: 1 for k in (1, 2, 3, 4, 9)}), {}
    for k in (2, 3, 4):
        nxt = Counter()
        for n, c in now.items():
            for m in near[n]:
                nxt[m] += c
        now, want[k] = nxt, sum(nxt.values())
    walks = trees.augmented_walks(e, ids, 4)
    assert {r.length: int(r.walks) for r in walks.collect()} == want
    r = trees.growth_preflight(e, ids, walks, 10, 1000).first()
    assert (r.ids, r.edges, r.missing, r.isolated, r.risk) == (5, 4, 0, 1, "warning")
    assert trees.growth_preflight(e, ids.where(F.col("id") != 3), walks, 10, 1000).first().risk == "blocked"
