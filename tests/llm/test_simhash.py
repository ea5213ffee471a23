import random

import numpy as np
from plumbline.llm.simhash import GrayIndex, fingerprints, gray_rank, near_duplicates, near_edges, spanning, standing
from xxhash import xxh64_intdigest

SCHEMA = "doc_id long, text string, component long, fp string"


def brute(rows, shingle=4, radius=4):
    """rows: (id, text). Fingerprints bit by bit and components over all pairs."""
    prints = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        hs = [xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    return sorted((rows[i][0] if rows[i][0] is not None else -1, prints[i], low[group[i]]) for i in range(len(rows)))


def corpus():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    rows = []
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        rows.append((k * 3, " ".join(text)))
        for c in range(rng.choice([0, 0, 1, 4])):
            near = list(text)
            near[rng.randrange(len(near))] = "changed"
            rows.append((1000 + k * 10 + c, "\t".join(near).upper() if c == 2 else " ".join(near)))
    return rows + [(7001, ""), (7002, None), (7003, " \n "), (7004, "one two"), (7005, "one two"), (7005, "one two"), (None, "one two"), (None, "lone text of its own kind"), (7006, "x y z " * 4000)]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(a, b, 1, "clash") for a, b in rows], SCHEMA)
    got = sorted((r.id if r.id is not None else -1, r.fp % 2**64, r.component) for r in near_duplicates(df).collect())
    assert got == brute(rows)


def test_wide_radius(spark):
    rows = corpus()
    df = spark.createDataFrame([(a, b, 1, "clash") for a, b in rows], SCHEMA)
    got = sorted((r.id if r.id is not None else -1, r.fp % 2**64, r.component) for r in near_duplicates(df, shingle=5, radius=10).collect())
    assert got == brute(rows, 5, 10)


def test_standing_rows_with_clashing_names(spark):
    """Columns named as the operator's own temporaries stay as they are."""
    names = ["row", "key", "n", "k", "id", "component", "__id", "__n", "__k"]
    rows = [(1, "a b c d e f") + (5,) * 9, (1, "a b c d e f") + (6,) * 9, (2, "A b c d e f") + (7,) * 9, (3, "other words stand here too") + (8,) * 9, (None, "x") + (9,) * 9]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    got = standing(df, near_duplicates(df.where("doc_id IS NOT NULL")))
    assert got.columns == df.columns
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 3]


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_finds_every_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 50).astype(np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 50).astype(np.uint64)) for _ in range(9)]))
    group = rng.integers(0, 3, len(fps))
    order = np.lexsort((gray_rank(fps), group))
    fps, group = fps[order], group[order]
    got = {(int(a), int(b)) for i, j in GrayIndex(fps, group).links(4) for a, b in zip(i, j, strict=True)}
    apart = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if apart[a, b] and group[a] == group[b]}
    assert got == want and want


def test_large_key_in_parts(spark, monkeypatch):
    """Keys over the part size, split into pairs of parts, link the same fingerprints."""
    import plumbline.llm.simhash as m

    rng = np.random.default_rng(2)
    fps = np.unique(np.concatenate([np.full(1, 12345, np.uint64) ^ (np.uint64(1) << a.astype(np.uint64)) ^ (np.uint64(1) << b.astype(np.uint64)) for a, b in rng.integers(0, 64, (300, 2, 1))] + [rng.integers(0, 2**63, 40).astype(np.uint64)]))
    monkeypatch.setattr(m, "PART", 16)
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = near_edges(nodes).collect()
    at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    label = spanning(len(fps), iter([(np.array([at[e.a] for e in edges]), np.array([at[e.b] for e in edges]))]))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)
    assert (label == spanning(len(fps), iter([(i, j)]))).all()


def test_shingles_follow_the_contract():
    assert fingerprints(["", "  "]).tolist() == [0, 0]
    assert fingerprints(["A b\x0bC"])[0] == xxh64_intdigest(b"a b c", 42)
    assert fingerprints(["É x"])[0] == xxh64_intdigest("É x".encode(), 42)
