import random
import tracemalloc

import numpy as np
from plumbline.llm import shared, simhash
from plumbline.llm.shared import near_duplicates

SCHEMA = "doc_id long, text string, component long, fp string"


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, likeness=0.8):
    """(place of the row, group) and the pairs of rows that share enough, over all pairs by their true share."""
    sets = [shingles(t) for _, t in rows]
    group, links = list(range(len(rows))), []
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (len(a & b) / len(a | b) >= likeness):
                links.append((j, i))
                if group[i] != group[j]:
                    old, new = group[i], group[j]
                    group = [new if g == old else g for g in group]
    return group, links


def corpus():
    """Copies with 0 to 12 changed words, so shares on both sides of 0.8, under one very common passage; a chain; texts at 0.8 exactly and just below."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(2000)]
    passage = [f"common{k}" for k in range(12)]
    rows = []
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(20, 250))]
        if k % 2:
            text[3:3] = passage
        rows.append((k * 20, " ".join(text)))
        for c in range(4):
            near = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 20))):
                near[rng.randrange(len(near))] = rng.choice(words)
            if c == 3:
                near = near[: len(near) - rng.randint(0, len(near) // 4)]
            rows.append((k * 20 + 1 + c, "\t".join(near).upper() if c == 2 else " ".join(near)))
    long = [f"q{k}" for k in range(104)]
    chain = [long[10 * k :] + [f"r{k}" for k in range(10 * k)] for k in range(8)]
    rows += [(5000 + k, " ".join(c)) for k, c in enumerate(chain)]
    rows += [(6000, " ".join(f"e{k}" for k in range(14))), (6001, " ".join(f"e{k}" for k in range(12))), (6002, " ".join(f"f{k}" for k in range(14))), (6003, " ".join(f"f{k}" for k in range(11)))]
    rows += [(7001, ""), (7002, None), (7003, " \n "), (7004, "one two"), (7005, "one two"), (7005, "one two"), (7005, "other"), (None, "one two"), (None, "lone text of its own kind"), (7006, "x y z " * 4000), (7007, "y z x " * 4000)]
    return rows


def test_pairs_that_share(spark, monkeypatch):
    """Nothing is linked that brute force over all pairs keeps apart, and of the pairs that truly share 0.8 at least 0.98 are in one group. Parts of 16 give the same groups as whole keys."""
    rows = [(i, t) for i, t in corpus() if i not in (None, 7005)]
    df = spark.createDataFrame([(a, b, 1, "clash") for a, b in rows], SCHEMA)
    got = {r.id: r.component for r in near_duplicates(df).collect()}
    group, links = brute(rows)
    low = {g: min(r[0] for r, h in zip(rows, group, strict=True) if h == g) for g in group}
    truth = {r[0]: low[g] for r, g in zip(rows, group, strict=True)}
    assert got.keys() == truth.keys()
    assert all(truth[i] == truth[c] for i, c in got.items())
    found = [got[rows[i][0]] == got[rows[j][0]] for i, j in links]
    assert len(found) > 150 and sum(found) / len(found) >= 0.98
    assert got[6001] == 6000 and got[6003] == 6003 and got[7007] == 7006 and got[7002] == got[7003] == 7001
    monkeypatch.setattr(simhash, "PART", 16)
    monkeypatch.setattr(shared, "SETS", 5)
    assert {r.id: r.component for r in near_duplicates(df).collect()} == got


def test_refused_pairs_stay_in_their_task(spark):
    """A large group of near-copies that hang together by chains: every link is found, and no more rows leave the tasks than there are texts under keys."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    texts = [base]
    while len(texts) < 250:
        own = list(texts[rng.randrange(len(texts))])
        for _ in range(2):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        texts.append(own)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r.id: r.component for r in near_duplicates(spark.createDataFrame([(a, b, 1, "c") for a, b in rows], SCHEMA)).collect()}
    group, links = brute(rows)
    assert all(group[i] == group[c] for i, c in got.items())
    assert sum(got[i] == got[j] for i, j in links) / len(links) >= 0.98 and len(set(got.values())) <= len(set(group)) + 2 < 100


def test_bounds_of_what_sets_share():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    most = shared._most(np.array([len(s) for s in sets]), shared._bitmaps(sets), i, j)
    assert all(m >= len(np.intersect1d(sets[a], sets[b])) for m, a, b in zip(most, i, j, strict=True))


def test_long_sets_are_dealt_by_their_size(spark, monkeypatch):
    """Few codes a part give the same groups, and bit maps take no byte for a bit."""
    rows = [(i, t) for i, t in corpus() if i not in (None, 7005)]
    df = spark.createDataFrame([(a, b, 1, "clash") for a, b in rows], SCHEMA)
    want = {r.id: r.component for r in near_duplicates(df).collect()}
    monkeypatch.setattr(shared, "CODES", 300)
    assert {r.id: r.component for r in near_duplicates(df).collect()} == want
    sets = [np.arange(k, k + 100_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in range(64)]
    tracemalloc.start()
    shared._bitmaps(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(s.nbytes for s in sets) / 8


def test_repeated_and_missing_ids(spark):
    """Rows that repeat an id and rows without one keep their rows; a null id names a group only of its own kind."""
    rows = [(None, "one two"), (7004, "one two"), (7005, "one two"), (7005, "one two"), (7005, "other"), (None, "lone text of its own kind"), (None, "lone text  of its own KIND")]
    got = near_duplicates(spark.createDataFrame([(a, b, 1, "clash") for a, b in rows], SCHEMA)).collect()
    assert sorted(((r.id, r.component) for r in got), key=str) == sorted([(None, 7004), (7004, 7004), (7005, 7004), (7005, 7004), (7005, 7005), (None, None), (None, None)], key=str)


def test_exact_at_the_threshold(spark):
    """The share decides, not its estimate: texts of n and n + 1 words on both sides of 0.8, many of them, without a single wrong link."""
    rows = []
    for k in range(40):
        for n in (4 + 4 * (k % 10), 4 + 5 * (k % 10)):  # shingles of the longer: 5/4 of the shorter, then one more
            rows += [(len(rows), " ".join(f"g{k}.{n}.{w}" for w in range(n + 4)))]
        rows += [(len(rows), " ".join(f"g{k}.{4 + 4 * (k % 10)}.{w}" for w in range((4 + 4 * (k % 10)) * 5 // 4 + 1 + 4)))]
    df = spark.createDataFrame([(a, b, 1, "clash") for a, b in rows], SCHEMA)
    got = {r.id: r.component for r in near_duplicates(df).collect()}
    group, _ = brute(rows)
    assert all(group[i] == group[c] for i, c in got.items())


def test_pipeline_stage(spark):
    """The stage keeps the smallest id of each group."""
    import corpus_pipeline

    rows = [(i, t) for i, t in corpus() if i is not None and i != 7005]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.without_near_duplicates(spark, df, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.id for r in near_duplicates(df).collect() if r.id == r.component)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
