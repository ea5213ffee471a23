import hashlib
import random

import pytest
from plumbline.llm.mixing import mix, taken
from pyspark.sql import functions as F

def weights():
    return {"domain": F.when(F.col("domain") == "big", 3).when(F.col("domain") == "none", 0).otherwise(1), "lang": F.when(F.col("lang") == "en", 2).otherwise(1), "source": F.lit(1)}


W = (lambda p: 3 if p[0] == "big" else 0 if p[0] == "none" else 1, lambda p: 2 if p[1] == "en" else 1, lambda p: 1)


def fill(budget, kids, cap, weight):
    """Pour, fill up what overflows, pour the rest again, until nothing overflows."""
    got, open_ = dict.fromkeys(kids, 0.0), [k for k in kids if weight(k) > 0]
    left = budget
    while open_:
        total = sum(weight(k) for k in open_)
        over = [k for k in open_ if cap[k] <= left * weight(k) / total + 1e-9]
        if not over:
            for k in open_:
                got[k] = left * weight(k) / total
            break
        for k in over:
            got[k] = cap[k]
        left -= sum(cap[k] for k in over)
        open_ = [k for k in open_ if k not in over]
    return got


def brute(rows, share, epochs, seed):
    tokens, docs = {}, {}
    for i, d, l, s, t in rows:
        leaf = (d or "", l or "", s or "")
        n = len((t or "").split())
        tokens[leaf] = tokens.get(leaf, 0) + n
        docs.setdefault(leaf, []).append((i, n))
    cap = {}
    for leaf, n in tokens.items():
        for k in (1, 2, 3):
            cap[leaf[:k]] = cap.get(leaf[:k], 0) + n * epochs
    grant = {(): share * sum(tokens.values())}
    for k in range(3):
        for parent in [p for p in list(grant) if len(p) == k]:
            kids = sorted({leaf[: k + 1] for leaf in tokens if leaf[:k] == parent})
            grant |= fill(grant[parent], kids, cap, W[k])
    out = []
    for leaf, members in docs.items():
        g = int(grant[leaf] + 1e-6)
        whole, rest = (g // tokens[leaf], g % tokens[leaf]) if tokens[leaf] else (0, 0)
        order = sorted((hashlib.md5(f"{seed}:{whole}:{'' if i is None else i}".encode()).hexdigest(), n, i) for i, n in members)
        for key, n, i in order:
            upto = sum(m for k, m, _ in order if (k, m) <= (key, n))
            out.append((i, *leaf, n, whole + (upto <= rest)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("share", "epochs", "part"), [(0.5, 1, 20000), (1.0, 3, 7), (5.0, 2, 20000), (0.0, 2, 20000)])
def test_against_brute_force(spark, share, epochs, part):
    rng = random.Random(9)
    rows = [(i, rng.choice(["big", "small", "none", "other"]), rng.choice(["en", "de", None]), rng.choice("pqrs"), " ".join(["w"] * rng.randint(0, 40))) for i in range(500)]
    rows += [(1000 + i, "big", "en", "hot", "a b c") for i in range(250)] + [(2000, "big", "en", "p", None), (2001, None, None, None, "x y"), (None, "big", "en", "p", "no id"), (2002, "big", "en", "p", "t " * 50000), (2003, "alone", "en", "z", ""), (2004, "big", "en", "p", "same id"), (2004, "big", "en", "p", "same id")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, d string, lang string, source string, text string, copies int")
    got = mix(df, F.col("d"), weights(), share, epochs, 7, part=part)
    have = sorted(((r.id, r.domain, r.lang, r.source, r.tokens, r.copies) for r in got.collect()), key=str)
    assert have == brute(rows, share, epochs, 7)
    one = {r[0]: r[5] for r in have if r[0] not in (None, 2004)}
    out = [r.doc_id for r in taken(df, got).collect()]
    assert all(out.count(i) == n for i, n in list(one.items())[:100])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, d string, lang string, source string, text string")
    assert mix(df, F.col("d"), weights(), 1.0, 2, 7).count() == 0


def test_clashing_names(spark):
    """Columns named as the operator's own temporaries stay as they are, and an id that is taken twice comes twice."""
    names = ["row", "key", "id", "copies", "col", "__id", "__copies", "__k"]
    df = spark.createDataFrame([(k, *[f"{c}{k}" for c in names]) for k in range(3)], "doc_id long, " + ", ".join(f"{c} string" for c in names))
    copies = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "id long, copies int")
    got = sorted(taken(df, copies).collect())
    assert got == sorted(tuple([k, *[f"{c}{k}" for c in names]]) for k in (0, 0, 2))
