"""Suffix-array dedup against counting every window, and deep-shallow sorting against sorted()."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import queries, suffixes

SF = "/root/testdata/sf0.001"


def brute(texts, size):
    """(removed flags) of each text: every window counted over all texts."""
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = True
        out.append(gone)
    return out


def digest(t, gone):
    kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
    spans = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
    return len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def test_query_is_as_counting_all_windows(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, *digest(t, g)) for (i, t), g in zip(rows, brute([t for _, t in rows], 200), strict=True))
    got = sorted(tuple(r) for r in queries.op13_suffix_array_dedup(spark, SF).collect())
    assert got == want and sum(r[2] for r in got) > 0


def near_copies(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 120))) for _ in range(6)]
    texts = []
    for _ in range(60):
        w = " ".join(rnd.choice(base) for _ in range(rnd.randint(1, 3))).split(" ")
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        texts.append(" ".join(w))
    return [*texts, "a" * 900, "ab" * 300, "", "x" * 199, "y" * 200, "z" * 201, texts[0], texts[0]]


@pytest.mark.parametrize("heavy", [suffixes.HEAVY, 3])
def test_near_copies_periods_and_short_texts(spark, heavy, monkeypatch):
    texts = [*near_copies(heavy), None]
    rows = [(7 if i % 9 == 0 else (None if i % 10 == 0 else i), t, f"k{i}", 1, 2, 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, data int, d1 int, spans int").repartition(5)
    flags = brute([(t or "").encode() for t in texts], 120)
    want = {f"k{i}": digest((t or "").encode(), g) for i, (t, g) in enumerate(zip(texts, flags, strict=True))}
    out = suffixes.without_repeats(df, size=120, heavy=heavy)
    assert out.columns == ["doc_id", "text", "key", "data", "d1", "kept", "spans"]
    got = {r.key: (len((r.text or "").encode()), sum(x.end - x.start for x in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out.collect()}
    assert got == want and sum(0 < w[1] < w[0] for w in want.values()) > 10


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    rnd = random.Random(3)
    long = "".join(rnd.choice("abcdefgh") for _ in range(suffixes.CHUNK + 50_000))
    cut = suffixes.CHUNK - 300
    texts = [long, "q" * 10 + long[cut : cut + 600] + "r" * 10, long[5:150]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(x.start, x.end) for x in r.spans] for r in suffixes.without_repeats(df).collect()}
    assert got == {0: [(cut, cut + 600)], 1: [(10, 610)], 2: []}


def test_empty_table(spark):
    out = suffixes.without_repeats(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "kept", "spans"]
    assert suffixes.without_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().kept == b""


@pytest.mark.parametrize("seed", range(20))
def test_deep_shallow_is_sorted_and_knows_what_is_shared(seed):
    rnd = random.Random(seed)
    base = [bytes(rnd.choice(b"ab") for _ in range(48)) for _ in range(4)]
    rows = []
    for _ in range(rnd.randint(1, 80)):
        s = bytearray(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            s[rnd.randrange(48)] = rnd.choice(b"abc\xff\x00")
        rows.append(bytes(s))
    group = np.sort(np.random.default_rng(seed).integers(0, 3, len(rows)))
    order, common = suffixes.deep_shallow(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 48), group, 0)
    got = [(int(group[i]), rows[i]) for i in order]
    assert got == sorted(zip(group.tolist(), rows, strict=True))
    for k in range(1, len(got)):
        if got[k][0] == got[k - 1][0]:
            assert common[k] == next((i for i in range(48) if got[k][1][i] != got[k - 1][1][i]), 48)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    piece = rng.integers(97, 100, 500).astype(np.uint8)
    b = np.concatenate([rng.integers(97, 100, 777).astype(np.uint8), piece, rng.integers(97, 100, 333).astype(np.uint8), piece])
    first, last, at, h = suffixes.anchors(b, np.array([len(b)]), 200)
    before = {i: (int(p) - i, int(k)) for f, e, p, k in zip(first, last, at, h, strict=True) for i in range(f, e + 1)}
    assert len(before) == len(b) - 199
    assert all(before[777 + i] == before[777 + 500 + 333 + i] for i in range(301))
