import hashlib
import random

import numpy as np
from plumbline.llm.parsing import KEEP, as_text, blocks, compared, edited, fingerprints, likeness, sketches, with_following


M = 2**64
A, B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def mix(x):
    x = (x ^ x >> 32) * B % M
    return (x ^ x >> 29) * A % M


def plain_level(row):
    """One level, a symbol at a time: runs become one symbol, labels are tossed, local maxima begin blocks, a block is named."""
    short = []
    for s in row:
        if short and short[-1][0] == s:
            short[-1][1] += 1
        else:
            short.append([s, 1])
    row = [mix((s + B * n) % M) if n > 1 else s for s, n in short]
    label, width = [s % 2**32 for s in row], 32
    for _ in range(4):
        tossed = [label[0] & 1]
        for before, x in zip(label, label[1:], strict=False):
            k = next((k for k in range(width) if (before ^ x) >> k & 1), width)
            tossed.append(2 * k + (x >> k & 1 if k < width else 0))
        label, width = tossed, 8
    starts = [0] + [i for i in range(2, len(row) - 1) if label[i - 1] < label[i] > label[i + 1]]
    return [mix(sum(s * pow(A, k, M) for k, s in enumerate(row[a:b])) % M) for a, b in zip(starts, [*starts[1:], len(row)], strict=True)]


def plain_sketch(text):
    row, names, level = [ord(c) + 1 for c in text], set(), 0
    while row:
        row, level = plain_level(row), level + 1
        if level >= 2 or len(row) == 1:
            names |= {s >> 32 for s in row}
        if len(row) == 1:
            break
    return sorted(names)[:KEEP]


def brute(rows):
    """rows: (id, text); what compared() gives, one document and one symbol at a time."""
    place = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest())
    rows = sorted(((i, t or "") for i, t in rows), key=place)
    known = {}

    def sketch(t):
        if t not in known:
            known[t] = plain_sketch(t)
        return known[t]

    def like(a, b):
        both = sorted({*a, *b})[:KEEP]
        return sum(x in a and x in b for x in both) / len(both) if both else 1.0

    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        out.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), "".join("%08x" % x for x in sketch(t)), "".join("%08x" % x for x in sketch(e)), like(sketch(t), sketch(e)), like(sketch(t), sketch(nxt))))
    return sorted(out)


def rows():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé😀") for _ in range(rng.randint(1, 8)))
    some = [(i * 7 % 1000, " ".join(word() for _ in range(rng.randint(0, 120)))) for i in range(150)]
    return some + [(2001, None), (2002, ""), (2003, "aaaaaaaa" * 500), (2004, "x"), (2005, "same text"), (2005, "same text"), (2005, "a text"), (None, "no id"), (None, "no id"), (None, "b" * 70), (9999, "word " * 30000)]


def test_against_one_at_a_time(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, "c") for i, t in data], "doc_id long, text string, range string")
    got = compared(df).collect()
    assert sorted((str(r.id), *r[1:]) for r in got) == brute(data)


def test_equal_and_missing_ids_are_spread(spark):
    """Rows without an id and rows of one id are dealt to ranges as any others; each row has the right one after it."""
    data = [(None, f"text {k}") for k in range(300)] + [(7, f"other {k % 250}") for k in range(300)] + [(k, "x") for k in range(20)]
    got = with_following(spark.createDataFrame(data, "doc_id long, text string")).collect()
    own = [r for r in got if not r.ahead]
    assert len(own) == len(data) and len({r.range for r in own if r.id is None}) > 2 and len({r.range for r in own if r.id == 7}) > 2
    assert len(got) - len(own) == len({r.range for r in own})
    assert sorted((str(r.id), *r[1:]) for r in compared(spark.createDataFrame(data, "doc_id long, text string")).collect()) == brute(data)


def test_one_row_and_none(spark):
    one = compared(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1
    assert compared(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nulls = compared(spark.createDataFrame([(None, None), (None, "b")], "doc_id long, text string")).collect()
    assert sorted(r.n_chars for r in nulls) == [0, 1]


def test_equal_substrings_share_phrases():
    rng = random.Random(3)
    body = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    one, two = sketches([body]), sketches(["some other start " + body + " and end"])
    assert likeness(1, one, two)[0] > 0.85
    assert edited("abcdefgh", "z") == "abcdefz"


def test_blocks_do_not_depend_on_offset():
    rng = np.random.default_rng(0)
    row = rng.integers(1, 9, 400).astype(np.uint64)
    with np.errstate(over="ignore"):
        a, _ = blocks(row, np.zeros(400, np.int64))
        b, _ = blocks(np.r_[row[:13], row[:13], row], np.zeros(426, np.int64))
    assert set(a[6:].tolist()) <= set(b.tolist())


def test_equal_texts_equal_prints(spark):
    got = fingerprints(spark.createDataFrame([(1, "a text of some words"), (2, "a text of some words"), (3, None), (4, "")], "doc_id long, text string")).collect()
    by = {r.id: r.fingerprint for r in got}
    assert by[1] == by[2] != "" and by[3] == by[4] == ""
    assert as_text(2, *sketches(["", "q"]))[0] == ""
