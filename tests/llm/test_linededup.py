import random

from plumbline.llm.linededup import remove_repeated_lines
from xxhash import xxh64_intdigest

SCHEMA = "doc_id long, text string, lines string, pos int, hash string"


def own(text):
    """Spark's hash of a text, which sets texts of one id in an order."""
    x = xxh64_intdigest(text.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def brute(rows):
    cut = {(i, t) for i, t in rows if i is not None and t is not None}
    first, spots = {}, []
    for i, t in sorted(cut):
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(x.strip(" \t\n\r\f\x0b") for x in w):
                at = (i, own(t), p)
                spots.append((w, t, at))
                first[w] = min(first.get(w, at), at)
    gone = {}
    for w, t, at in spots:
        if at > first[w]:
            gone.setdefault((at[0], t), set()).update(range(at[2], at[2] + 3))
    out = []
    for i, t in rows:
        if i is None or t is None or (i, t) not in gone:
            out.append((i, t, 0))
        else:
            lines = t.split("\n")
            keep = [x for p, x in enumerate(lines) if p not in gone[i, t]]
            out.append((i, "\n".join(keep), len(lines) - len(keep)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    passage = ["p%d" % i for i in range(9)]
    rows = []
    for i in range(120):
        lines = [rng.choice("abcde ") + rng.choice("xy") for _ in range(rng.randint(0, 12))]
        if i % 4 == 0:
            at = rng.randint(0, len(lines))
            lines[at:at] = passage[: rng.randint(3, 9)]
        rows.append((i, "\n".join(lines)))
    hot = "same one\nsame two\nsame three\nsame four"
    rows += [(1000 + i, hot + f"\nown {i}") for i in range(60)] + [(2000, ""), (2001, None), (None, hot), (2002, "a\nb"), (2003, "\n\n\n\n\n"), (2004, "\n\n\n\n"), (2005, "q\nq\nq\nq\nq\nq\nq"), (2006, "long line " * 20000 + "\nx\ny"), (2007, "\n".join(["l%d" % (k % 500) for k in range(5000)])), (2008, hot), (2008, hot), (2009, hot + "\nmine"), (2009, "u\nv\nw\nz"), (2009, "z\nu\nv\nw")]
    df = spark.createDataFrame([(i, t, "c", 1, "h") for i, t in rows], SCHEMA)
    got = remove_repeated_lines(df)
    assert set(got.columns) == {*df.columns, "lines_before", "lines_removed"}
    assert sorted(((r.doc_id, r.text, r.lines_removed) for r in got.collect()), key=str) == brute(rows)


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rows = [(4, "a1\nb1\nc1\nx"), (5, "a1\nb1\nc1\ny"), (5, "unique p\nunique q\nunique r\nz")]
    got = remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, r.lines_removed) for r in got) == sorted([(*rows[0], 0), (5, "y", 3), (*rows[2], 0)])


def test_empty(spark):
    assert remove_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_names(spark):
    """Columns named as the operator's own temporaries stay as they are."""
    names = ["row", "key", "id", "starts", "lines", "kept", "pos", "hash", "__id", "__starts", "__lines", "__kept"]
    text = "one line\ntwo line\nthree line\nown"
    rows = [(k, text + str(k), *[f"{c}{k}" for c in names]) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = {r.doc_id: r for r in remove_repeated_lines(df).collect()}
    assert all(got[k][c] == f"{c}{k}" for k in range(3) for c in names)
    assert got[0].text == text + "0" and got[1].text == "own1" and got[2].lines_removed == 3
