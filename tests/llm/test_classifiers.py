"""Held-out accuracy on the given tables, gradients against differences, and odd inputs."""

import zlib

import numpy as np
import pytest
from plumbline.llm import quality, queries, toxicity

#: In the toxic labels of these tables one in twenty contradicts its text.
DATA = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("query", "label", "mod", "rest"), [(queries.op5_toxicity, "toxic", 4, 2), (queries.op6_quality, "quality", 5, 0)])
def test_held_out(spark, query, label, mod, rest):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = query(spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.92


def test_gradients_match_differences():
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, win, counts = toxicity.windows(["a bad day " * 20, "some other words here", ""])
    proj, got = net.inputs(words)
    logit, state = net.forward(proj, win, keep=True)
    d = net.backward(proj, got, win, state, np.ones(len(win), np.float32))
    word, tri, _ = toxicity.word_inputs(words)
    spots = {"word": (int(word[0]), 3), "char": (int(tri[2]), 5)}
    assert net.p.keys() == d.keys()
    for k in net.p:
        at = spots.get(k, tuple(0 for _ in net.p[k].shape))
        step, old = 1e-2, net.p[k][at]
        net.p[k][at] = old + step
        up = net.forward(net.inputs(words)[0], win).sum()
        net.p[k][at] = old - step
        down = net.forward(net.inputs(words)[0], win).sum()
        net.p[k][at] = old
        assert d[k][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-3)


def test_forward_against_plain_loops():
    """One window by hand, a word, a gate and a unit at a time: both directions, attention, the logit; and the score of a text of several windows."""
    net = toxicity.Network(5)
    text = " ".join(f"w{k % 7}" for k in range(70))
    words, win, counts = toxicity.windows([text])
    p, H, D = net.p, toxicity.HIDDEN, toxicity.DIM
    word, tri, place = toxicity.word_inputs(words)
    ends = [*place[1:], len(tri)]
    sig = lambda x: 1 / (1 + np.exp(-x))

    def run(numbers, way):
        h, seen = [0.0] * H, []
        for w in numbers:
            if w:
                k = w - 1
                mean = [sum(float(p["char"][t, c]) for t in tri[place[k] : ends[k]]) / (ends[k] - place[k]) for c in range(D)]
                x = [*map(float, p["word"][word[k]]), *mean]
                g = [sum(x[i] * float(p["x"][i, way * 3 * H + c]) for i in range(2 * D)) + float(p["b"][way * 3 * H + c]) for c in range(3 * H)]
                m = [sum(h[i] * float(p["h"][way, i, c]) for i in range(H)) for c in range(3 * H)]
                h = [a + sig(g[c] + m[c]) * (np.tanh(g[2 * H + c] + sig(g[H + c] + m[H + c]) * m[2 * H + c]) - a) for c, a in enumerate(h)]
            seen.append(h)
        return seen

    logits = []
    for row in win.tolist():
        there, back = run(row, 0), run(row[::-1], 1)[::-1]
        both = [[*a, *b] for a, b in zip(there, back, strict=True)]
        weigh = [sum(np.tanh(sum(x * float(p["a"][i, c]) for i, x in enumerate(h))) * float(p["v"][c]) for c in range(toxicity.ATTEND)) for h in both]
        e = [np.exp(s) if w else 0.0 for s, w in zip(weigh, row, strict=True)]
        pooled = [sum(a * h[c] for a, h in zip(e, both, strict=True)) / sum(e) for c in range(2 * H)]
        logits.append(sum(x * float(u) for x, u in zip(pooled, p["u"], strict=True)) + float(p["c"][0]))
    assert counts.tolist() == [3]
    assert np.allclose(net.forward(net.inputs(words)[0], win), logits, atol=1e-4)
    assert net.score([text])[0] == pytest.approx(sig(np.log(sum(map(np.exp, logits)))), abs=1e-3)


def test_training_reads_every_window(monkeypatch):
    """The gradient of whole texts is the same however many windows a pass holds, far beyond any number drawn before."""
    net = toxicity.Network(2)
    texts = [" ".join(f"a{k % 90}" for k in range(5000)), "a bad line", " ".join(f"b{k}" for k in range(700))]
    y = np.array([1, 1, 0], np.float32)
    whole = net.slope(texts, y)
    monkeypatch.setattr(toxicity, "HELD", 17)
    parts = net.slope(texts, y)
    assert whole.keys() == net.p.keys() and all(np.allclose(whole[k], parts[k], atol=1e-5) for k in whole)
    changed = net.slope([texts[0][:-30] + " quite different at the very end", *texts[1:]], y)
    assert not np.allclose(whole["word"], changed["word"], atol=1e-9)


def test_windows_cover_every_word():
    words, win, counts = toxicity.windows(["w%d " % 0 + " ".join("x%d" % i for i in range(n)) for n in (0, 5, 31, 32, 55, 56, 1000)])
    edge = np.cumsum(counts)
    for n, a, b in zip((0, 5, 31, 32, 55, 56, 1000), [0, *edge[:-1]], edge, strict=True):
        assert len(set(win[a:b].ravel()) - {0}) == n + 1


def test_marginals_against_all_labellings():
    from itertools import product

    r = np.random.default_rng(0)
    chain = quality.Chain()
    chain.t = r.standard_normal((2, 2))
    counts = np.array([3, 1, 4])
    e = r.standard_normal(8)
    good, pair = chain.marginals(e, counts)
    want, moves, at = [], np.zeros((2, 2)), 0
    for n in counts:
        total, ones = 0, np.zeros(n)
        own = np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n)):
            p = np.exp(sum(e[at + i] * y[i] for i in range(n)) + sum(chain.t[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += p
            ones += p * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                own[a, b] += p
        want.extend(ones / total)
        moves += own / total
        at += n
    assert np.allclose(good, want) and np.allclose(pair, moves)


def features_by_loops(text):
    """What each line looks like, a character and a word at a time, beside its neighbours."""
    out, seen = [], set()
    for line in text.split("\n"):
        per = dict.fromkeys(("letter", "upper", "digit", "space", "stop", "odd"), 0)
        for c in line:
            kind = "letter" if ord(c) >= 0x2FF else "upper" if c.isupper() else "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else "stop" if c in ".,;:'?-" else "odd"
            per[kind] += 1
        n, words = len(line), line.split()
        m, w = max(n, 1), max(len(words), 1)
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        out.append([np.log1p(n) / 5, (per["letter"] + per["upper"]) / m, 3 * per["upper"] / m, 5 * per["digit"] / m, 3 * per["space"] / m, 5 * per["stop"] / m, 5 * per["odd"] / m, len(set(words)) / w, np.log1p(max(map(len, words), default=0)) / 3, 2 * again / w, line in seen, n / w / 10, per["odd"] > 0.02 * m, len(words) < 3])
        seen.add(line)
    none = [0.0] * quality.SHAPE
    return [[*x, *(out[k - 1] if k else none), *(out[k + 1] if k + 1 < len(out) else none), k == 0, k + 1 == len(out), 1] for k, x in enumerate(out)]


def quality_by_loops(chain, text):
    """Chances of good lines from all labellings, weighted by length, as a document's share."""
    from itertools import product

    e = [sum(float(a) * float(b) for a, b in zip(x, chain.w, strict=True)) for x in features_by_loops(text)]
    total, good = 0.0, [0.0] * len(e)
    for y in product((0, 1), repeat=len(e)):
        p = np.exp(sum(a * b for a, b in zip(e, y, strict=True)) + sum(chain.t[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += p
        good = [g + p * b for g, b in zip(good, y, strict=True)]
    size = [len(line) + 1e-6 for line in text.split("\n")]
    mean = min(max(sum(g / total * n for g, n in zip(good, size, strict=True)) / sum(size), 1e-4), 1 - 1e-4)
    return 1 / (1 + np.exp(-(chain.scale[0] * np.log(mean / (1 - mean)) + chain.scale[1])))


def test_document_score_against_plain_loops():
    """A document's quality from its lines' features and every labelling of them, in plain loops."""
    chain = quality.Chain()
    r = np.random.default_rng(4)
    chain.w, chain.t, chain.scale = r.standard_normal(chain.w.shape) * 0.3, r.standard_normal((2, 2)), np.array([1.3, -0.4])
    texts = ["First line of it here.\n\nBUY NOW!!! $$$\nand a third, longer line with more words in it\n- item 4", "", "\n", "one one one\none one one\n\u4e2d\u6587 text; ok?"]
    assert chain.score(texts).tolist() == pytest.approx([quality_by_loops(chain, t) for t in texts], abs=1e-5)


@pytest.mark.parametrize(("m", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, m, label):
    rows = [(1, None, 9), (2, "", 9), (None, "some words", None), (3, "long " * 30000, 1), (3, "long " * 30000, 1), (4, "\n\n", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    for labels in ([], [(1, 1), (None, 0), (2, None)], [(1, 1), (2, 0), (3, 1), (3, 0), (99, 1)]):
        model = m.train(docs, spark.createDataFrame(labels, f"doc_id long, {label} int"))
        got = m.score(docs, model).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.id == 3}) == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert m.score(empty, m.train(empty, spark.createDataFrame([], f"doc_id long, {label} int"))).count() == 0
