"""Phrase collocations against counting every phrase."""

import random
import re
from collections import Counter, defaultdict

import pytest

from plumbline.llm import phrases, queries

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top, least, cover=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, w[i : i + k]] += 1
    found = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) == 1 or a < least:
            continue
        s, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        found[lang].append((p, a, f[lang, p[:k]], f[lang, p[k:]], n[lang], s))
    out = []
    for lang, own in found.items():
        most = Counter()
        for p, a, *_ in own:
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    most[q] = max(most[q], a)
        own = [x for x in own if not (len(x[0]) == 2 and 100 * most[x[0]] >= cover * x[1] and most[x[0]])]
        own.sort(key=lambda x: (-x[5], -x[1], " ".join(x[0]).encode()))
        out += [(lang, i, " ".join(p), *rest) for i, (p, *rest) in enumerate(own[:top], 1)]
    return sorted(out)


def test_query_is_as_counting_all_phrases(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()]
    got = sorted(tuple(r) for r in queries.op11_phrase_collocations(spark, SF).collect())
    assert got == brute(rows, 2000, 10) and len(got) > 100


def some(seed):
    rnd = random.Random(seed)
    words = ["a", "b", "c", "é", "Ab", "ß", "x-y", "I", "İ"] + [f"w{i}" for i in range(12)]
    rows = []
    for _ in range(120):
        text = ""
        for _ in range(rnd.randint(0, 60)):
            text += rnd.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "?!"]) + (rnd.choice(["a b c", "w1 w2", "I Ab w3"]) if rnd.random() < 0.3 else rnd.choice(words))
        rows.append((rnd.choice(["en", "en", "de", None, "und"]), text))
    return [*rows, ("en", None), ("fr", ""), ("xx", "one two"), (None, None), ("en", "a b c " * 500), ("long", "q r\t" * 4000)]


@pytest.mark.parametrize("seed,top,least", [(1, 3, 3), (2, 10, 2), (3, 40, 3), (4, 1000, 2)])
def test_small_corpora_with_ties_and_clashing_columns(spark, seed, top, least):
    rows = some(seed)
    df = spark.createDataFrame([(i % 7, *r, 1, 2, 3) for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase int, data int, f int").repartition(4)
    got = sorted(tuple(r) for r in phrases.collocations(df, top=top, least=least).collect())
    assert got == brute(rows, top, least)


def test_bounds_settle_before_all_is_expanded(spark, monkeypatch):
    """With few phrases wanted some prefixes are never counted, and the result is the same."""
    asked = []
    real = phrases._thresholds
    monkeypatch.setattr(phrases, "_thresholds", lambda pairs, wanted: asked.append(wanted) or real(pairs, wanted))
    rows = some(5)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(df, top=2, least=2).collect()) == brute(rows, 2, 2)
    assert asked and asked[0] == 4


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(4_000_000_000, 4_000_000_000, 5_000_000_000)], "a long, l long, r long")
    assert df.select(phrases._score("a", "l", "r").alias("s")).first().s == 1_000_000 * 4_000_000_000**2 // (4_000_000_000 * 5_000_000_000)


def test_no_words(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", " .,\t")], "lang string, text string")).count() == 0
