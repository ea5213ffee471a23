"""Phrase collocations by best-first branch-and-bound growth.

A phrase grows to the right: words that are frequent enough become two words, two words three. What
three words can score is bounded by the counts of their prefix: a phrase is no more frequent than its
first two words, and its first cut divides by the first word's count and by that of a rest which is no
rarer than the phrase, so ``score <= unit * f(first two) / f(first)``. Prefixes are expanded from the
highest bound down, a batch at a time for all languages at once, each batch counted over the whole
corpus. A language is settled when enough phrases that survive score at least as much as any prefix
not yet expanded could.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.llm.sieve import passes, sieve

#: Scores are whole numbers of 1/UNIT; bytes of text whose words a task counts at once; the first batch has so many times the phrases asked for; parts in which a language is ranked first.
UNIT, CHUNK, WIDE, PARTS = 1_000_000, 4 << 20, 2, 16
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA5A3564E27F8862D], np.uint64)
#: A separator of pieces stands for itself as a word ".", which no word can hold.
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")
_END = re.compile(rb"\.+")


class _Numbers(dict):
    """A number for each word, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = got = len(self)
        return got


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """(lang, numbers, words): the words of some texts of one language, as numbers of the list; 0 is the end of a piece."""
    for b in batches:
        texts, langs = b.column("data").to_pylist(), b.column("lang").to_pylist()
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(langs, texts, strict=True):
            by.setdefault(lang, []).append(text)
        for lang, own in by.items():
            lo = 0
            while lo < len(own):
                hi, size = lo, 0
                while hi < len(own) and (hi == lo or size + len(own[hi]) <= CHUNK):
                    size += len(own[hi])
                    hi += 1
                number = _Numbers()
                number[b"."] = 0
                text = _END.sub(b" . ", b".".join(own[lo:hi]).translate(_LOWER))
                ids = np.fromiter(map(number.__getitem__, text.split()), np.int64)
                yield lang, ids, list(number)
                lo = hi


class _Chunk:
    """Words of some texts of one language, with a 64-bit key for each word and each pair of words."""

    def __init__(self, lang: str, ids: np.ndarray, words: list[bytes]):
        self.lang, self.ids, self.words = lang, ids, words
        self.width = len(words)

    def keys(self) -> np.ndarray:
        start = self.lang.encode() + b"\t"
        return np.array([xxhash.xxh64_intdigest(start + w) for w in self.words], np.uint64)

    def pairs(self, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places, different pairs, which one each place has, counts) of neighbours that are both ``ok``."""
        at = np.flatnonzero(ok[self.ids[:-1]] & ok[self.ids[1:]]) if len(self.ids) else np.zeros(0, np.int64)
        return at, *np.unique(self.ids[at] * self.width + self.ids[at + 1], return_inverse=True, return_counts=True)

    def pair_keys(self, pairs: np.ndarray) -> np.ndarray:
        words = self.keys()
        first, second = np.divmod(pairs, self.width)
        x = (words[first] * _ODD[0]) ^ (words[second] * _ODD[1] >> np.uint64(31)) ^ (words[second] * _ODD[2])
        x = (x ^ x >> np.uint64(29)) * _ODD[0]
        return x ^ x >> np.uint64(32)

    def spelt(self, pairs: np.ndarray) -> list[bytes]:
        words = self.words
        return [words[p] + b" " + words[q] for p, q in zip(*(x.tolist() for x in np.divmod(pairs, self.width)), strict=True)]


def _counted(docs: DataFrame, found: Callable[[_Chunk], tuple[list[bytes], np.ndarray, np.ndarray]]) -> DataFrame:
    """(lang, phrase, key, f): the phrases, keys and counts that ``found`` gives for each chunk, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _words(batches):
            phrases, keys, n = found(_Chunk(*x))
            for lo in range(0, len(phrases), 100_000):
                part = phrases[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([x[0]] * len(part), pa.string()), pa.array(part, pa.binary()), *[pa.array(c[lo : lo + 100_000].astype(np.int64)) for c in (keys, n)]], ["lang", "phrase", "key", "n"])

    rows = docs.mapInArrow(run, "lang string, phrase binary, key long, n long")
    return rows.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "key").agg(F.sum("n").alias("f"))


def _singles(x: _Chunk) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    return x.words[1:], x.keys()[1:], np.bincount(x.ids, minlength=x.width)[1:]


def _frequent(x: _Chunk, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of words that both pass the sieve of frequent words: what they are, their keys, their counts."""
    ok = passes(words.value, x.keys())
    ok[0] = False
    _, pairs, _, n = x.pairs(ok)
    return pairs, x.pair_keys(pairs), n


def _pair_counts(docs: DataFrame, words) -> DataFrame:
    """(key, f): how often each pair of frequent words occurs, by its key alone; pairs that share a key are counted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _words(batches):
            _, keys, n = _frequent(_Chunk(*x), words)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("f"))


def _doubles(words, often) -> Callable:
    """Pairs of frequent words whose key passes the sieve of frequent pairs."""

    def found(x: _Chunk) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        pairs, keys, n = _frequent(x, words)
        pick = passes(often.value, keys)
        return x.spelt(pairs[pick]), keys[pick], n[pick]

    return found


def _triples(expanded, tested) -> Callable:
    """Three words whose first two are an expanded prefix, or whose last two are a pair that something longer may cover."""

    def found(x: _Chunk) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        ok = np.ones(x.width, bool)
        ok[0] = False
        at, pairs, which, _ = x.pairs(ok)
        key = x.pair_keys(pairs)
        heads, tails = passes(expanded.value, key), passes(tested.value, key)
        follows = np.flatnonzero(at[1:] == at[:-1] + 1)
        follows = follows[heads[which[follows]] | tails[which[follows + 1]]]
        codes, n = np.unique(which[follows] * x.width + x.ids[at[follows] + 2], return_counts=True)
        pair, third = np.divmod(codes, x.width)
        used, back = np.unique(pair, return_inverse=True)
        first, words = x.spelt(pairs[used]), x.words
        return [first[p] + b" " + words[w] for p, w in zip(back.tolist(), third.tolist(), strict=True)], np.zeros(len(n), np.int64), n

    return found


def _score(a: str, left: str, right: str) -> Column:
    """floor(UNIT a a / (left right)), in 38 digits."""
    d = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"({d(a)} * {d(a)} * cast({UNIT} as decimal(7, 0))) div ({d(left)} * {d(right)})")


def _thresholds(pairs: DataFrame, wanted: int) -> DataFrame:
    """(lang, least): a score that ``wanted`` pairs of the language reach, 0 if it has not as many. Scores are counted by hundreds, so a language has at most UNIT / 100 counts."""
    step = F.col("score") - F.col("score") % 100
    counts = pairs.groupBy("lang", step.alias("step")).agg(F.count("*").alias("n"))
    sofar = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("step")))
    return counts.select("lang", "step", sofar.alias("sofar")).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("sofar") >= wanted, F.col("step"))), F.lit(0)).cast("long").alias("least"))


def collocations(docs: DataFrame, top: int = 2000, least: int = 10, cover: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two or three words.

    Texts are lower-cased in A-Z, cut into pieces at . , ; : ! ? and line ends, and pieces into words at
    spaces and tabs. For a phrase that occurs ``a`` >= ``least`` times within pieces, each cut into a first
    part (``l`` times) and a rest (``r`` times) scores floor(UNIT a a / (l r)), and the lowest cut counts,
    of equal ones that after fewer words. A phrase goes if a longer one holds it and occurs in ``cover``
    percent of its places at least. The order is by score, then ``a``, both falling, then the phrase's
    UTF-8 bytes. ``n`` counts all words of the language. A null language is ``und``, a null text
    empty; repeated rows count as often as they are there; other columns are not read; a table without
    words gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("data"))
    singles = written(_counted(docs, _singles), "words")
    total = singles.groupBy("lang").agg(F.sum("f").alias("n"))
    words = singles.where(F.col("f") >= least)
    frequent = spark.sparkContext.broadcast(sieve(words, "key"))
    often = spark.sparkContext.broadcast(sieve(_pair_counts(docs, frequent).where(F.col("f") >= least), "key"))
    doubles = _counted(docs, _doubles(frequent, often)).where(F.col("f") >= least)
    doubles = doubles.select("lang", "phrase", "key", F.col("f").alias("a"), F.substring_index("phrase", " ", 1).alias("w1"), F.substring_index("phrase", " ", -1).alias("w2"))
    one = lambda w, name: words.select("lang", F.col("phrase").alias(w), F.col("f").alias(name))
    pairs = doubles.join(one("w1", "l"), ["lang", "w1"]).join(one("w2", "r"), ["lang", "w2"])
    pairs = written(pairs.select("lang", "phrase", "key", "a", "l", "r", _score("a", "l", "r").alias("score"), F.expr(f"(cast(a as decimal(19, 0)) * {UNIT}) div cast(l as decimal(19, 0))").alias("bound")), "pairs")

    settled, wanted = [], WIDE * top
    open_ = pairs.select("lang").distinct()
    while not open_.isEmpty():
        cuts = _thresholds(pairs.join(open_, "lang"), wanted)
        now = written(pairs.join(cuts, "lang"), "frontier")
        expanded = now.where(F.col("bound") >= F.col("least"))
        tested = now.where(F.col("score") >= F.col("least"))
        held = [spark.sparkContext.broadcast(sieve(x, "key")) for x in (expanded, tested)]
        triples = _counted(docs, _triples(*held)).where(F.col("f") >= least).withColumnRenamed("f", "a")
        triples = triples.select("lang", "phrase", "a", F.substring_index("phrase", " ", 2).alias("head"), F.substring_index("phrase", " ", -2).alias("tail"))
        # both parts of two words are at least as frequent, so they are among the pairs
        head = now.select("lang", F.col("phrase").alias("head"), F.col("l").alias("l1"), F.col("a").alias("l2"), "least")
        tail = now.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r1"), F.col("r").alias("r2"))
        triples = triples.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2"))
        low = F.col("s1") <= F.col("s2")
        triples = written(triples.select("lang", "phrase", "a", "head", "tail", F.when(low, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(low, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"), "least"), "triples")
        longer = triples.select("lang", F.col("head").alias("phrase"), F.col("a").alias("most")).unionByName(triples.select("lang", F.col("tail").alias("phrase"), F.col("a").alias("most"))).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
        alone = tested.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * cover))
        kept = [x.select("lang", "phrase", "a", "l", "r", "score", "least") for x in (alone, triples.where(F.col("score") >= F.col("least")))]
        survivors = written(kept[0].unionByName(kept[1]), "survivors")
        # whatever was not expanded scores less than ``least``
        enough = survivors.groupBy("lang").agg(F.count("*").alias("have"))
        state = written(cuts.join(enough, "lang", "left").select("lang", ((F.col("least") == 0) | (F.coalesce("have", F.lit(0)) >= top)).alias("done")), "state")
        settled.append(survivors.join(state.where("done"), "lang", "left_semi"))
        open_, wanted = state.where("NOT done").select("lang"), wanted * 4

    if not settled:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    every = settled[0]
    for x in settled[1:]:
        every = every.unionByName(x)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's first are among the first of its parts
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    every = every.withColumn("k", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("k") <= top)
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same by counting all phrases. ASCII letters alone are lower-cased.
ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT d, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS q FROM (SELECT d, lang, string_split_regex(text, '[.,;:!?\x0A-\x0D]') AS pieces FROM t)),
w AS (SELECT d, q, lang, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM (SELECT d, q, lang, string_split_regex(trim(piece, ' ' || chr(9)), '[\x20\x09]+') AS ws FROM p) WHERE ws <> ['']),
g AS (SELECT lang, w1, lead(w1) OVER x AS w2, lead(w1, 2) OVER x AS w3 FROM w WINDOW x AS (PARTITION BY d, q ORDER BY i)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (
        SELECT lang, 1 AS k, w1 AS phrase FROM g UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM g WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM g WHERE w3 IS NOT NULL) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
e AS (SELECT lang || chr(9) || phrase AS phrase, f FROM f),
cut AS (SELECT *, lang || chr(9) || array_to_string(w[1 : first], ' ') AS p1, lang || chr(9) || array_to_string(w[first + 1 :], ' ') AS p2 FROM (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS first FROM c)),
s AS (SELECT c.lang, c.k, c.phrase, c.a, c.first, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM cut c JOIN e x ON x.phrase = c.p1 JOIN e y ON y.phrase = c.p2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, first) AS best FROM s) WHERE best = 1),
longer AS (SELECT lang, phrase, max(a) AS most FROM (
        SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase AND b.k = 2 WHERE g.most IS NULL OR 100 * g.most < 50 * b.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""
