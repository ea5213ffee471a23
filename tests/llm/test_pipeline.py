"""The pipeline, each stage against its brute-force version on what the stage before it kept."""

import hashlib

import corpus_pipeline
import pytest
import sentencepiece
from plumbline.llm import toxicity
from plumbline.llm.queries import piece_model_path
from test_linededup import brute as brute_lines
from test_mixing import fill
from test_shared import brute as brute_groups

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, seen[-1], DATA).write.parquet(path)
        seen.append(spark.read.parquet(path))
    return [[r.asDict() for r in df.collect()] for df in seen]


def test_columns(stages):
    assert all(r.keys() == {"doc_id", "text", "lang", "source", "n_chars"} for rows in stages[:5] for r in rows)


def test_toxic_go(spark, stages):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    net = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"), ~corpus_pipeline._held_out(4, 2))
    scores = dict(zip([r["doc_id"] for r in stages[0]], net.score([r["text"] for r in stages[0]]), strict=True))
    assert {r["doc_id"] for r in stages[1]} == {i for i, s in scores.items() if s < 0.3}
    assert 0 < len(stages[0]) - len(stages[1]) < len(stages[0]) / 2


def test_lines_go(stages):
    want = {(i, t) for i, t, _ in brute_lines([(r["doc_id"], r["text"]) for r in stages[1]])}
    assert {(r["doc_id"], r["text"]) for r in stages[2]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])


def test_one_of_each_group_stays(stages):
    """Groups over all pairs by their true share of distinct five-word shingles; of each the smallest id stays."""
    rows = sorted((r["doc_id"], r["text"]) for r in stages[2])
    group, _ = brute_groups(rows)
    want = {}
    for (i, _), g in zip(rows, group, strict=True):
        want.setdefault(g, i)
    assert sorted(r["doc_id"] for r in stages[3]) == sorted(want.values())
    assert len(want) < len(rows)


def test_mix(stages):
    """Budgets by pouring again and again, prefixes one document at a time."""
    leaves = {}
    for r in stages[3]:
        leaves.setdefault(("d%d" % (int(r["source"].removeprefix("src")) % 4), r["lang"], r["source"]), []).append((r["doc_id"], len(r["text"].split())))
    tokens = {leaf: sum(n for _, n in m) for leaf, m in leaves.items()}
    cap = {}
    for leaf, n in tokens.items():
        for k in (1, 2, 3):
            cap[leaf[:k]] = cap.get(leaf[:k], 0) + 2 * n
    weigh = (lambda p: {"d0": 4, "d1": 3, "d2": 2}.get(p[0], 1), lambda p: {"en": 3, "de": 2, "fr": 2}.get(p[1], 1), lambda p: 1)
    grant = {(): float(sum(tokens.values()))}
    for k in range(3):
        for parent in [p for p in list(grant) if len(p) == k]:
            grant |= fill(grant[parent], sorted({leaf[: k + 1] for leaf in tokens if leaf[:k] == parent}), cap, weigh[k])
    want = []
    for leaf, members in leaves.items():
        g = int(grant[leaf] + 1e-6)
        whole, rest = (g // tokens[leaf], g % tokens[leaf]) if tokens[leaf] else (0, 0)
        upto = 0
        for _, n, i in sorted((hashlib.md5(f"7:{whole}:{i}".encode()).hexdigest(), n, i) for i, n in members):
            upto += n
            want += [i] * (whole + (upto <= rest))
    assert sorted(r["doc_id"] for r in stages[4]) == sorted(want)
    texts = {r["doc_id"]: r["text"] for r in stages[3]}
    assert all(r["text"] == texts[r["doc_id"]] for r in stages[4])


def test_tokens(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    want = sorted((r["doc_id"], library.encode(r["text"], add_eos=True)) for r in stages[4])
    assert sorted((r["doc_id"], r["ids"]) for r in stages[5]) == want
    assert sorted((r["doc_id"], r["text"]) for r in stages[5]) == sorted((r["doc_id"], r["text"]) for r in stages[4])


def test_run(spark, stages):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()) == sorted(r["doc_id"] for r in stages[5])


def test_scratch_of_two_threads(spark):
    """What one thread writes is not removed when another's scratch ends, and lists that are equal are not mixed up."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from plumbline.llm.common import scratch, written

    both, ended = Barrier(2), Barrier(2)

    def run(k):
        with scratch(spark) as made:
            both.wait(60)
            df = written(spark.range(10 * (k + 1)), "mine")
            if k:
                ended.wait(60)
            n, own = df.count(), list(made)
        if not k:
            ended.wait(60)
        return n, len(own)

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(run, range(2))) == [(10, 1), (20, 1)]
