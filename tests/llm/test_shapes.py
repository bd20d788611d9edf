"""Every operator and pipeline stage on odd rows: nulls, repeats, empty tables, columns whose names the operators use themselves."""

import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from dataplumb.llm import bpe, hnsw, jaccard, langid, linededup, mixing, pii_crf, quality, secretscan, tokenfile  # noqa: E402

NAMES = "rest whole mean last q cell part end_cell drops _id _kept _gone _nth gone nth row id left size n_words copies taken target n_dropped lang score spans".split()


def text(k):
    draw = random.Random(k)
    return " ".join("".join(draw.choice(["ri", "ver", "mill", "sto", "ne", "far", "ta", "lo"]) for _ in range(draw.randint(1, 4))) for _ in range(90))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "one", text(1), text(1), text(2), "1." + "0" * 5000 + ".1.1 " + text(3), text(4) * 300, "\n".join([text(5), text(5)])]
    rows = [(i if i != 4 else None, t, ["b", None][i % 2]) + ("mine",) * len(NAMES) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5]]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)).repartition(3)


WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
OPERATORS = {
    "bpe": lambda d: bpe.encode(d, WORDS),
    "jaccard": jaccard.classes,
    "tokenfile": lambda d: tokenfile.round_trip(d, BYTES),
    "quality": quality.assess,
    "langid": langid.identify,
    "secretscan": secretscan.report,
    "pii_crf": pii_crf.report,
    "mixing": mixing.mix,
    "linededup": linededup.dedup,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(docs, name):
    assert len(OPERATORS[name](docs).collect()) == docs.count()
    assert OPERATORS[name](docs.limit(0)).collect() == []


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages(spark, docs, stage):
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[n] == "mine" for r in rows for n in NAMES)
    assert stage(spark, docs.limit(0), "").collect() == []


def test_last_stage(spark, docs):
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, docs, "").count() == docs.count()
    assert stage(spark, docs.limit(0), "").count() == 0


def test_documents_need_whole_numbers_where_they_are_ordered(spark):
    with pytest.raises(TypeError):
        jaccard.classes(spark.createDataFrame([("a", "b c")], "doc_id string, text string"))


def test_more_languages_than_bits(spark):
    """A word of its own for each of 70 languages."""
    samples = {f"l{k:02d}": [" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}zq{chr(97 + (k * 7 + j) % 26)}" for j in range(5)) + " "] * 4 for k in range(70)}
    filters = langid.fit(samples)
    assert len(filters.tables) == 2
    rows = [(k, samples[f"l{k:02d}"][0]) for k in range(70)]
    found = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), filters).collect()}
    assert sum(found[k] == f"l{k:02d}" for k in range(70)) >= 66


def test_features_do_not_share_places():
    assert pii_crf.features("a@b", "")[-1] != pii_crf.features("abcdefgh1", "")[-1]
    assert all(max(pii_crf.features(t, b)) < pii_crf.FEATURES for t in ("a@b", "+1(2)=3", '"' * 9 + "x" * 99 + "1" * 99) for b in ("", "a)", "+:"))


def test_numbers_that_fail_their_check_are_not_overruled(spark):
    good, bad = "4111111111111111", "4111111111111112"
    texts = [f"card {good} of customer {k} pays {good} today " for k in range(200)] + [f"card {bad} of customer 7 and {bad} again"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii_crf.report(docs).collect()}
    assert spans[0].count("card:") == 2 and spans[200] == ""


def graph_of(n, dims, seed=1):
    draw = np.random.default_rng(seed)
    vectors = draw.standard_normal((n, dims))
    return hnsw.build(np.arange(n), np.ones(n, np.int64), vectors), vectors, draw


def test_graph_is_walked_and_finds_rare_links(monkeypatch):
    """Shards of some thousand nodes; the full scan is for audits only."""
    graph, vectors, draw = graph_of(4000, 32)
    near = vectors[:60] / np.linalg.norm(vectors[:60], axis=1, keepdims=True)
    turn = draw.standard_normal(near.shape)
    turn -= (turn * near).sum(1, keepdims=True) * near
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    others = draw.standard_normal((3000, 32))
    others[::50] = 0.96 * near + np.sqrt(1 - 0.96**2) * turn
    other = hnsw.build(np.arange(3000), np.ones(3000, np.int64), others)
    looked = []
    real = hnsw.scan
    monkeypatch.setattr(hnsw, "scan", lambda g, q: looked.append(len(q)) or real(g, q))
    a, b = hnsw.linked(graph, other, False)
    assert sum(looked) <= 4 * hnsw.AUDIT
    cosine = graph.unit.astype(float) @ other.unit.astype(float).T
    want = set(map(tuple, np.argwhere(cosine >= hnsw.LEAST)))
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    assert len(want) >= 60 and found <= {(int(x), int(y)) for x, y in np.argwhere(cosine >= hnsw.LEAST - 1e-6)}
    assert len(found & {(int(x), int(y)) for x, y in want}) >= 0.95 * len(want)


def test_audit_fails_where_the_graph_is_broken():
    graph, _, _ = graph_of(2000, 16)
    assert hnsw.found_probes(graph, hnsw.BEAM) >= hnsw.RECALL
    graph.layers[0][:] = -1
    assert hnsw.found_probes(graph, hnsw.BEAM) < hnsw.RECALL
    # Without links beams find nothing, so that all is looked at.
    found = hnsw.near(graph, graph.unit[:10])
    assert all(k in x for k, x in enumerate(found))
