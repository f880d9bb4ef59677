import os
import zlib

import numpy as np
import pytest

from silvan.llm import labelled, quality, queries, toxicity

from .data import documents, empty

BAD = ["idiotic", "vilescum", "trashy"]


def sentences(seed, count, rate=0.3):
    draw = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for _ in range(count):
        text = draw.choice(words, int(draw.integers(5, 60))).tolist()
        toxic = int(draw.random() < rate)
        for _ in range(int(draw.integers(1, 4)) * toxic):
            text.insert(int(draw.integers(0, len(text))), str(draw.choice(BAD)))
        rows.append((" ".join(text).encode(), toxic))
    return rows


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(sentences(1, 800))


def test_field_separates_and_marks(model):
    for text, toxic in sentences(2, 300):
        score, spans = model.tag(text)
        assert int(score >= 0.5) == toxic
        assert sorted(text.decode()[a:b] for a, b in spans) == sorted(w for w in text.decode().split() if w in BAD)


def test_fit_reads_whole_sentences():
    """Long sentences without marks of their end, toxic words far behind."""
    draw = np.random.default_rng(3)
    rows = []
    for i in range(300):
        text = [f"word{k}" for k in draw.integers(0, 300, 150)]
        if i % 3 == 0:
            text[int(draw.integers(70, 150))] = BAD[i // 3 % 3]
        rows.append((" ".join(text).encode(), int(i % 3 == 0)))
    model = toxicity.fit(rows)
    assert all(model.word[w.encode()] > 1 for w in BAD)
    for text, toxic in rows:
        score, spans = model.tag(text)
        assert (int(score >= 0.5), len(spans)) == (toxic, toxic)


def test_fit_draws_from_all_rows(monkeypatch):
    """A word of the last rows alone counts, however few windows are drawn."""
    monkeypatch.setattr(toxicity, "SENTENCES", 80)
    draw = np.random.default_rng(4)
    rows = []
    for i in range(900):
        text = [f"word{k}" for k in draw.integers(0, 300, 20)]
        if i % 3 == 0:
            text[int(draw.integers(0, 20))] = "idiotic" if i < 840 else "vilescum"
        rows.append((" ".join(text).encode(), int(i % 3 == 0)))
    model = toxicity.fit(rows)
    assert model.word[b"idiotic"] > 1 and model.word[b"vilescum"] > 1
    assert model.tag(b"some vilescum thing")[1] == [(5, 13)]


def test_spans_count_code_points(model):
    text = "größe 🙂 idiotic naïve"
    assert [text[a:b] for a, b in model.tag(text.encode())[1]] == ["idiotic"]


def test_compressed_marginals_are_exact(model):
    draw = np.random.default_rng(0)
    pair = np.exp(np.array(model.pair))
    for _ in range(30):
        n = int(draw.integers(1, 25))
        at = sorted(draw.permutation(n)[: int(draw.integers(1, n + 1))].tolist())
        scores = draw.normal(0, 2, len(at)).tolist()
        emit = [np.array([1.0, np.exp(scores[at.index(i)] if i in at else model.other)]) for i in range(n)]
        forward = [np.array([1.0, np.exp(model.start)]) * emit[0]]
        for e in emit[1:]:
            forward.append(forward[-1] @ pair * e)
        back = [np.ones(2)]
        for e in emit[:0:-1]:
            back.append(pair @ (e * back[-1]))
        back = back[::-1]
        want = [(f * b)[1] / (f * b).sum() for f, b in zip(forward, back, strict=True)]
        assert model.marginals(at, scores, n) == pytest.approx([want[i] for i in at], abs=1e-9)


def test_one_label_only_scores_all_alike():
    assert toxicity.fit([(b"a b", 0)]).tag(b"a")[0] < 0.5 <= toxicity.fit([(b"a b", 1)]).tag(b"")[0]
    assert toxicity.fit([]).tag(b"anything")[0] < 0.5


def test_toxicity_of_odd_rows(spark, model):
    df = documents(spark)
    got = toxicity.scored(df, model).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    for r in got:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
    assert toxicity.scored(empty(spark), model).count() == 0
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == df.count()
    assert toxicity.without_toxic(spark.createDataFrame([(1, "you idiotic thing")], "doc_id long, text string"), model).count() == 0


def quality_rows(seed, count):
    draw = np.random.default_rng(seed)
    words = [f"wo{i}rd" for i in range(200)]
    rows = []
    for _ in range(count):
        text = draw.choice(words, int(draw.integers(10, 120))).tolist()
        kind = int(draw.integers(0, 8))
        if kind == 0:
            rows.append((" ".join(w.upper() + "!!" for w in text).encode(), 0))
        elif kind == 1:
            rows.append((" ".join([*text[:5], *[text[0]] * 30]).encode(), 0))
        else:
            rows.append((" ".join(text).encode(), 1))
    return rows


@pytest.fixture(scope="module")
def network():
    return quality.fit(quality_rows(1, 600))


def test_network_separates(network):
    tables = network.tables()
    got = [(int(network.probability(t, tables) >= 0.7), y) for t, y in quality_rows(2, 200)]
    assert np.mean([a == b for a, b in got]) > 0.95


def test_chunks_cover_every_window(network, monkeypatch):
    draw = np.random.default_rng(3)
    tables = network.tables()
    text = bytes(draw.integers(97, 110, 5000).astype(np.uint8))
    whole = network.peaks(text, tables)
    monkeypatch.setattr(quality, "CHUNK", 300)
    assert np.allclose(network.peaks(text, tables), whole)


def test_quality_of_odd_rows(spark, network):
    df = documents(spark)
    got = quality.scored(df, network).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality.scored(empty(spark), network).count() == 0
    assert quality.fit([]).probability(b"", quality.fit([]).tables()) == 0.5


def test_sample_leaves_the_held_out_fold_and_odd_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (5000, 1), (7, None), (8, 3)], "doc_id long, toxic int")
    rows = labelled.sample(spark, docs, labels, "toxic", 5, 0, 1000)
    assert {int(t.split()[1]) for t, _ in rows} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 0}
    assert len(labelled.sample(spark, docs, labels, "toxic", 5, 0, 10)) <= 10


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
@pytest.mark.parametrize(("query", "label", "least"), [("op9_toxicity", "toxic", 0.9), ("op2_quality", "quality", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    d = "/root/testdata/sf0.01"
    scored = queries.QUERIES[query](spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    assert scored.selectExpr(f"avg(cast(predicted = {label} as double))").first()[0] >= least
