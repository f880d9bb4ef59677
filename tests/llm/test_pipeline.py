from collections import Counter

import corpus_pipeline
from silvan.llm import packing, queries, secret_scan, toxicity

from .data import documents
from .test_text_operators import base_spans, brute_components, brute_groups, near_texts


def test_stages_against_brute_force(spark, tmp_path, monkeypatch):
    """Each stage on what its predecessor kept."""
    texts = near_texts(9, 120)
    texts += ["token=abcdefghijkl and more words here", "  the  same", "the same", "you vilescum thing", None]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    model = toxicity.Field({b"vilescum": 9.0}, {}, -4.0, ((1.0, -1.0), (0.0, 0.0)), -2.0, (-5.0, 10.0))
    monkeypatch.setattr(queries, "toxicity_model", lambda *a: model)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_join", "secret_scan", "packing"]
    kept = dict(rows)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "packing":
            break
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            kept = {i: t for i, t in kept.items() if "vilescum" not in (t or "")}
        elif name == "exact_dedup":
            stay = {keep for keep, _ in brute_groups(kept.items()).values()}
            kept = {i: t for i, t in kept.items() if i in stay}
        elif name == "ngram_join":
            stay = {i for i, (_, c) in brute_components(kept.items()).items() if i == c}
            kept = {i: t for i, t in kept.items() if i in stay}
        else:
            assert not any(base_spans(t or "") for t in got.values()) and set(got) == set(kept)
            kept = {i: got[i] if base_spans(t or "") else t for i, t in kept.items()}
        assert got == kept, name
    sizes = Counter()
    for r in docs.collect():
        sizes[r.doc_id] += r.length
    assert set(sizes) == set(kept)


def test_run_on_odd_rows(spark, tmp_path):
    documents(spark, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [c.split()[0] for c in packing.PIECES.split(", ")] and out.count() > 0
    assert secret_scan.KINDS[0] == "assign"
