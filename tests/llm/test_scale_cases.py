"""Cases that grow: families of near copies, very long texts, many equal rows, large ids beside missing ones."""

import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silvan.llm import brown_lm, exact_dedup, licenses, media, ngram_join, packing, queries, secret_scan, toxicity

from .data import SCHEMA, documents, empty
from .test_text_operators import alternatives, brute_components, near_texts

LARGE = (1 << 53) + 1


def family(seed, count, size=60):
    """Copies of one text with up to eight words replaced, and of a second one that shares half of it."""
    draw = random.Random(seed)
    base = [f"t{i}" for i in range(size)]
    other = base[: size // 2] + [f"u{i}" for i in range(size - size // 2)]
    out = []
    for i in range(count):
        words = list(other if i % 5 == 0 else base)
        for _ in range(draw.randrange(0, 9)):
            words[draw.randrange(size)] = f"x{draw.randrange(40)}"
        out.append(" ".join(words))
    return out


def sets_of(texts):
    return [ngram_join.shingles(ngram_join.hashed(t.encode())) for t in texts]


def test_differences_of_linked_sets_meet(spark):
    """For third sets of all sorts: members, what they have in common, nothing, and something else."""
    draw = np.random.default_rng(3)
    counts = draw.integers(1, 50, 1 << 16).astype(np.int32)
    sets = sets_of(family(1, 100) + family(2, 50, 12) + family(3, 50, 9))
    thirds = [sets[int(i)] for i in draw.integers(0, len(sets), 12)] + [sets_of([" ".join(f"t{i}" for i in range(n))])[0] for n in (60, 12, 9)] + [sets[0][:0], sets_of(["something else that no set has"])[0]]
    rows = []
    for b, third in enumerate(thirds):
        for i, x in enumerate(sets):
            elements, d = ngram_join.difference_order(x, third, counts)
            rows.append((i, b, len(x), d, elements.view(np.int64).tolist()))
    members = spark.createDataFrame(rows, "rep long, b long, n long, d long, elements array<long>")
    got = {(r.b, r.rep): r for r in ngram_join.with_prefixes(members).collect()}
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if ngram_join.linked(sets[i], sets[j]) and not np.array_equal(sets[i], sets[j])]
    met = 0
    for b in range(len(thirds)):
        for i in range(len(sets)):
            r = got[b, i]
            assert r.tail <= len(r.elements) and (not r.near or i == r.leader or ngram_join.linked(sets[i], sets[r.leader]))
        for i, j in linked:
            x, y = got[b, i], got[b, j]
            if not (x.near and y.near):
                met += 1
                assert set(x.elements[: x.tail if y.near else x.head]) & set(y.elements[: y.tail if x.near else y.head])
    assert met > 500


@pytest.mark.parametrize(("short", "rounds"), [(3, 4), (3, 0), (3, 1)])
def test_long_lists_against_all_pairs(spark, monkeypatch, short, rounds):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    rows = list(enumerate(near_texts(3, 60) + family(4, 70) + family(5, 30, 14)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(df, rounds).collect()}
    assert got == brute_components(rows)


def test_work_of_a_family_grows_with_its_members(spark, monkeypatch):
    """Pairs that are compared, of 100 and of 400 near copies of one text."""
    compared = []
    whole = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda texts, pairs: compared.append(pairs.count()) or whole(texts, pairs))
    work = []
    for count in (100, 400):
        draw = random.Random(6)
        base, texts = [f"t{i}" for i in range(150)], []
        for i in range(count):
            words = list(base)
            for _ in range(3 + i % 3):
                words[draw.randrange(150)] = f"x{draw.randrange(10**6)}"
            texts.append(" ".join(words))
        compared.clear()
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(df).collect()}
        assert got == brute_components(list(enumerate(texts)))
        work.append(sum(compared))
    assert work[1] < 8 * work[0] < 400 * 399 / 8


def entropy_spans(text):
    """Entropy spans by their definition: whole windows, no counts that are carried on."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/=_-]{20,}", text):
        word = m.group()
        if not (re.search("[0-9]", word) and re.search("[A-Za-z]", word)):
            continue
        if any(re.search(p, word) for p in secret_scan.ALLOWED) or re.search(r"^[A-Za-z]{1,24}([/_-]+([A-Za-z]{0,24}|[0-9]{1,4}))+$", word):
            continue
        need = next(bits for pattern, bits in secret_scan.CLASSES if re.search(pattern, word))
        best = max(-sum(c / 20 * math.log2(c / 20) for c in Counter(word[i : i + 20]).values()) for i in range(len(word) - 19))
        if best >= need:
            out.append(f"entropy:{m.start()}:{m.end()}")
    return out


def test_entropy_spans_against_whole_windows(spark):
    draw = random.Random(8)
    kinds = ["0123456789abcdef", "ABCDEFGHJK23456789", "abcdefghij0123456789", secret_scan.SYMBOLS, "ab1", "a-b_c/1"]
    texts = []
    for i in range(300):
        words = ["".join(draw.choices(draw.choice(kinds)[: draw.randrange(3, 70)], k=draw.randrange(15, 60))) for _ in range(4)]
        texts.append(" , ".join([*words, "550e8400-e29b-41d4-a716-446655440000", "sha256-" + "9f" * 20, "some-words/with_marks-2024/and-more", "QwErTzUiOpAsDfGhJkLyXcVbNm,1 x", "QwErTzUiOpAsDfGhJkLy9cVbNm,1 x"][i % 9 :]))
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    some = 0
    for i, text in enumerate(texts):
        base = [tuple(map(int, s.split(":")[1:])) for s in got[i].spans.split(",") if s and not s.startswith("entropy")]
        want = [s for s in entropy_spans(text) if not any(a < int(s.split(":")[2]) and int(s.split(":")[1]) < e for a, e in base)]
        assert [s for s in got[i].spans.split(",") if s.startswith("entropy")] == want, text
        some += len(want)
    assert some > 100


def test_secret_scan_of_very_long_candidates(spark):
    slug, run, random_ = "ab_" * 330_000 + "c1", "g1" * 100_000, "".join(random.Random(1).choices(secret_scan.SYMBOLS[:62], k=20_000))
    rows = [(1, slug), (2, run), (3, random_), (4, "x-" * 200_000 + "1"), (5, "password=" + "p" * 500_000)]
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got[1].spans == got[2].spans == got[4].spans == "" and got[3].spans == f"entropy:0:{len(random_)}" and got[5].spans == "assign:0:500009"


def test_packing_of_equal_rows_and_large_ids(spark):
    rows = [(7, "the same text")] * 3000 + [(LARGE, "large"), (None, "none"), (LARGE + 2, None), (None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(df, queries.VOCABULARY, queries.RANKS, group=100).collect()
    assert Counter(r.doc_id for r in got) == Counter({7: 3000, LARGE: 1, LARGE + 2: 1, None: 2})
    groups = Counter(r.sequence_id >> 32 for r in got)
    assert len(groups) > 20 and max(groups.values()) < 300
    again = packing.pack(df, queries.VOCABULARY, queries.RANKS, group=100).collect()
    assert Counter(got) == Counter(again)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0) and r.offset + r.length <= packing.LENGTH
        ends[r.sequence_id] = r.offset + r.length


def test_language_model_of_large_ids_and_long_texts(spark):
    long_ = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(LARGE, "the cat sat"), (None, "the dog"), (LARGE + 2, long_), (5, "the cat ran"), (6, None), (None, long_)] + [(10 + i, f"the cat {i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = Counter((r.doc_id, r.held_out, r.n_tokens) for r in brown_lm.scores(df, seeds=5, classes=3, block=64).collect())
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    assert got == Counter((i, held(i), len((t or "").split()) + 1) for i, t in rows)


def test_every_sentence_of_a_license_is_found(spark):
    texts, labels = [], []
    for label, _, held, pattern in licenses.SENTENCES:
        for text in alternatives(pattern)[:: max(1, len(alternatives(pattern)) // 4)]:
            assert held in f" {text} "
            texts.append(f"some words {text} and more")
            labels.append(label)
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect()}
    lost = [(labels[i], got[i]) for i in range(len(texts)) if not got[i] or got[i] == [""]]
    assert not lost and sum(labels[i] in got[i] for i in range(len(texts))) > 0.95 * len(texts)
    assert licenses.scan(spark.createDataFrame([(1, "permission to leave early is granted to all free of charge")], "doc_id long, text string")).first().labels == ""


def test_sniffing_takes_time_in_proportion():
    def seconds(data):
        start = time.perf_counter()
        media.sniff(data)
        return time.perf_counter() - start

    for mark in (b"%PDF-", b"PK\3\4", b"\xff\xd8\xff\xda\0\0", b"\x1f\x8b\x08\0"):
        seconds(mark * 1000)
        assert seconds(mark * 200_000) < 20 * max(0.02, seconds(mark * 20_000))
    pdf = b"%PDF-1.4 body startxref 9 %%EOF"
    assert [(f.kind, f.start, f.end) for f in media.sniff(b"xx" + pdf + b"yy")] == [("application/pdf", 2, 2 + len(pdf))]
    assert media.sniff(b"%PDF-1.4 %%EOF startxref") == []


def test_deduplication_of_rows_without_doc_id_and_clashing_digests(spark):
    rows = [(None, "a b"), (None, "ab"), (3, "a  b"), (None, "only here"), (4, "c"), (4, "c"), (4, "d"), (LARGE, "e e"), (LARGE + 2, "ee"), (9, None), (8, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).withColumn("digest", F.lit("clash")).withColumn("own_row", F.lit(1)).repartition(3)
    want = Counter([(3, "a  b"), (None, "only here"), (4, "c"), (4, "d"), (LARGE, "e e"), (8, "")])
    for size in (32, 1, 0):
        out = exact_dedup.deduplicate(df, size=size)
        assert out.columns == df.columns and Counter((r.doc_id, r.text) for r in out.collect()) == want


def test_pipeline_of_an_empty_table_and_of_clashing_names(spark, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, docs in (("empty", empty(spark)), ("names", documents(spark))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert (out.count() == 0) == (name == "empty")


def test_classifiers_without_documents_or_labels(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (LARGE, 1, 1)], "doc_id long, quality int, toxic int")
    for name, docs, labels in (("none", documents(spark), none), ("some", empty(spark), some), ("both", documents(spark), some)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        for query in (queries.op2_quality, queries.op9_toxicity):
            got = query(spark, f"{tmp_path}/{name}").collect()
            assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)


class Kernels:
    """Stands for a frame, its session and a broadcast value; keeps the kernels that it is given."""

    def __init__(self, value=None, schema=None):
        self.found, self.value, self.schema, self.columns = [], value, schema, ["doc_id", "text"]

    def mapInArrow(self, kernel, schema):
        self.found.append(kernel)
        raise NotImplementedError

    def select(self, *columns):
        return self


def test_kernels_hold_a_few_rows_of_a_batch(spark):
    """Of a batch of 20 MB of texts, as Spark sends them, little stands in Python's memory at once, and what goes back is cut small."""
    draw = np.random.default_rng(9)
    texts = [" ".join(map(str, draw.integers(0, 1000, 640))) for _ in range(8000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    size = batch.nbytes
    assert size > 18e6
    table = np.ones(1 << 16, np.int32)
    model = toxicity.Field({b"vilescum": 9.0}, {}, -4.0, ((1.0, -1.0), (0.0, 0.0)), -2.0, (-5.0, 10.0))
    cases = {
        "prefixes": (lambda docs: ngram_join.prefixes(docs, Kernels(table)), batch), "counts": (lambda docs: ngram_join.bucket_counts(docs, 16, 1), batch.select(["text"])),
        "toxicity": (lambda docs: toxicity.without_toxic(docs, model), batch),
    }
    for name, (build, rows) in cases.items():
        docs = Kernels()
        with pytest.raises(NotImplementedError):
            build(docs)
        tracemalloc.start()
        sent = [out.num_rows for out in docs.found[0](iter([rows]))]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < size / 2, (name, most)
        assert name == "counts" or sum(sent) == len(texts) and max(sent) <= 1000, name


def test_counts_of_buckets_are_whole(spark):
    """Added up in many parts, with rows without words between them, in one task and in several that are added up before."""
    texts = [f"a{i} b{i % 7} c{i % 5} d{i % 3} e f{i} g" * (1 + i % 4) if i % 6 else [None, "", "one"][i // 6 % 3] for i in range(3000)]
    want = np.bincount(np.concatenate([(x >> np.uint64(60)).astype(np.int64) for x in sets_of([t or "" for t in texts])]), minlength=16)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tasks in (1, 3):
        assert ngram_join.bucket_counts(df.repartition(tasks), 4, tasks).tolist() == want.tolist()
