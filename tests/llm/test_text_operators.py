import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from silvan.llm import bpe, brown_lm, exact_dedup, licenses, media, ngram_join, packing, queries, secret_scan
from silvan.llm.graph import components

from .data import TEXTS, documents, empty


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.VOCABULARY)


@pytest.fixture(scope="module")
def tokens():
    return bpe.load(queries.VOCABULARY)


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


ALPHABET = ["a", "b", " ", "'s", "the", "\n", "\t", "  ", "é", "ß", "漢", "1", "23", "!!", "\x1c", "\xa0", "　", "🙂", "aaaa", "<|endoftext|>", "ing", "\r\n", ".", ",", "ª"]


@pytest.mark.parametrize("ranks", [None, queries.RANKS])
def test_bpe_agrees_with_the_library(library, ranks):
    draw, own = random.Random(3), bpe.load(queries.VOCABULARY, ranks)
    texts = ["".join(draw.choices(ALPHABET, k=draw.randrange(40))) for _ in range(3000)] + ["a" * 5000, " " * 3000, "ab" * 3000, "=" * 2500, "é" * 900, "\n" * 777]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(own.encode(text)) == want, text
        assert own.decode(own.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_decode_replaces_broken_utf8(library, tokens):
    ids = [200, 97, 255, 128, 30000]
    assert tokens.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_encode_decode_of_a_frame(spark, library):
    got = bpe.encode_decode(documents(spark), queries.VOCABULARY).collect()
    assert len(got) == len(TEXTS) + 3
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id not in (0, 3)}
    for i, text in enumerate(TEXTS):
        if i in by:
            want = library.encode(text or "", add_special_tokens=False).ids
            assert by[i].n_tokens == len(want)
            assert by[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
            assert by[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_decode(empty(spark), queries.VOCABULARY).count() == 0


def test_first_fit_decreasing_is_first_fit():
    draw = random.Random(1)
    for _ in range(50):
        sizes = [draw.randrange(1, 1024) for _ in range(draw.randrange(1, 80))]
        rooms, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = next((b for b, r in enumerate(rooms) if r >= sizes[i]), None)
            if at is None:
                at = len(rooms)
                rooms.append(1024)
            want[i] = at, 1024 - rooms[at]
            rooms[at] -= sizes[i]
        assert packing.pack_group(sizes) == [want[i] for i in range(len(sizes))]


def test_packing_places_every_token_once(spark, library):
    got = packing.pack(documents(spark), queries.VOCABULARY, queries.RANKS, group=4).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for i, text in enumerate(TEXTS):
        if i in (0, 3):
            continue
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for start, length, crc in sorted(pieces[i, len(ids)]):
            assert start == at and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    assert packing.pack(empty(spark), queries.VOCABULARY, queries.RANKS).count() == 0


def brute_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return {norm: (min(g)[3], len(g)) for norm, g in groups.items()}


@pytest.mark.parametrize("size", [32, 0])
def test_exact_groups_also_when_digests_collide(spark, size):
    df = documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute_groups(rows)
    got = exact_dedup.exact_groups(df, salts=3, size=size, window=200).collect()
    assert len(got) == len(rows)
    by = {hashlib.sha256(n.encode()).hexdigest(): v for n, v in want.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == by[r.text_sha256]
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_deduplicate_keeps_columns_and_one_row_each(spark):
    df = documents(spark)
    out = exact_dedup.deduplicate(df)
    assert out.columns == df.columns
    norms = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in out.collect()]
    assert Counter(norms) == Counter(set(brute_groups([(r.doc_id, r.text) for r in df.collect()])))


def brute_components(rows):
    sets = {}
    for doc_id, text in rows:
        words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
        sets[doc_id] = {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set()
    label = {d: d for d in sets}
    ids = sorted(sets)

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = root(a), root(b)
                label[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in ids}


def near_texts(seed, count):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = " ".join(draw.choices(words, k=25))
    texts = []
    for _ in range(count):
        if texts and draw.random() < 0.6:
            base = draw.choice(texts).split()
            for _ in range(draw.randrange(0, 4)):
                if base:
                    base[draw.randrange(len(base))] = draw.choice(words)
            texts.append(" ".join(base))
        else:
            text = " ".join(draw.choices(words, k=draw.choice([1, 3, 8, 12, 40, 90, 150])))
            texts.append(f"{text} {common}" if draw.random() < 0.4 else text)
    return [*texts, "", None, "A b C d E f G h", "a B c D e F g H"]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_against_all_pairs(spark, seed):
    rows = list(enumerate(near_texts(seed, 160)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("rep", F.lit(1)).withColumn("sig", F.lit(2))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(df).collect()}
    assert got == brute_components(rows)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in got.items() if d == c)


def test_ngram_join_of_odd_rows(spark):
    got = ngram_join.join_components(documents(spark)).collect()
    assert len(got) == len(TEXTS) + 3
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.component_id)
    assert by[None] == {None} and by[1] == {1} and by[11] == {0} and by[4] == {0}
    assert ngram_join.join_components(empty(spark)).count() == 0


def test_ngram_join_of_nested_sets(spark):
    """n shingles and the same with one more, before or behind them, for every small n."""
    texts = []
    for n in range(1, 13):
        for side in (0, 1):
            words = [f"n{n}s{side}w{i}" for i in range(n + 4)]
            texts += [" ".join(words), " ".join(words[side : n + 3 + side])]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_components(rows)
    assert [n for n in range(1, 13) if got[4 * n - 4][1] == got[4 * n - 3][1]] == list(range(6, 13))


def test_ngram_join_of_rows_without_or_with_repeated_doc_id(spark):
    a, b = ([f"{x}{i}" for i in range(30)] for x in "ab")
    same, near, other, like = " ".join(a), " ".join(a[:-1]), " ".join(b), " ".join(b[:-1])
    # the row without doc_id comes first in the one task
    rows = [(None, same), (5, same), (6, near)]
    got = {r.doc_id: r.component_id for r in ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {None: None, 5: 5, 6: 5}
    # 7 is one node with two texts, each with a near copy
    rows = [(7, same), (7, other), (8, near), (9, like), (10, None), (None, same), (11, "on its own")]
    for order in (rows, rows[::-1]):
        got = ngram_join.join_components(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter([(7, 27, 7), (7, 27, 7), (8, 26, 7), (9, 26, 7), (10, 0, 10), (None, 27, None), (11, 1, 11)])


def test_prefixes_of_linked_sets_share_enough():
    draw = np.random.default_rng(5)
    counts = draw.integers(1, 50, 1 << 16).astype(np.int32)
    for _ in range(300):
        n = int(draw.integers(7, 120))
        a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: len(a) - int(draw.integers(0, 5))], draw.integers(0, 1 << 62, int(draw.integers(0, 5)), dtype=np.int64).astype(np.uint64)]))
        if ngram_join.linked(a, b) and len(b) - ngram_join.overlap(len(b)) >= 1:
            (pa, la), (pb, lb) = ngram_join.prefix(a, counts, 3.0), ngram_join.prefix(b, counts, 3.0)
            assert len(np.intersect1d(pa, pb)) >= min(la, lb)


def test_components_of_random_graphs(spark):
    draw = random.Random(4)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 420)]
    label = {x: x for e in links for x in e}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: c for x, c in label.items() if x in got} and all(label[x] == x for x in label if x not in got)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32])


SECRETS = [*TEXTS, "secret: token=abcdefgh12 password=abc", "AKIA1234 AKIA123456789012345 é🙂 token = 'ABCDEFGHIJ'", "deadbeef" * 5 + " x " + "0" * 33, "key 8f3Kd92Lq0ZxYt7Bv6Nw1Rp5 end", "550e8400-e29b-41d4-a716-446655440000 and an-ordinary-hyphenated-word-2", "Secret=token=password=abcdefgh"]


def test_secret_scan_against_regular_expressions(spark):
    df = spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string").withColumn("secret_all", F.lit(1))
    got = {r.doc_id: r for r in secret_scan.scan(df).collect()}
    for i, text in enumerate(SECRETS):
        spans = base_spans(text or "")
        listed = [f"{secret_scan.KINDS[k]}:{a}:{e}" for a, k, e in spans]
        assert got[i].base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert set(listed) <= set(got[i].spans.split(",")) | {""}
    place = SECRETS.index("key 8f3Kd92Lq0ZxYt7Bv6Nw1Rp5 end")
    assert got[place].spans == "entropy:4:28"
    assert got[place + 1].spans == ""
    assert secret_scan.scan(empty(spark)).count() == 0


def test_sliding_entropy(spark):
    words = ["Zx9" * 10, "8f3Kd92Lq0ZxYt7Bv6Nw1Rp5", "abcdefghijklmnopqrst0", "A" * 25]
    got = [r.h for r in spark.createDataFrame([(w,) for w in words], "w string").coalesce(1).select(secret_scan.best_entropy(F.col("w")).alias("h")).collect()]
    for word, h in zip(words, got, strict=True):
        want = max(-sum(c / 20 * math.log2(c / 20) for c in Counter(word[i : i + 20]).values()) for i in range(len(word) - 19))
        assert h == pytest.approx(want, abs=1e-9)


def test_redaction_masks_and_keeps_rows(spark):
    df = documents(spark)
    out = secret_scan.redacted(df)
    assert out.columns == df.columns and out.count() == df.count()
    row = out.where("doc_id = 6").first()
    assert row.text == "[SECRET]' and [SECRET]" and row.n_chars == len(row.text)
    assert out.where("doc_id = 3 and text is null").count() == 1


WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOTICES = [*TEXTS, "mit under the mit license under the mit license", "cc by nc cc by nc", "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: GPL-3.0-or-later", "released under the GNU Lesser General Public License version 2.1", "mit der hand und cc an alle"]


def test_license_scan_against_word_lists(spark):
    df = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string").withColumn("norm", F.lit(1))
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, text in enumerate(NOTICES):
        words, places, labels = WORDS.findall((text or "").encode().lower()), [], set()
        for phrase, label in licenses.PHRASES:
            wanted = phrase.encode().split()
            found = [k for k in range(len(words)) if words[k : k + len(wanted)] == wanted]
            places += found
            labels |= {label} if found else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert [got[len(TEXTS) + k].labels for k in range(2, 6)] == ["apache-2", "gpl-3", "lgpl-2.1", ""]
    assert len(licenses.rules()) >= 300
    assert licenses.scan(empty(spark)).count() == 0


def alternatives(pattern):
    """Every text that a pattern of groups, character sets and '?' matches."""
    def of(parsed):
        texts = [""]
        for kind, value in parsed:
            if kind == re._constants.LITERAL:
                more = [chr(value)]
            elif kind == re._constants.IN:
                more = [chr(c) for k, v in value for c in (range(v[0], v[1] + 1) if k == re._constants.RANGE else [v])]
            elif kind == re._constants.SUBPATTERN:
                more = of(value[3])
            elif kind == re._constants.BRANCH:
                more = [t for branch in value[1] for t in of(branch)]
            else:
                assert kind == re._constants.MAX_REPEAT and value[:2] == (0, 1)
                more = ["", *of(value[2])]
            texts = [a + b for a in texts for b in more]
        return texts

    return of(re._parser.parse(pattern))


def test_every_alternative_of_a_license_is_found_alone(spark):
    """Gates change nothing: labels are those of all rules without them."""
    texts = ["licensed under creative commons attribution 4.0", "licensed under the GNU Library General Public License", "subject to the zero clause bsd"]
    for form, *_ in licenses.FORMS:
        kinds = alternatives(form.replace("{name}", "@").replace("{spdx}", "@"))
        for family in licenses.FAMILIES:
            for i, name in enumerate(dict.fromkeys(alternatives(family.spdx if "{spdx}" in form else family.name))):
                texts.append(kinds[i % len(kinds)].replace("@", name))
    rules = [(label, priority, re.compile(pattern)) for _, label, priority, _, pattern in licenses.rules()]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect()}
    for i, text in enumerate(texts):
        norm = f" {re.sub(licenses.BETWEEN, ' ', text.lower()).strip()} "
        every = [(priority, m.start(), m.end(), label) for label, priority, pattern in rules for m in pattern.finditer(norm)]
        labels = {d[3] for d in every if not any(e[0] < d[0] and e[1] <= d[1] and e[2] >= d[2] for e in every)}
        labels |= {label for phrase, label in licenses.PHRASES if f" {phrase} " in norm}
        assert labels and got[i] == ",".join(sorted(labels)), text


def test_exchange_finds_planted_classes():
    draw, n = np.random.default_rng(0), 40
    bigrams = np.ones((n + 1, n + 1))
    for i in range(n):
        for j in range(n):
            bigrams[i, j] = draw.poisson(20 if (i % 4 + 1) % 4 == j % 4 else 0.5)
    order = np.append(draw.permutation(n), n)
    of = brown_lm.exchange(bigrams[order][:, order], 4, 10)
    assert all(len({int(order[i] % 4) for i in range(n) if of[i] == c}) == 1 for c in range(4))


def test_language_model_counts_and_scores(spark):
    rows = [(i, f"the cat {'sat' if i % 2 else 'ran'} on mat{i % 7} the dog") for i in range(300)] + [(1000, None), (1001, ""), (None, "the cat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).repartition(3)
    words = lambda t: [*(t or "").lower().encode().split(), b" end"]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    scored = brown_lm.scores(df, seeds=5, classes=3, block=64)
    got = {r.doc_id: r for r in scored.collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        r = got[i]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(text))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(words(text)), sum(counts[w] > 0 for w in words(text)), n)
        assert r.base_score == pytest.approx(base) and r.score <= 0
    assert brown_lm.perplexity(scored)["model"] < brown_lm.perplexity(scored)["base"]
    assert brown_lm.scores(empty(spark)).count() == 0


def test_words_beyond_the_seeds_get_classes(spark):
    """Two planted classes in turn; most words are no seeds."""
    draw = random.Random(7)
    rows = [(i, " ".join(f"{'ab'[k % 2]}{min(draw.randrange(60), draw.randrange(60))}" for k in range(40))) for i in range(600)] + [(1000, "once a1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scored = brown_lm.scores(df, seeds=12, classes=3, block=64)
    found = brown_lm.perplexity(scored)
    assert found["model"] < 0.65 * found["base"]
    names = {brown_lm.tokens(f"{x}{k}".encode())[0]: x for x in "ab" for k in range(60)}
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*brown_lm.tokens(t.encode()).tolist()])
    words = spark.createDataFrame(list(counts.items()), "word long, hits long")
    model, others = brown_lm.learn(df, words, 12, 3, 2)
    got = {r.word: (r.cls, r.hits) for r in others.collect()}
    seeds = dict(zip(model.ids.tolist(), model.seed_class.tolist(), strict=True))
    assert {w: h for w, (_, h) in got.items()} == {w: h for w, h in counts.items() if h >= brown_lm.PLACED and w not in seeds}
    of = {x: {c for w, c in seeds.items() if names.get(w) == x} for x in "ab"}
    assert sum(c in of[names[w]] for w, (c, _) in got.items()) > 0.9 * len(got)
    assert model.in_class.sum() + model.rest_n == model.n and model.rest_v == len(counts) - len(got) - len(seeds)


def test_model_probabilities_add_up(spark):
    bigrams = np.array([[0.0, 5, 2], [3, 1, 1], [2, 2, 4]])
    model = brown_lm.build(np.array([5, 9]), np.array([5.0, 8.0]), bigrams, 20, 6, 2)
    assert np.allclose((10**model.move).sum(1), 1)


def test_media_round_trip_and_sniffing(spark):
    got = {r.doc_id: r for r in media.features(documents(spark)).collect() if r.doc_id not in (0, 3)}
    for i, text in enumerate(TEXTS):
        if i in got:
            data = (text or "").encode()
            payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
            r = got[i]
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
            assert r.media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest() and r.feature.startswith("type=audio/wav;corrected=1")
    assert media.features(empty(spark)).count() == 0


def png():
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(b"\0")) + chunk(b"IEND", b"")


def test_carving_confirms_structure(spark):
    import gzip

    gif = b"GIF89a" + bytes(4) + b"\0\0\0" + b"\x2c" + bytes(9) + b"\x02\x01\x00\x00" + b"\x3b"
    inner = png()
    broken = inner[:-5] + b"xxxxx"
    data = b"junk" + inner + b"more" + gif + b"RIFF\x04\0\0\0WAVE" + broken + gzip.compress(b"hello")
    found = [(f.kind, data[f.start : f.end]) for f in media.sniff(data)]
    assert ("image/png", inner) in found and ("image/gif", gif) in found
    assert [k for k, _ in found].count("image/png") == 1 and any(k == "application/gzip" for k, _ in found)
    df = spark.createDataFrame([(1, bytearray(inner), "image/jpeg"), (2, bytearray(b"text"), "text/plain"), (3, None, None), (4, bytearray(media.to_wav(inner)), "audio/wav")], "doc_id long, media binary, declared string")
    got = {r.doc_id: r for r in media.sniffed(df).collect()}
    assert (got[1].media_type, got[1].corrected) == ("image/png", True)
    assert (got[2].media_type, got[2].corrected, got[3].media_type) == ("text/plain", False, None)
    assert not got[4].corrected and got[4].carved[0].media_type == "image/png" and bytes(got[4].carved[0].media) == inner
