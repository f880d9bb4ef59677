"""Class-based bigram model (Brown et al.): words belong to classes; a class follows a class, and emits a word.

Counts of all words come from the whole corpus. Exchange clustering gives the words of a bounded seed vocabulary their
classes, by the counts of their bigrams over the whole corpus. Every other word with PLACED training occurrences or more
joins the class that the classes around it speak for, in a distributed pass; only rarer words make up one more class, in
which they are told apart by their counts. Class bigrams and emissions are then counted over all of them. The table of all words grows with the corpus and is never broadcast: every block of
documents meets the entries of its own words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom, cut, drop_since, in_bloom, matched, text_fold, texts_of, written

FOLDS, HELD = 7, 2
#: Most frequent words, which exchange clustering classifies; classes for them; sweeps over the seed vocabulary.
SEEDS, CLASSES, SWEEPS = 600, 40, 6
#: Training occurrences that a word beyond the seeds needs for a class of its neighbours' choice.
PLACED = 5
#: Tokens whose contexts a task combines at once, and one entry of them: class (of the word before, or, further on, behind) and count.
CONTEXTS, ENTRY = 1 << 20, np.dtype([("place", "<u2"), ("hits", "<u4")])
#: Documents to a block, at most, and the bytes up to which a text takes one place in it; texts of twice the bytes are half as many to a block.
BLOCK, SHORT = 4096, 32_768
#: Tokens that a task holds while it counts the words of its blocks.
HELD_TOKENS = 1 << 22
#: Tokens of several texts that a task looks up together.
AT_ONCE = 1 << 17
#: The end of a document is a token too, which no word equals.
END = xxhash.xxh64_intdigest(b" end") - (1 << 63)
#: Weight of the class frequencies in the smoothing of class transitions.
ALPHA = 5.0
_CACHE = 800_000
LINE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("mass", pa.float64()), ("line", pa.binary())])


class _Tokens(dict):
    """Signed 64-bit hashes of words; starts anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word) - (1 << 63)
        return got


_tokens = _Tokens()


def tokens(text: bytes) -> np.ndarray:
    """Hashes of a text's words, with A-Z lower-cased, and of its end."""
    words = text.lower().split()
    return np.append(np.fromiter(map(_tokens.__getitem__, words), np.int64, len(words)), np.int64(END))


def sequences(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text behind the last one, tokens, numbers of tokens) of texts, some AT_ONCE tokens together."""
    held, first, many = [], 0, 0
    for i, text in enumerate(texts):
        held.append(tokens(text))
        many += len(held[-1])
        if many >= AT_ONCE or i + 1 == len(texts):
            yield first, i + 1, np.concatenate(held), np.fromiter(map(len, held), np.int64, len(held))
            held, first, many = [], i + 1, 0


def neighbours(cls: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class before, class behind) of each token of sequences that follow each other; a sequence's end stands before its beginning."""
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    before, behind = np.roll(cls, 1), np.roll(cls, -1)
    before[starts], behind[ends] = cls[ends], cls[starts]
    return before, behind


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each symbol but the last, which keeps class `classes` for itself.

    bigrams[i, j] counts symbol j behind symbol i. Symbols come by falling frequency and start in classes dealt in turn.
    Then each moves in turn to the class that raises the likelihood of the class bigrams most, until a sweep moves none.
    """
    n = len(bigrams) - 1
    of = np.append(np.arange(n) % classes, classes)
    member = np.zeros((n + 1, classes + 1))
    member[np.arange(n + 1), of] = 1
    joint = member.T @ bigrams @ member
    log = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            old = of[w]
            after, before, own = bigrams[w] @ member, bigrams[:, w] @ member, bigrams[w, w]
            after[old] -= own
            before[old] -= own
            joint[old, :] -= after
            joint[:, old] -= before
            joint[old, old] -= own
            # the word's neighbours count it in their own rows and columns, whichever class it joins
            rows, cols, corner = joint.sum(1) + before, joint.sum(0) + after, np.diag(joint)
            gain = (log(joint + after) - log(joint)).sum(1) + (log(joint.T + before) - log(joint.T)).sum(1)
            gain += log(corner + after + before + own) - log(corner + after) - log(corner + before) + log(corner)
            gain -= log(rows + after.sum() + own) - log(rows) + log(cols + before.sum() + own) - log(cols)
            gain[classes] = -np.inf
            new = int(np.argmax(gain)) if gain.max() > gain[old] + 1e-9 else old
            joint[new, :] += after
            joint[:, new] += before
            joint[new, new] += own
            if new != old:
                member[w, old], member[w, new], of[w] = 0, 1, new
                moved += 1
        if not moved:
            break
    return of


@dataclass
class Model:
    """ids: sorted hashes of the seeds; seed_class: their classes; joint[a, b]: how often class b stands behind a; move[a, b]: log10 P(b behind a);
    n: training tokens; v: distinct ones; in_class: tokens of each class; rest_n, rest_v: tokens and distinct words without a class, which the last class is for."""

    ids: np.ndarray
    seed_class: np.ndarray
    joint: np.ndarray
    move: np.ndarray
    n: int
    v: int
    in_class: np.ndarray
    rest_n: int
    rest_v: int


def blocks(docs: DataFrame, rows: int) -> DataFrame:
    """docs (doc_id, text) with the block that each row belongs to: rows of a file that follow each other and are alike in length,
    `rows` of them at most, and at most `rows` * SHORT bytes or one text.

    A row's file and place in it are the same however often, and in whatever splits, the file is read. A frame that isn't
    read from files is written to the shared folder first.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = cut(docs.select("doc_id", "text"))
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0))
    kind = F.when(size > SHORT, F.ceil(F.log2(size / SHORT))).otherwise(0).cast("int")
    many = F.greatest(F.lit(1), F.floor(F.lit(rows) / F.pow(F.lit(2.0), kind))).cast("long")
    block = F.xxhash64("_metadata.file_path", kind, F.floor(F.col("_metadata.row_index") / many))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), block.alias("block"), kind.alias("kind"))


def block_words(rows: DataFrame, held: int) -> DataFrame:
    """(block, word, hits): how often each word stands in the training documents of a block, 0 if only in held-out ones.

    Combined where the block is read; a block that lies in two splits, or has very many tokens, has several rows for a word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[int, list, list]] = {}
        many = 0

        def done(kind: int) -> pa.RecordBatch:
            block, words, training = open_.pop(kind)
            word, place = np.unique(np.concatenate(words), return_inverse=True)
            hits = np.bincount(place, np.repeat(training, list(map(len, words))), len(word)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(word), block)), pa.array(word), pa.array(hits)], ["block", "word", "hits"])

        for batch in batches:
            for doc_id, text, block, kind in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if many >= HELD_TOKENS:
                    many = 0
                    for other in list(open_):
                        yield done(other)
                elif kind in open_ and open_[kind][0] != block:
                    many -= sum(map(len, open_[kind][1]))
                    yield done(kind)
                _, words, training = open_.setdefault(kind, (block, [], []))
                words.append(tokens(text))
                training.append(float(text_fold(doc_id, FOLDS) != held))
                many += len(words[-1])
        for kind in list(open_):
            yield done(kind)

    return rows.select("doc_id", "text", "block", "kind").mapInArrow(count, "block long, word long, hits long")


def seed_bigrams(docs: DataFrame, ids: np.ndarray, held: int) -> np.ndarray:
    """Counts of (symbol, next symbol) over all training documents; symbols are the seeds and, last, all other words.

    A document's first token follows its end token. The table's size is that of the seed vocabulary squared.
    """
    size, sorter = len(ids) + 1, np.argsort(ids)
    ranked = ids[sorter]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            sets = [tokens(t) for i, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True) if text_fold(i, FOLDS) != held]
            if sets:
                symbol = symbols(np.concatenate([np.array([END]), *sets]), ranked, sorter, size - 1)
                total += np.bincount(symbol[:-1] * size + symbol[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["pair", "hits"])

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "pair long, hits long").groupBy("pair").agg(F.sum("hits").alias("hits")).toArrow()
    out = np.zeros(size * size)
    out[counted["pair"].to_numpy()] = counted["hits"].to_numpy()
    return out.reshape(size, size)


def symbols(word: np.ndarray, ranked: np.ndarray, sorter: np.ndarray, other: int) -> np.ndarray:
    """Index of each word among the seeds, or `other`."""
    if not len(ranked):
        return np.full(len(word), other)
    at = np.minimum(np.searchsorted(ranked, word), len(ranked) - 1)
    return np.where(ranked[at] == word, sorter[at], other)


def transitions(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 P(b behind a), log10 P(b)) by counts of class bigrams, smoothed."""
    mass = joint.sum(0) + 1
    return np.log10((joint + ALPHA * mass / mass.sum()) / (joint.sum(1, keepdims=True) + ALPHA)), np.log10(mass / mass.sum())


def build(ids: np.ndarray, hits: np.ndarray, bigrams: np.ndarray, n: int, v: int, classes: int = CLASSES) -> Model:
    """The model of the seeds alone."""
    classes = max(1, min(classes, len(ids)))
    of = exchange(bigrams, classes)
    member = np.zeros((len(of), classes + 1))
    member[np.arange(len(of)), of] = 1
    joint = member.T @ bigrams @ member
    sorter = np.argsort(ids)
    return Model(ids[sorter], of[:-1][sorter], joint, transitions(joint)[0], n, v, np.bincount(of[:-1], hits, classes), n - int(hits.sum()), v - len(ids))


def classes_of(word: np.ndarray, model: Model) -> np.ndarray:
    """Class of each word among the seeds, and the last class for others."""
    return np.append(model.seed_class, len(model.joint) - 1)[symbols(word, model.ids, np.arange(len(model.ids)), len(model.ids))]


def contexts(docs: DataFrame, model: Model, held: int, wanted: np.ndarray | None) -> DataFrame:
    """(word, body): the classes of the seeds' model that words beyond the seeds stand behind and before in training documents, as
    entries with counts. Combined where documents are read; a word has as many rows as there are tasks' portions with it. Only
    words of the Bloom filter `wanted`, if there is one."""
    size = len(model.joint)
    handle = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, before, behind, many = [], [], [], 0

        def done() -> pa.RecordBatch:
            word, at = np.unique(np.concatenate(words), return_inverse=True)
            code, hits = np.unique(np.concatenate([at * 2 * size + np.concatenate(before), at * 2 * size + size + np.concatenate(behind)]), return_counts=True)
            body = np.empty(len(code), ENTRY)
            body["place"], body["hits"] = code % (2 * size), hits
            ends = np.searchsorted(code, np.arange(len(word) + 1) * 2 * size) * ENTRY.itemsize
            bodies = pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(word), bodies], ["word", "body"])

        for batch in batches:
            training = [text for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True) if text_fold(doc_id, FOLDS) != held]
            for _, _, word, lengths in sequences(training):
                cls = classes_of(word, model)
                beyond = cls == size - 1
                if handle.value is not None:
                    beyond[beyond] = in_bloom(handle.value, word[beyond])
                left, right = neighbours(cls, lengths)
                words.append(word[beyond])
                before.append(left[beyond])
                behind.append(right[beyond])
                many += len(words[-1])
                if many >= CONTEXTS:
                    yield done()
                    words, before, behind, many = [], [], [], 0
        if many:
            yield done()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "word long, body binary")


def placed(docs: DataFrame, model: Model, held: int, wanted: np.ndarray | None = None, least: int = PLACED) -> DataFrame:
    """(word, cls, hits) of all words beyond the seeds with `least` training occurrences or more: the class whose bigrams with
    the classes around the word's occurrences are most above chance. Each task holds the words of one batch."""
    size = len(model.joint)
    move, alone = transitions(model.joint)
    gain = np.concatenate([move - alone, (move - alone).T])[:, : size - 1]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, entries = np.zeros(0, np.int64), np.zeros(0, ENTRY)

        def done(word: np.ndarray, entry: np.ndarray) -> pa.RecordBatch:
            word, at = np.unique(word, return_inverse=True)
            found = np.bincount(at * 2 * size + entry["place"], entry["hits"], len(word) * 2 * size).reshape(-1, 2 * size)
            hits = found[:, :size].sum(1)
            some = hits >= least
            cls = (found[some] @ gain).argmax(1)
            return pa.RecordBatch.from_arrays([pa.array(word[some]), pa.array(cls.astype(np.int32)), pa.array(hits[some].astype(np.int64))], ["word", "cls", "hits"])

        for batch in batches:
            bodies = batch.column(1).to_pylist()
            words = np.concatenate([words, np.repeat(batch.column(0).to_numpy(), [len(b) // ENTRY.itemsize for b in bodies])])
            entries = np.concatenate([entries, np.frombuffer(b"".join(bodies), ENTRY)])
            if len(words):  # the last word may go on in the next batch
                ready = words != words[-1]
                yield done(words[ready], entries[ready])
                words, entries = words[~ready], entries[~ready]
        if len(words):
            yield done(words, entries)

    return contexts(docs, model, held, wanted).repartition("word").sortWithinPartitions("word").mapInArrow(choose, "word long, cls int, hits long")


def class_bigrams(lines: DataFrame, size: int, kind: np.dtype) -> np.ndarray:
    """Counts of (class, next class) over rows of class sequences; a sequence's end stands before its beginning."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                cls = np.frombuffer(b"".join(lines), kind).astype(np.int64)
                before, _ = neighbours(cls, np.fromiter(map(len, lines), np.int64, len(lines)) // kind.itemsize)
                total += np.bincount(before * size + cls, minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["pair", "hits"])

    counted = lines.select("line").mapInArrow(count, "pair long, hits long").groupBy("pair").agg(F.sum("hits").alias("hits")).toArrow()
    out = np.zeros(size * size)
    out[counted["pair"].to_numpy()] = counted["hits"].to_numpy()
    return out.reshape(size, size)


def learn(docs: DataFrame, words: DataFrame, seeds: int, classes: int, held: int) -> tuple[Model, DataFrame]:
    """The seeds' model, with the tokens of all classes, and the words that are placed (word, cls, hits)."""
    totals = words.agg(F.sum("hits").alias("n"), F.count(F.when(F.col("hits") > 0, 1)).alias("v")).first()
    top = words.where("hits > 0").orderBy(F.desc("hits"), "word").limit(seeds).collect()
    ids, hits = np.array([r.word for r in top], np.int64), np.array([r.hits for r in top], np.float64)
    model = build(ids, hits, seed_bigrams(docs, ids, held), totals.n or 0, totals.v or 0, classes)
    others = cut(placed(docs, model, held, bloom(words.where(F.col("hits") >= PLACED).select("word"))))
    for row in others.groupBy("cls").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("words")).collect():
        model.in_class[row.cls] += row.hits
        model.rest_n -= row.hits
        model.rest_v -= row.words
    return model, others


def scores(docs: DataFrame, seeds: int = SEEDS, classes: int = CLASSES, held: int = HELD, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id as text) mod FOLDS is not `held`. A null text counts as empty: one token, the end.
    Repeated rows count and are scored each on their own. Without any training row all counts are 0 and every word
    is beyond the seeds. Words are told apart by 64-bit digests.
    """
    before = written()
    rows = blocks(docs, block)
    table = cut(block_words(rows, held))
    words = cut(table.groupBy("word").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("blocks")))
    model, others = learn(docs, words, seeds, classes, held)
    size = len(model.joint)
    kind = np.min_scalar_type(size)

    def line(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        word, at = np.unique(known["word"].to_numpy(), return_index=True)
        hits, cls = known["hits"].to_numpy()[at], known["cls"].to_numpy()[at]
        cls = np.where(cls >= 0, cls, classes_of(word, model))
        base, own = np.log10((hits + 1) / (model.n + model.v + 1)), np.log10(np.where(cls < size - 1, hits, hits + 1))
        ids, bodies, out = texts["doc_id"].to_pylist(), texts_of(texts["text"]), []
        for first, last, found, lengths in sequences(bodies):
            at = np.searchsorted(word, found)
            ends = np.cumsum(lengths)
            starts, own_cls = ends - lengths, cls[at].astype(kind)
            sums = [np.add.reduceat(x, starts).tolist() for x in ((hits[at] > 0).astype(np.int64), base[at], own[at])]
            lines = [own_cls[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            out += zip(ids[first:last], [text_fold(i, FOLDS) == held for i in ids[first:last]], lengths.tolist(), *sums, lines, strict=True)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * 7, LINE, strict=True)], schema=LINE)

    # every word of the table has its total; classes of the seeds come from the model itself
    known = cut(words.join(others.select("word", "cls"), "word", "left").select("word", "hits", F.coalesce("cls", F.lit(-1)).alias("cls"), "blocks"))
    table = matched(table.select("block", "word"), known, "word", "blocks").select("block", "word", "hits", "cls")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, mass double, line binary"
    lines = cut(rows.select("doc_id", "text", "block").groupBy("block").cogroup(table.groupBy("block")).applyInArrow(line, schema))
    drop_since(before, lines)
    move = transitions(class_bigrams(lines.where("not held_out"), size, kind))[0]
    share = np.log10(np.append(np.maximum(model.in_class, 1), model.rest_n + model.rest_v + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mass, lines, out = batch.column(5).to_numpy(), batch.column(6).to_pylist(), np.zeros(0)
            if lines:
                lengths = np.fromiter(map(len, lines), np.int64, len(lines)) // kind.itemsize
                cls = np.frombuffer(b"".join(lines), kind).astype(np.int64)
                before, _ = neighbours(cls, lengths)
                out = mass + np.add.reduceat(move[before, cls] - share[cls], np.cumsum(lengths) - lengths)
            train = pa.array(np.full(len(batch), model.n, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], train, batch.column(4), pa.array(out, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return lines.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scored: DataFrame) -> dict[str, float]:
    """Perplexity of the model and of the base over the held-out documents."""
    row = scored.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    return {"model": 10 ** (-row.s / row.n), "base": 10 ** (-row.b / row.n)} if row.n else {"model": math.nan, "base": math.nan}


def class_members(model: Model, names: dict[int, str]) -> dict[int, Counter]:
    """The seeds of each class by name, for inspection."""
    out: dict[int, Counter] = {}
    for i, c in zip(model.ids.tolist(), model.seed_class.tolist(), strict=True):
        out.setdefault(c, Counter())[names.get(i, str(i))] += 1
    return out
