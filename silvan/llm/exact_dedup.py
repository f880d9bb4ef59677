"""Exact duplicates, combined in three steps that each compare whole contents: within a task, within a salted digest
group, and over the salts of a digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop, lean, lookup, texts_of

#: Bytes that normalisation deletes: U+0020 and U+0009 to U+000D.
BLANK = b" \t\n\x0b\x0c\r"
#: Groups into which the copies of one digest are dealt before the last step.
SALTS = 16
#: Bytes of normalised text that a task combines at once.
WINDOW = 64 << 20
DIGEST = 32


def _digest(norm: bytes, size: int) -> bytes:
    return hashlib.sha256(norm).digest()[:size]


def _order(n_cp: Column, doc_id: Column) -> Column:
    """Grows with the code points, then as doc_id falls; a null doc_id comes last."""
    return F.struct(n_cp.alias("n_cp"), F.bitwise_not(doc_id).alias("down"))


def local_groups(docs: DataFrame, salts: int, size: int, window: int) -> DataFrame:
    """First step: equal contents of a task, in windows of bounded size, become one row."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        held: dict[bytes, list] = {}
        room, part = window, 0

        def flush() -> pa.RecordBatch:
            rows = [(_digest(norm, size), part, pack(norm), *found) for norm, found in held.items()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["digest", "salt", "content", "n_cp", "doc_id", "copies"])

        for batch in batches:
            for doc_id, text, n_cp in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                norm = text.translate(None, BLANK)
                found = held.get(norm)
                if found is None:
                    held[norm] = [n_cp, doc_id, 1]
                    room -= len(norm) + 200
                    if room < 0:
                        yield flush()
                        held.clear()
                        room, part = window, (part + 1) % salts
                else:
                    found[2] += 1
                    if n_cp > found[0] or n_cp == found[0] and doc_id is not None and (found[1] is None or doc_id < found[1]):
                        found[:2] = n_cp, doc_id
            if batch.num_rows:
                part = (part + hash(batch.column(0)[0].as_py() or 0)) % salts
        yield flush()

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_cp"))
    return picked.mapInArrow(lean(combine), "digest binary, salt int, content binary, n_cp long, doc_id long, copies long")


def classes(docs: DataFrame, salts: int = SALTS, size: int = DIGEST, window: int = WINDOW) -> DataFrame:
    """One row for each distinct normalised text, checkpointed: digest, keep_id, keep_cp, group_size, rivals (contents that
    share the digest) and, only where there are rivals, the compressed content."""
    best = [F.max("best").alias("best"), F.sum("copies").alias("copies")]
    salted = local_groups(docs, salts, size, window).select("digest", "salt", "content", _order(F.col("n_cp"), F.col("doc_id")).alias("best"), "copies").groupBy("digest", "salt", "content").agg(*best)
    whole = salted.repartition("digest").groupBy("digest", "content").agg(*best)
    rivals = F.count(F.lit(1)).over(Window.partitionBy("digest"))
    return cut(whole.withColumn("rivals", rivals).select("digest", F.bitwise_not("best.down").alias("keep_id"), F.col("best.n_cp").alias("keep_cp"), F.col("copies").alias("group_size"), "rivals", F.when(F.col("rivals") > 1, F.col("content")).alias("content")))


def members(docs: DataFrame, size: int = DIGEST, content: bool = False) -> DataFrame:
    """doc_id, n_cp, digest and text_sha256 of each row, and its compressed content if asked for."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            norms = [text.translate(None, BLANK) for text in texts_of(batch.column(1))]
            columns = [batch.column(0), batch.column(2), pa.array([_digest(n, size) for n in norms], pa.binary()), pa.array([hashlib.sha256(n).hexdigest() for n in norms], pa.string())]
            names = ["doc_id", "n_cp", "digest", "text_sha256"]
            if content:
                columns, names = [*columns, pa.array(map(pack, norms), pa.binary())], [*names, "content"]
            yield pa.RecordBatch.from_arrays(columns, names)

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_cp"))
    return picked.mapInArrow(lean(digests), "doc_id long, n_cp long, digest binary, text_sha256 string" + ", content binary" * content)


def exact_groups(docs: DataFrame, salts: int = SALTS, size: int = DIGEST, window: int = WINDOW) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without blanks; null counts as empty, and empty texts are equal to each
    other. Of equal texts the row with the most code points in its original text stays, then the one with the smallest
    doc_id; a row without doc_id comes behind all that have one. Rows that repeat both doc_id and text are one document:
    if it stays, all of them say so (`deduplicate` returns it once).

    size: bytes of the digest by which contents are dealt. Contents are compared at every step, so that two texts that
    share a digest stay apart; they are told apart by content here too.
    """
    found = classes(docs, salts, size, window)
    clash = found.where("rivals > 1")
    clashes = clash.limit(1).count() > 0
    value = ["keep_id", "keep_cp", "group_size", "rivals"]
    one = found.groupBy("digest").agg(*[F.max(v).alias(v) for v in value[:2]], F.sum("group_size").alias("group_size"), F.max("rivals").alias("rivals")) if clashes else found
    rows = lookup(members(docs, size), one.select("digest", *value), "digest", "group_size")
    kept = (F.col("doc_id").eqNullSafe(F.col("keep_id"))) & (F.col("n_cp") == F.col("keep_cp"))
    out = ["doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"]
    if not clashes:
        return rows.select(*out)
    told = members(docs, size, content=True).join(clash.select("digest", "content", *value[:3]), ["digest", "content"])
    return rows.where("rivals = 1").select(*out).unionByName(told.select(*out))


def keyed(docs: DataFrame, size: int = DIGEST, content: bool = False) -> DataFrame:
    """own_row (all columns of docs), own_id, n_cp and digest of each row, and its compressed content if asked for."""
    at, id_at = docs.columns.index("text"), docs.columns.index("doc_id")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = texts_of(batch.column(at))
            norms = [text.translate(None, BLANK) for text in texts]
            own = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            columns = [own, batch.column(id_at).cast(pa.int64()), pc.utf8_length(pa.array(texts, pa.binary()).cast(pa.string())).cast(pa.int64()), pa.array([_digest(n, size) for n in norms], pa.binary())]
            names = ["own_row", "own_id", "n_cp", "digest"]
            if content:
                columns, names = [*columns, pa.array(map(pack, norms), pa.binary())], [*names, "content"]
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = [T.StructField("own_row", docs.schema), T.StructField("own_id", T.LongType()), T.StructField("n_cp", T.LongType()), T.StructField("digest", T.BinaryType())]
    return docs.mapInArrow(lean(key), T.StructType(fields + [T.StructField("content", T.BinaryType())] * content))


def deduplicate(docs: DataFrame, salts: int = SALTS, size: int = DIGEST, window: int = WINDOW) -> DataFrame:
    """The rows of docs that stay, with all their columns, as exact_groups() says. Of rows that repeat a doc_id and text that stays, one stays.

    Where every doc_id stands on one row, the rows that go are joined by their doc_id: they are fewer than those that stay, which
    are not shuffled while the others are small enough to be broadcast. Else rows meet the class of their own text, never
    others of their doc_id, so rows without doc_id are no group.
    """
    repeated = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().where("count > 1").limit(1).count()
    if not repeated:
        gone = cut(exact_groups(docs, salts, size, window).where("not kept").select(F.col("doc_id").alias("gone_doc")))
        return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("gone_doc")), "left_anti")
    found = classes(docs.select("doc_id", "text"), salts, size, window)
    many = cut(found.where("group_size > 1 or rivals > 1"))
    drop(found)
    value = ["keep_id", "keep_cp", "group_size"]
    clash = many.where("rivals > 1")
    clashes = clash.limit(1).count() > 0
    rows = keyed(docs, size, clashes)
    if clashes:
        told = rows.join(clash.select("digest", "content", *value), ["digest", "content"])
        rows = rows.join(clash.select("digest").distinct(), "digest", "left_anti").drop("content")
        rows = lookup(rows, cut(many.where("rivals = 1").select("digest", *value)), "digest", "group_size").unionByName(told.drop("content"))
    else:
        rows = lookup(rows, many.select("digest", *value), "digest", "group_size")
    alone = F.col("keep_cp").isNull()
    rows = rows.where(alone | F.col("own_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp")))
    rows = _one_each(cut(rows.select("own_row", "digest", alone.alias("alone"))), clashes)
    return rows.select(*[F.col("own_row")[n].alias(n) for n in docs.columns])


def _one_each(rows: DataFrame, clashes: bool) -> DataFrame:
    """For tables in which a doc_id repeats: each row that stays once, by its text."""
    text = [F.col("digest")] if not clashes else [F.col("digest"), F.sha2(F.regexp_replace(F.coalesce(F.col("own_row.text"), F.lit("")), r"[\x20\x09-\x0D]+", ""), 256)]
    once = rows.where("not alone").groupBy(*text).agg(F.first("own_row").alias("own_row"))
    return rows.where("alone").select("own_row").union(once.select("own_row"))
