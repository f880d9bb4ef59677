"""Similarity join on sets of word n-grams, by multi-match prefixes of adaptive length.

All sets are put in one order of shingles, rare ones first. Two sets that are similar enough share at least l shingles
among the first (size - least overlap + l) of each, for every l. A document takes the l whose candidates cost least by
estimate: a longer prefix meets more documents, of which more shared shingles are then asked before verification. A
pair needs the smaller l of its two documents.

What is asked for are components, so pairs that are already connected need no verification. A document is first
verified against a centre: a member of its prefix lists that has most company in theirs. Then short lists give the pairs
of different components that share enough of their prefixes. A long list gives no pairs. Its members are told apart by
how they differ from what most of them have in common (consensus): two sets differ by what their differences from a third
one differ by. Sets that differ little enough are connected by that alone; any other two that link must share part of their
differences, so a prefix of the differences (difference_lists) is listed in place of the prefix of the sets, and these
lists are treated likewise. In a family of near copies of one text the differences are small and mostly one's own, so a
family costs about its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bloom, cut, drop, drop_since, in_bloom, lean, lookup, matched, texts_of, written
from .graph import components

WORDS = 4
#: Two sets link when OF * intersection >= NEED * union.
NEED, OF = 85, 100
#: Greatest l, and what verifying a pair costs in units of reading one entry of a prefix list.
MATCHES, VERIFY = 4, 20.0
#: Buckets of the frequencies by which shingles are put in order: a power of two that grows with the documents up to the last one.
BUCKETS = (16, 22)
SLICE = 1 << 14
#: Members of a list whose pairs are listed, at most; longer lists go by differences from their centre, ROUNDS times over, and what is
#: left of them then by all pairs.
SHORT, ROUNDS = 48, 4
#: Members of a group whose texts make up its consensus, about. Any third set serves; one that members are near to serves best.
SAMPLED = 32
#: Pairs that one copy of a text serves in a join, about; a text of more pairs is dealt out in several copies.
SERVED = 500
#: Tables that a task adds up at once.
FAN_IN = 128
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_CACHE = 300_000


class _Words(dict):
    """64-bit hashes of words; starts anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


_words = _Words()


def forget() -> None:
    """Empties this worker's cache. A function of the module: kernels travel with copies of the values that they name themselves."""
    _words.clear()


def hashed(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words."""
    words = text.lower().split()  # of bytes: A-Z only, and the six blanks of ASCII
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    """The set of hashes of WORDS words in a row, sorted; fewer words are one shingle as a whole."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, WORDS)
    total = words[: n - k + 1] * _MIX[0] + np.uint64(k)
    for j in range(1, k):
        total = (total ^ (total >> np.uint64(31))) * _MIX[4] + words[j : n - k + 1 + j] * _MIX[j]
    total ^= total >> np.uint64(29)
    return np.unique(total * _MIX[4])


def overlap(n: int) -> int:
    """Least intersection of a set of n with any set that it links with."""
    return -(-NEED * n // OF)


def alone(n: int) -> bool:
    """Whether a set of n links with equal ones only: it lacks too much even of one that has a single shingle more."""
    return OF * n < NEED * (n + 1)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if OF * min(len(a), len(b)) < NEED * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return OF * both >= NEED * (len(a) + len(b) - both)


def bucket_counts(docs: DataFrame, bits: int, tasks: int) -> np.ndarray:
    """How many documents have a shingle of each bucket (a shingle's top bits): 2 ** bits numbers, whatever the data.

    Tasks (there are about `tasks`) send compressed slices, which are added up FAN_IN at a time.
    """
    width = min(SLICE, 1 << bits)
    packed = lambda total: zstandard.ZstdCompressor(level=1).compress(total.tobytes())
    opened = lambda body: np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, room = np.zeros(1 << bits, np.int64), [], 1 << bits
        for batch in batches:
            for text in texts_of(batch.column(0)):
                waiting.append((shingles(hashed(text)) >> np.uint64(64 - bits)).astype(np.int32))
                room -= len(waiting[-1]) + 1
                if room < 0:  # as many as the table has buckets, so that adding them up takes time in proportion to them
                    total += np.bincount(np.concatenate(waiting), minlength=1 << bits)
                    waiting, room = [], 1 << bits
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=1 << bits)
        forget()
        used = [i for i in range(len(total) // width) if total[i * width : (i + 1) * width].any()]
        for i in used:
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([packed(total[i * width : (i + 1) * width])], pa.binary())], ["part", "counts"])

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for body in parts["counts"]:
            total += opened(body.as_py())
        return pa.table({"part": parts["part"][:1], "counts": pa.array([packed(total)], pa.binary())})

    counted = docs.select(F.col("text").cast("string")).mapInArrow(lean(count), "part long, counts binary")
    counted = counted.withColumn("sender", F.spark_partition_id())
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        counted = counted.withColumn("sender", F.floor(F.col("sender") / FAN_IN))
        counted = counted.groupBy("part", "sender").applyInArrow(lambda key, parts: add(key, parts).append_column("sender", parts["sender"][:1]), "part long, counts binary, sender long")
    out = np.zeros(1 << bits, np.int64)
    for row in counted.groupBy("part").applyInArrow(add, "part long, counts binary").collect():
        out[row.part * width : (row.part + 1) * width] = opened(row.counts)
    return np.minimum(out, (1 << 31) - 1).astype(np.int32)


def frequencies(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return counts[(items >> np.uint64(64 - (len(counts).bit_length() - 1))).astype(np.int64)]


def prefix(items: np.ndarray, counts: np.ndarray, base: float) -> tuple[np.ndarray, int]:
    """(prefix, l) of a set. base: what a bucket holds by chance; only what is beyond it is expected to be met again."""
    n = len(items)
    frequency = frequencies(items, counts)
    longest = min(n, n - overlap(n) + MATCHES)
    order = np.lexsort((items, frequency))[:longest]
    met = np.cumsum(np.maximum(frequency[order] - base, 0.0))
    cost = [met[n - overlap(n) + m - 1] * (1 + VERIFY / m) for m in range(1, MATCHES + 1) if n - overlap(n) + m <= longest]
    best = int(np.argmin(cost)) + 1
    return items[order[: n - overlap(n) + best]], best


def difference_order(own: np.ndarray, third: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """(order, d): the first elements of a set's difference from a third set (what one of the two has and the other hasn't), rare ones
    first and those that the third set has last, as most others lack few of them; and the size of the whole difference.

    As many elements as any prefix of it needs: see difference_lists.
    """
    difference = np.setxor1d(own, third, assume_unique=True)
    lacking = third[np.minimum(np.searchsorted(third, difference), len(third) - 1)] == difference if len(third) else np.zeros(len(difference), bool)
    return difference[np.lexsort((difference, frequencies(difference, counts), lacking))][: (OF - NEED) * len(own) // NEED + 1], len(difference)


def prefixes(docs: DataFrame, handle: Broadcast) -> DataFrame:
    """doc_id, n, sig (digest of the set; null for the empty one), matches (l) and prefix; of equal sets in a task only the first with a doc_id has a prefix.

    Sets that link with equal ones only (below 6 shingles) have no prefix: their digests tell those.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = handle.value
        base, seen = float(table.mean()), set()
        for batch in batches:
            n, sigs, matches, heads = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                items = shingles(hashed(text))
                sig = hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None
                n.append(len(items))
                sigs.append(sig)
                if doc_id is None or alone(len(items)) or sig in seen:
                    matches.append(None)
                    heads.append(None)
                    continue
                if len(seen) >= _CACHE:
                    seen.clear()
                seen.add(sig)
                head, best = prefix(items, table, base)
                matches.append(best)
                heads.append(head.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(matches, pa.int32()), pa.array(heads, pa.list_(pa.int64()))], ["doc_id", "n", "sig", "matches", "prefix"])
        forget()  # the worker may go on to another operator

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(measure), "doc_id long, n long, sig binary, matches int, prefix array<long>")


def texts_for(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, body) of the documents whose doc_id is in ids (id), checkpointed. Texts travel compressed; a Bloom filter keeps nearly all others at their source."""
    ids = cut(ids.distinct())
    marks = docs.sparkSession.sparkContext.broadcast(bloom(ids))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, pack = marks.value, zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            if flags is not None:
                batch = batch.filter(pa.array(in_bloom(flags, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(pack, texts_of(batch.column(1))), pa.binary())], ["id", "body"])

    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(pick), "id long, body binary")
    out = cut(texts.join(ids, "id", "left_semi").dropDuplicates(["id"]))
    drop(ids)
    return out


class Sets(dict):
    """Sets of shingles by id, made from compressed texts; holds a few."""

    def __init__(self):
        self.read = zstandard.ZstdDecompressor().decompress

    def of(self, key: int, body: bytes) -> np.ndarray:
        got = self.get(key)
        if got is None:
            if len(self) >= 64:
                self.clear()
            got = self[key] = shingles(hashed(self.read(body)))
        return got


def dealt(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs (a, b) JOIN left (a, ..) JOIN right (b, ..). A row of right that many pairs ask for is dealt out in copies, so its pairs
    spread over tasks; pairs are told their copies before anything wide joins them."""
    copies = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SERVED).cast("int").alias("copies"))
    given = right.join(copies, "b").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    told = pairs.join(copies, "b").withColumn("turn", F.pmod(F.hash("a"), F.col("copies"))).drop("copies")
    return told.join(left, "a").join(given, ["b", "turn"])


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of documents of texts whose sets link, checkpointed."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for batch in batches:
            a, b, body_a, body_b = (batch.column(i).to_pylist() for i in range(4))
            yes = [linked(sets.of(x, s), sets.of(y, t)) for x, y, s, t in zip(a, b, body_a, body_b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(yes, pa.bool_()))
        forget()

    both = dealt(pairs, *[texts.select(F.col("id").alias(side), F.col("body").alias(f"body_{side}")) for side in "ab"])
    return cut(both.select("a", "b", "body_a", "body_b").mapInArrow(lean(compare), "a long, b long"))


def consensus(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(b, items): what most members a of each group b have, by a sample of about SAMPLED of them. members: (a, b)."""
    sizes = members.groupBy("b").agg(F.count(F.lit(1)).alias("members"))
    some = members.join(sizes, "b").where(F.pmod(F.xxhash64("a", "b"), F.col("members")) < SAMPLED).select("a", "b")

    def common(key: tuple, rows: pa.Table) -> pa.Table:
        sets, pack = Sets(), zstandard.ZstdCompressor(level=1).compress
        found, times = np.unique(np.concatenate([sets.of(a, body) for a, body in zip(rows["a"].to_pylist(), rows["body"].to_pylist(), strict=True)]), return_counts=True)
        forget()
        return pa.table({"b": pa.array([key[0].as_py()], pa.int64()), "items": pa.array([pack(found[2 * times > rows.num_rows].tobytes())], pa.binary())})

    bodies = some.join(texts.select(F.col("id").alias("a"), "body"), "a")
    return cut(bodies.select("a", "b", "body").groupBy("b").applyInArrow(common, "b long, items binary"))


def differences(texts: DataFrame, members: DataFrame, handle: Broadcast) -> DataFrame:
    """(rep, b, n, d, elements) of the members (a, b) of groups, checkpointed: size of the set, of its difference from the group's
    consensus, and the difference's first elements (difference_order)."""
    third = consensus(texts, members)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, read, counts, last, held = Sets(), zstandard.ZstdDecompressor().decompress, handle.value, None, None
        for batch in batches:
            rows = []
            for a, b, body, items in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b != last:
                    last, held = b, np.frombuffer(read(items), np.uint64)
                own = sets.of(a, body)
                elements, d = difference_order(own, held, counts)
                rows.append((a, b, len(own), d, elements.view(np.int64)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["rep", "b", "n", "d", "elements"])
        forget()

    # a group of whose members none was drawn has nothing in common
    nothing = F.lit(zstandard.ZstdCompressor(level=1).compress(b""))
    every = members.select("b").distinct().join(third, "b", "left").select("b", F.coalesce("items", nothing).alias("items"))
    out = cut(dealt(members, texts.select(F.col("id").alias("a"), "body"), every).select("a", "b", "body", "items").mapInArrow(lean(compare), "rep long, b long, n long, d long, elements array<long>"))
    drop(third)
    return out


def shared_lists(entries: DataFrame) -> DataFrame:
    """The entries (ENTRY) of lists of several members, checkpointed, with the number of members."""
    sizes = cut(entries.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    out = cut(matched(entries, sizes, "key", "members"))
    drop(sizes)
    return out


def with_centres(lists: DataFrame) -> DataFrame:
    """The entries of lists, checkpointed, with the list's centre: the member that has most company in all its lists; centre_n is the
    size of its set."""
    company = lists.groupBy(F.col("rep").alias("company_rep")).agg(F.sum("members").alias("company"))
    known = lists.join(company, F.col("rep") == F.col("company_rep"))
    first = F.max(F.struct("company", F.bitwise_not("rep").alias("low"), "n"))
    centres = cut(known.groupBy("key", "members").agg(first.alias("first")).select("key", "members", F.bitwise_not("first.low").alias("centre"), F.col("first.n").alias("centre_n")))
    out = cut(matched(lists.drop("members"), centres, "key", "members"))
    drop(centres)
    return out


def _near(n_a: Column, n_b: Column) -> Column:
    return OF * F.least(n_a, n_b) >= NEED * F.greatest(n_a, n_b)


def _meet(x: Column, y: Column) -> Column:
    """Entries that may be a pair: of different components, near in size, of kinds that meet (0: linked with the centre
    before; 1: not linked; 2: not linked, and in the tail)."""
    kinds = (F.least(x["kind"], y["kind"]) + F.greatest(x["kind"], y["kind"]) * 3).isin(3, 4, 6)
    return kinds & (x["component"] != y["component"]) & _near(x["n"], y["n"])


def _pair(x: Column, y: Column) -> Column:
    """A pair in order, and how many entries it must share: as the prefixes say, or, of differences, what they must share in all
    (which follows from their rooms) without what may lie behind their prefixes."""
    far = lambda own, other: F.when(other["kind"] == 0, own["behind_tail"]).otherwise(own["behind_head"])
    most = F.least(far(x, y), far(y, x))
    need = F.when(x["room"].isNull(), F.least(x["matches"], y["matches"])).otherwise(F.ceil((-x["room"] - y["room"]) / (2 * (OF + NEED))) - most)
    return F.struct(F.least(x["rep"], y["rep"]).alias("a"), F.greatest(x["rep"], y["rep"]).alias("b"), need.cast("long").alias("need"))


#: Columns of an entry: its list; its set and the set's size; of prefix lists, shared entries that the set asks for; of lists of
#: differences, its kind (see _meet), the set's room, and elements of the difference behind its head and its tail.
ENTRY = ("key", "rep", "n", "matches", "kind", "room", "behind_head", "behind_tail")


def short_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of entries, with their components, of lists of at most SHORT members that share as many as they need.

    Pairs that meet in a long list too may share fewer here: the long list is answerable for them.
    """
    bodies = lists.groupBy("key").agg(F.collect_list(F.struct(*ENTRY[1:], "component")).alias("members"))
    after = lambda x, i: F.filter(F.slice("members", i + 2, SHORT), lambda y: _meet(x, y))
    pairs = bodies.select(F.explode(F.flatten(F.transform("members", lambda x, i: F.transform(after(x, i), lambda y: _pair(x, y))))).alias("pair"))
    counted = pairs.groupBy("pair.a", "pair.b").agg(F.count(F.lit(1)).alias("shared"), F.min("pair.need").alias("need"))
    return counted.where("shared >= need").select("a", "b")


def all_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of entries of lists of any length; each list is dealt into blocks, and every two blocks of it meet in a task."""
    blocks = F.ceil(F.col("members") / SHORT).cast("int")
    held = lists.withColumn("own", F.pmod(F.hash("rep"), blocks)).withColumn("every", F.sequence(F.lit(0), blocks - 1))
    entry = F.struct(*ENTRY[1:], "component")
    # block i meets block j >= i as (i, j): each entry stands once for itself in every pair of blocks that its own is in
    left = held.select("key", "own", F.explode("every").alias("other"), entry.alias("x")).where("own <= other")
    right = held.select(F.col("key").alias("key_y"), F.explode("every").alias("first"), F.col("own").alias("last"), entry.alias("y")).where("first <= last")
    met = left.join(right, (F.col("key") == F.col("key_y")) & (F.col("own") == F.col("first")) & (F.col("other") == F.col("last")))
    met = met.where((F.col("own") != F.col("other")) | (F.col("x.rep") < F.col("y.rep"))).where(_meet(F.col("x"), F.col("y")))
    return met.select(_pair(F.col("x"), F.col("y")).alias("pair")).select("pair.a", "pair.b").distinct()


def with_components(entries: DataFrame, found: DataFrame) -> DataFrame:
    joined = entries.join(found, F.col("rep") == F.col("node"), "left")
    return joined.select(*entries.columns, F.coalesce("component", "rep").alias("component"))


def with_prefixes(members: DataFrame) -> DataFrame:
    """members (rep, b, n, d, elements) with room, leader, near, and the lengths head and tail of two prefixes of the difference D.

    Two sets x and y that link, and are not both near, meet in an element of their prefixes: in one of both heads, or, if
    only x is near, in one of x's head and y's tail (which includes its head). Sets that are near link with the leader.

    With P = OF + NEED and Q = OF - NEED, x and y link if and only if P |Dx ^ Dy| <= Q (|x| + |y|), and |Dx ^ Dy| is
    |Dx| + |Dy| - 2 |Dx & Dy|. With room(x) = Q |x| - P |Dx|, they link if and only if 2 P |Dx & Dy| >= -room(x) - room(y).
    The leader has the most room; x is near if room(x) + room(leader) >= 0, so it links with the leader, whatever they share.
    Otherwise |Dx & Dy| is bounded from below in three ways:
    (1) where y isn't near, room(y) <= -room(leader) - 1, so 2 P |Dx & Dy| >= room(leader) + 1 - room(x);
    (2) |Dx & Dy| >= |Dx| - |Dx ^ Dy|, and |y| <= OF |x| / NEED, so |Dx & Dy| >= |Dx| - Q |x| / NEED;
    (3) for any partner y, room(y) <= room(leader), so 2 P |Dx & Dy| >= -room(x) - room(leader).
    Sets that share m elements share one of the first |D| - m + 1 of each. Heads rest on all three, tails on (2) and (3).
    """
    p, q = OF + NEED, OF - NEED
    rooms = members.withColumn("room", q * F.col("n") - p * F.col("d"))
    best = rooms.groupBy("b").agg(F.max(F.struct("room", F.bitwise_not("rep").alias("first"))).alias("best"))
    rooms = rooms.join(best.select("b", F.col("best.room").alias("most"), F.bitwise_not("best.first").alias("leader")), "b")
    room, most, d = F.col("room"), F.col("most"), F.col("d")
    share = lambda x: F.ceil(x / (2 * p))
    at_least = F.greatest(F.lit(1), d - F.floor(q * F.col("n") / NEED), share(-room - most))
    near = room + most >= 0
    head = d + 1 - F.greatest(at_least, share(most + 1 - room))
    tail = F.when(near, head).otherwise(d + 1 - at_least)
    return rooms.select("rep", "b", "n", "d", "elements", "room", "leader", near.alias("near"), F.greatest(F.lit(0), head).cast("int").alias("head"), F.greatest(F.lit(0), tail).cast("int").alias("tail"))


def difference_lists(members: DataFrame, found: DataFrame) -> DataFrame:
    """Entries (ENTRY) with members of the lists of prefixes of differences, where some entries of a list may be a pair. Checkpointed."""
    behind = [F.greatest(F.lit(0), F.col("d") - F.col(x)).cast("int").alias(f"behind_{x}") for x in ("head", "tail")]
    parts = F.array(*[F.struct(kind.alias("kind"), F.slice("elements", start, F.greatest(F.lit(0), length)).alias("tokens")) for kind, start, length in ((F.when(F.col("near"), 0).otherwise(1), F.lit(1), F.col("head")), (F.lit(2), F.col("head") + 1, F.col("tail") - F.col("head")))])
    entries = members.select("rep", "b", "n", "room", *behind, F.explode(parts).alias("part")).select("*", "part.kind", F.explode("part.tokens").alias("token"))
    entries = entries.withColumn("key", F.xxhash64("b", "token")).withColumn("matches", F.lit(1)).select(*ENTRY)
    entries = cut(with_components(entries, found))
    kinds = [F.count(F.when(F.col("kind") == k, 1)) for k in range(3)]
    some = (kinds[0] * (kinds[1] + kinds[2]) > 0) | (kinds[1] > 1)
    live = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members"), (some & (F.min("component") < F.max("component"))).alias("live"))
    live = cut(live.where("live").select("key", "members"))
    out = cut(matched(entries.drop("component"), live, "key", "members"))
    drop(entries, live)
    return out


def linked_components(docs: DataFrame, entries: DataFrame, handle: Broadcast, rounds: int = ROUNDS) -> DataFrame:
    """(node, component) of the sets that link with others. entries (ENTRY): prefix lists of the sets, each of which the document
    rep has."""
    lists = shared_lists(entries)
    others = with_centres(lists)
    # every set meets the one, near in size, that is the centre of most of its lists
    votes = others.where("rep <> centre").where(_near(F.col("n"), F.col("centre_n"))).groupBy("rep", "centre").agg(F.count(F.lit(1)).alias("votes"))
    first = votes.groupBy("rep").agg(F.max_by("centre", F.struct("votes", F.bitwise_not("centre").alias("first"))).alias("centre"))
    first = cut(first.select(F.col("rep").alias("a"), F.col("centre").alias("b")))
    groups = cut(_groups(others.where(F.col("members") > SHORT if rounds else F.lit(False))))
    drop(others)
    texts = texts_for(docs, first.select(F.explode(F.array("a", "b")).alias("id")).union(groups.select("a")))
    links, asked, turn = [verified(texts, first)], [], 0
    drop(first)
    while True:
        members = with_prefixes(differences(texts, groups, handle)) if rounds else None
        drop(texts, groups)
        if members is not None:
            members = cut(members)
            links.append(members.where("near and rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")))
        found = components(_union(links))
        asked += _pairs_of(lists, found, whole=not rounds)
        drop(lists)
        if members is None:
            break
        lists, turn = difference_lists(members, found), turn + 1
        long_ = lists.where(F.col("members") > SHORT)
        last = not long_.limit(1).count()
        if last or turn >= rounds:
            asked += _pairs_of(lists, found, whole=not last)
            drop(lists)
            break
        groups = cut(_groups(with_centres(long_)))
        texts = texts_for(docs, groups.select(F.col("a").alias("id")))
        drop(found)
    of = lambda end: found.select(F.col("node").alias(f"{end}_node"), F.col("component").alias(f"{end}_component"))
    rest = _union(asked).join(of("a"), F.col("a") == F.col("a_node"), "left").join(of("b"), F.col("b") == F.col("b_node"), "left")
    rest = cut(rest.where(F.coalesce("a_component", "a") != F.coalesce("b_component", "b")).select("a", "b").distinct())
    drop(*asked, found)
    links.append(verified(texts_for(docs, rest.select(F.explode(F.array("a", "b")).alias("id"))), rest))
    return components(_union(links))


def _pairs_of(lists: DataFrame, found: DataFrame, whole: bool) -> list[DataFrame]:
    """Pairs (a, b) of short lists, and of all others too if `whole`; checkpointed."""
    entries = with_components(lists.select(*ENTRY, "members"), found)
    out = [cut(short_pairs(entries.where(F.col("members") <= SHORT)))]
    return [*out, cut(all_pairs(entries.where(F.col("members") > SHORT)))] if whole else out


def _groups(lists: DataFrame) -> DataFrame:
    """(a, b): members of lists, by the lists' centre."""
    return lists.select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.union(df)
    return out


def join_components(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links lead to, the document's own included. Documents without words (a null
    text has none) link with nothing. A row without doc_id links with nothing and has a null component_id. Rows that
    share a doc_id are one node. An empty table gives an empty one. Shingles and sets are told apart by 64-bit and
    128-bit digests. What is returned is checkpointed; all other tables on the way are deleted.
    """
    before = written()
    size = docs.select(F.spark_partition_id().alias("task")).agg(F.count("task").alias("rows"), F.max("task").alias("last")).first()
    bits = min(BUCKETS[1], max(BUCKETS[0], size.rows.bit_length() + 2))
    handle = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, bits, (size.last or 0) + 1))
    measured = cut(prefixes(docs, handle))
    sets = F.coalesce("sig", F.lit(b""))
    if measured.where("doc_id is not null").groupBy("doc_id").agg(F.min(sets).alias("low"), F.max(sets).alias("high")).where("low <> high").limit(1).count():
        drop(measured)
        return _row_components(docs, rounds)
    usable = measured.where("sig is not null and doc_id is not null")
    holder = F.min(F.when(F.col("prefix").isNotNull(), F.col("doc_id"))).alias("holder")
    same = cut(usable.groupBy("sig").agg(F.min("doc_id").alias("rep"), holder, F.count(F.lit(1)).alias("copies")))
    known = same.where("holder is not null").select(F.col("sig").alias("same_sig"), "rep", "holder")
    held = usable.where("prefix is not null").join(known, (F.col("sig") == F.col("same_sig")) & (F.col("doc_id") == F.col("holder")))
    held = cut(held.dropDuplicates(["sig"]).select("rep", "n", "matches", "prefix"))
    nodes = cut(lookup(measured.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("sig")).alias("sig")), same.drop("holder"), "sig", "copies"))
    drop(measured)
    nothing = [F.lit(None).cast("long").alias("room"), *[F.lit(None).cast("int").alias(c) for c in ENTRY[-2:]]]
    entries = held.select(F.explode("prefix").alias("key"), "rep", "n", "matches", F.lit(1).alias("kind"), *nothing)
    found = linked_components(docs, entries, handle, rounds)
    group = cut(found.join(same.select("rep", "copies"), F.col("node") == F.col("rep")).select("rep", "component", "copies"))
    out = lookup(nodes.select("doc_id", "n", "rep"), group, "rep", "copies")
    out = cut(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id")))
    drop_since(before, out)
    return out


def _row_components(docs: DataFrame, rounds: int) -> DataFrame:
    """join_components where a doc_id stands on rows with different sets: rows are numbered and joined by their numbers, then
    the components that rows of one doc_id are in become one."""
    before = written()
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("own_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row")))
    inner = join_components(rows.select(F.when(F.col("own_id").isNotNull(), F.col("row")).alias("doc_id"), "text"), rounds)
    owners = rows.where("own_id is not null").select("row", "own_id")
    found = cut(inner.join(owners, F.col("doc_id") == F.col("row")).select(F.col("own_id").alias("doc_id"), "n_shingles", F.col("component_id").alias("part")))
    pairs = found.select("doc_id", "part").distinct()
    lows = pairs.groupBy(F.col("doc_id").alias("low_id")).agg(F.min("part").alias("a"))
    tops = components(pairs.join(lows, F.col("doc_id") == F.col("low_id")).select("a", F.col("part").alias("b")))
    parts = found.groupBy("part").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    parts = cut(parts.join(tops, F.col("part") == F.col("node"), "left").select("part", "low", "copies", F.coalesce("component", "part").alias("top")))
    names = parts.groupBy(F.col("top").alias("name_top")).agg(F.min("low").alias("component_id"))
    named = cut(parts.join(names, F.col("top") == F.col("name_top")).select("part", "component_id", "copies"))
    out = lookup(found, named, "part", "copies").select("doc_id", "n_shingles", "component_id")
    out = cut(out.union(inner.where("doc_id is null").select("doc_id", "n_shingles", "component_id")))
    drop_since(before, out)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is their component's smallest, one row for each such id; rows without doc_id all stay."""
    joined = join_components(docs)
    left_out = cut(joined.where("doc_id <> component_id").select(F.col("doc_id").alias("left_out")).distinct())
    repeated = joined.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").limit(1).count()
    drop(joined)
    # few rows go, so these are the ones to join: what stays is then not shuffled while they are small enough to be broadcast
    out = docs.join(left_out, F.col("doc_id").cast("long") == F.col("left_out"), "left_anti")
    if not repeated:
        return out
    return out.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).unionByName(out.where(F.col("doc_id").isNull()))
