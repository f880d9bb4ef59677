"""Secrets in texts, with DataFrame functions only.

Three kinds follow fixed patterns. The fourth looks at candidate strings: the Shannon entropy of each window of a
candidate, kept up to date by counts of the symbols that enter and leave, against a threshold for the candidate's
character class. An allow-list suppresses candidates that are known to look random without being secret.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A match of the `+` form that is long enough is one of these, and the other way round: both take whole runs.
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
ASSIGN_LENGTH = 8
#: Symbols of candidates, their least length (one window), and runs that are candidates if they have a digit and a letter.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
WINDOW = 20
CANDIDATE, HAS = "[A-Za-z0-9+/=_-]{%d,}" % WINDOW, ("[0-9]", "[A-Za-z]")
#: Character classes, narrowest first: what a candidate of the class consists of, and the entropy (bits) that its best window must reach.
CLASSES = (("^[0-9a-fA-F]+$", 3.0), ("^[A-Z0-9]+$|^[a-z0-9]+$", 3.3), (".", 3.8))
#: Candidates that are no secrets: ids in UUID form, placeholders, alphabets, media in base64, digests with their algorithm's name.
#: No pattern repeats a group, for the regular expressions of the JVM recur once for each round of such a repetition.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "(?i)example|placeholder|changeme|dummy|sample|redacted|xxxx|0000000",
    "(?i)0123456789|abcdefghij|qwertyuiop",
    "^(iVBORw0KGgo|R0lGOD|/9j/4|JVBERi)",
    "(?i)^(sha(1|224|256|384|512)|md5)[=_-]",
)
#: Words joined by marks are none either: what marks separate, the first of it and the rest.
MARKS, FIRST, PART = "[/_-]+", "^[A-Za-z]{1,24}$", "^([A-Za-z]{0,24}|[0-9]{1,4})$"
#: Counts of a window's symbols, packed into longs: so many bits hold a count up to WINDOW, so many symbols go into one long.
BITS, PACKED = 5, 12


def matches(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches, in code points; with group, only those whose group has `least` characters.

    What stands between the matches tells where they are: starts are sums of lengths.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def add(state: Column, i: Column) -> Column:
        start = state["at"] + F.length(gaps_[i])
        found = F.struct(start.alias("start"), (start + F.length(hits_[i])).alias("end"), hits_[i].alias("hit"))
        return F.struct(found["end"].alias("at"), F.when(F.length(sizes_[i]) >= least, F.concat(state["out"], F.array(found))).otherwise(state["out"]).alias("out"))

    # one struct holds the three arrays, so that each is computed once for a text
    held = F.transform(F.array(F.struct(hits.alias("h"), gaps.alias("g"), sizes.alias("s"))), lambda x: x)
    hits_ = gaps_ = sizes_ = None

    def walk(x: Column) -> Column:
        nonlocal hits_, gaps_, sizes_
        hits_, gaps_, sizes_ = x["h"], x["g"], x["s"]
        return F.when(F.size(hits_) == 0, empty).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(hits_) - 1), F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda s: s["out"]))

    return F.when(text.rlike(pattern), F.transform(held, walk)[0]).otherwise(empty)


def best_entropy(word: Column) -> Column:
    """Greatest Shannon entropy of the windows of WINDOW symbols of a word that has at least so many."""
    log = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 2)])
    symbols = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)

    def events(all_: Column) -> Column:
        """Each symbol enters; the one that stood WINDOW places before leaves first."""
        place = lambda s: (F.floor(s / PACKED).cast("int").alias("at"), (F.pmod(s, F.lit(PACKED)) * BITS).alias("shift"))
        enter = lambda s, i: F.struct(*place(s), F.lit(1).cast("long").alias("by"), (i >= WINDOW - 1).alias("full"))
        leave = lambda i: F.struct(*place(all_[i - WINDOW]), F.lit(-1).cast("long").alias("by"), F.lit(False).alias("full"))
        return F.flatten(F.transform(all_, lambda s, i: F.when(i >= WINDOW, F.array(leave(i), enter(s, i))).otherwise(F.array(enter(s, i)))))

    def step(state: Column, e: Column) -> Column:
        n = F.call_function("shiftright", state["counts"][e["at"]], e["shift"]).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
        total = state["total"] + log[n + e["by"].cast("int")] - log[n]
        entropy = F.lit(math.log2(WINDOW)) - total / WINDOW
        counts = F.transform(state["counts"], lambda c, i: F.when(i == e["at"], c + F.call_function("shiftleft", e["by"], e["shift"])).otherwise(c))
        return F.struct(counts.alias("counts"), total.alias("total"), F.when(e["full"], F.greatest(state["best"], entropy)).otherwise(state["best"]).alias("best"))

    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(SYMBOLS) // PACKED)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.aggregate(F.flatten(F.transform(F.array(symbols), events)), zero, step, lambda s: s["best"])


def is_random(word: Column) -> Column:
    """The candidate has a digit and a letter, its best window reaches the threshold of its class, and nothing on the allow-list suppresses it."""
    need = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        need = F.when(word.rlike(pattern), F.lit(bits)).otherwise(need)
    parts = F.split(word, MARKS)
    joined = word.rlike(MARKS) & parts[0].rlike(FIRST) & F.forall(F.slice(parts, 2, F.size(parts)), lambda p: p.rlike(PART))
    harmless = word.rlike("|".join(f"(?:{p})" for p in ALLOWED)) | joined
    plain = ~(word.rlike(HAS[0]) & word.rlike(HAS[1]))
    return F.when(plain, F.lit(False)).when(harmless, F.lit(False)).otherwise(best_entropy(word) >= need)


def with_spans(docs: DataFrame, prefix: str = "secret_") -> DataFrame:
    """docs with arrays of spans (start, kind, end; ordered), one of the base kinds and one of all: <prefix>base, <prefix>all.

    A null text counts as empty and has none. Entropy spans that touch a base span are left out. A text without spans has
    empty arrays; repeated rows have the same ones each.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = [f"{prefix}{k}" for k in KINDS]
    out = docs.withColumns({names[0]: matches(text, ASSIGN, 2, ASSIGN_LENGTH), names[1]: matches(text, ACCESS), names[2]: matches(text, HEX), names[3]: matches(text, CANDIDATE)})
    part = lambda i: F.transform(F.col(names[i]), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))
    out = out.withColumn(f"{prefix}base", F.array_sort(F.concat(part(0), part(1), part(2))))
    apart = lambda s: ~F.exists(F.col(f"{prefix}base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    random = F.filter(F.col(names[3]), lambda s: apart(s) & is_random(s["hit"]))
    out = out.withColumn(names[3], F.when(F.size(names[3]) > 0, random).otherwise(F.col(names[3])))
    return out.withColumn(f"{prefix}all", F.array_sort(F.concat(F.col(f"{prefix}base"), part(3)))).drop(names[3])


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end of all spans, by start, then kind; start and end (exclusive) count code points.
    base_sha256 is the digest of such a list of the base kinds. A null text counts as empty. No shuffle.
    """
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda k: F.size(f"secret_{k}").cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(F.col("secret_base")), 256).alias("base_sha256"), _listed(F.col("secret_all")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each stretch of secret spans in text replaced by a mark, and n_chars, if it is there, brought up to date. No row goes; a null text stays null."""
    found = with_spans(docs, "silvan_secret_")
    text, spans = F.col("text"), F.col("silvan_secret_all")

    def step(state: Column, s: Column) -> Column:
        gap = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], gap).otherwise(state["out"]).alias("out"))

    masked = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    changed = (F.size(spans) > 0) & text.isNotNull()
    out = found.withColumn("silvan_secret_text", F.when(changed, masked).otherwise(text))
    new = {"text": F.col("silvan_secret_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("silvan_secret_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
