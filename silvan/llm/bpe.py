"""Byte-pair encoding by dynamic programming over prefixes.

Every prefix of a pre-token has one byte-pair encoding, and so one last token. A token t is the last one of a
prefix when it is a suffix of the prefix, and the last token of what stands before it may stand next to t: their
two byte strings, joined and merged anew, give the two tokens again. A suffix automaton over the vocabulary
lists the tokens that end at each byte; last tokens are stored for every prefix, and the ids follow from walking
back from the end.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The byte-level pre-tokenizer's pattern (fixed value of the tokenizer file's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode white space, as the pattern's \s has it.
SPACE = "\t-\r \x85\xa0  -     　"
#: Marks that are pre-tokens of their own behind letters, at the end of a word.
POINTS = (".", ",", ";", ":", "!", "?")
#: Entries that a worker keeps of words and pre-tokens seen; beyond it the cache starts anew. It never changes a result.
CACHE = 300_000
#: Longest word that is kept.
CACHE_LENGTH = 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file, as character -> byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """ranks: a rank file of the same vocabulary; with it, pre-tokens that are not cached are merged by the tiktoken
    library instead of by the prefixes' dynamic programming, which gives the same ids."""

    def __init__(self, path: str, ranks: str | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte_of = spec["model"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: bytes(byte_of[c] for c in s) for s, i in model["vocab"].items()}
        ids = {b: i for i, b in self.token.items()} if ranks is None else {}
        #: rank of each mergeable pair; rank and halves of what a merge makes. Bytes have no halves and are there from the start.
        self.rank: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = dict.fromkeys(self.token, -1) if ranks is None else {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"] if ranks is None else ()):
            left, right = (model["vocab"][s] for s in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank[left, right] = rank
            made = ids[self.token[left] + self.token[right]]
            if made not in self.halves:
                self.halves[made], self.born[made] = (left, right), rank
        self.merge = self.encode_piece if ranks is None else self._library(ranks)
        self._suffixes([] if ranks else [(b, i) for i, b in self.token.items() if len(b) == 1 or i in self.halves])
        for s, i in self.special.items():
            self.token[i] = s.encode()
        self.bytes_of = [self.token.get(i, b"") for i in range(max(self.token) + 1)]
        self.lengths = [len(b) for b in self.bytes_of]
        self.id_bytes = [i.to_bytes(4, "little") for i in range(len(self.bytes_of))]
        self.fits: dict[int, bool] = {}
        self.stands = {i: i not in self.halves or self._stands(i) for i in self.token} if ranks is None else {}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.split = regex.compile(PATTERN).findall
        self.runs = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.odd = re.compile(f"[{SPACE}](?: |$)").search
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    @staticmethod
    def _library(ranks: str) -> Callable[[str], list[int]]:
        with open(ranks, "rb") as f:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        merge = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})._core_bpe.encode_single_piece
        return lambda piece: merge(piece.encode())

    def _suffixes(self, words: list[tuple[bytes, int]]) -> None:
        """The automaton whose state after some bytes tells all tokens that end there: go[state << 8 | byte] is the next
        state (filled in as it is asked for), ends[state] the tokens as token << 8 | length, longest first."""
        self.go: dict[int, int] = {}
        own, parent, byte = [-1], [0], [0]
        order = sorted(words)
        for word, token in order:
            at = 0
            for c in word:
                to = self.go.get(at << 8 | c)
                if to is None:
                    to = self.go[at << 8 | c] = len(own)
                    own.append(-1)
                    parent.append(at)
                    byte.append(c)
                at = to
            own[at] = token << 8 | len(word)
        depth = [0] * len(own)
        for state in range(1, len(own)):
            depth[state] = depth[parent[state]] + 1
        self.fallback, self.ends = [0] * len(own), [()] * len(own)
        for state in sorted(range(1, len(own)), key=depth.__getitem__):
            at = self.fallback[parent[state]] if parent[state] else -1
            while at >= 0 and (to := self.go.get(at << 8 | byte[state])) is None:
                at = self.fallback[at] if at else -1
            back = self.fallback[state] = to if at >= 0 else 0
            self.ends[state] = (own[state], *self.ends[back]) if own[state] >= 0 else self.ends[back]
        self.inner = len(self.go)

    def _step(self, state: int, byte: int) -> int:
        at = state
        while (to := self.go.get(at << 8 | byte)) is None:
            if not at:
                to = 0
                break
            at = self.fallback[at]
        if len(self.go) > self.inner + 4 * CACHE:
            self.go = dict(list(self.go.items())[: self.inner])
        self.go[state << 8 | byte] = to
        return to

    def _stands(self, token: int) -> bool:
        """Merging the token's bytes gives the token itself: its halves stand, and meet unmerged until its own merge."""
        left, right = self.halves[token]
        return all(h not in self.halves or self._stands(h) for h in (left, right)) and self._meet(left, right, self.born[token])

    def _meet(self, a: int, b: int, until: int) -> bool:
        """No merge across the border between a and b comes up before the one of rank `until`.

        Undo the merges of both, the later one first, and look at the two tokens that face each other at the border
        meanwhile. Their pair would merge if its rank came before that of the merge that takes the left one (on equal
        ranks the pair further left goes first: the left one's) or, on equal ranks too, the right one.
        """
        left_ends = right_ends = until
        while True:
            rank = self.rank.get((a, b))
            if rank is not None and rank < left_ends and rank <= right_ends:
                return False
            if a not in self.halves and b not in self.halves:
                return True
            if self.born[a] > self.born[b]:
                left_ends, a = self.born[a], self.halves[a][1]
            else:
                right_ends, b = self.born[b], self.halves[b][0]

    def _fit(self, a: int, b: int) -> bool:
        if len(self.fits) >= 4 * CACHE:
            self.fits.clear()
        got = self.fits[a << 20 | b] = self._meet(a, b, 1 << 60)
        return got

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        data = piece.encode()
        last: list[int] = [-1]
        go, ends, fits, state, end = self.go.get, self.ends, self.fits.get, 0, 0
        for byte in data:
            end += 1
            state = to if (to := go(state << 8 | byte)) is not None else self._step(state, byte)
            for found in ends[state]:
                before = last[end - (found & 255)]
                token = found >> 8
                if before < 0:
                    if self.stands[token]:
                        break
                elif (got := fits(before << 20 | token)) or got is None and self._fit(before, token):
                    break
            last.append(token)
            if go.__self__ is not self.go:
                go = self.go.get
        ids, lengths = [], self.lengths
        while end:
            ids.append(token := last[end])
            end -= lengths[token]
        ids.reverse()
        return ids

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = b"".join(map(self.id_bytes.__getitem__, self.merge(piece)))
            if len(piece) <= CACHE_LENGTH:
                if len(self.pieces) >= CACHE:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def _word(self, word: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of a stretch that begins and ends at borders of pre-tokens."""
        if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
            return self._piece(word)
        if word[-1:] in POINTS and word[1:-1].isalpha() and (word[0] == " " or word[0].isalpha()):
            return self._piece(word[:-1]) + self._piece(word[-1])
        return b"".join(map(self._piece, self.split(word)))

    def _stretches(self, words: list[str], known: dict[str, bytes], lead: str) -> list[bytes]:
        found = list(map(known.get, words))
        for i, got in enumerate(found):
            if got is None:
                word = words[i]
                got = found[i] = known.get(word)
                if got is None:
                    got = found[i] = self._word(lead + word)
                    if len(word) <= CACHE_LENGTH:
                        if len(known) >= CACHE:
                            known.clear()
                        known[word] = got
        return found

    def _plain(self, text: str) -> bytes:
        """A border of pre-tokens stands wherever white space follows something else."""
        if self.odd(text) or not text:
            return b"".join(map(self._word, self.runs(text)))
        first, *rest = text.split(" ")
        return self._word(first) + b"".join(self._stretches(rest, self.words, " "))

    def forget(self) -> None:
        """Empties the caches, for workers that go on to other operators."""
        self.words.clear()
        self.pieces.clear()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; special tokens in the text get their own ids."""
        if self.specials is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special[part].to_bytes(4, "little") if part in self.special else self._plain(part) for part in self.specials(text))

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str, ranks: str | None = None) -> Bpe:
    """The tokenizer of a vocabulary file, once for each worker."""
    return Bpe(path, ranks)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no tokens, digests of no bytes. Rows are independent, so null or repeated ids stay
    as they are, and other columns are not read. No shuffle.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
