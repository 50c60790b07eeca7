"""Encoding with a public byte-level BPE vocabulary (problem 8): a hierarchical-bitmap rank queue.

Each merge rank has a bucket of positions in a linked list of tokens. A bitmap of three levels of 64-bit words tells which buckets hold
anything; find-first-set picks the lowest rank, and entries that no longer stand for a pair of that rank are skipped. A pre-token of n
bytes costs O(n) queue steps (plus sorting within a bucket), so very long pre-tokens are no worse than many short ones.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import sys
import types
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabulary files lie, and the one that the corpus is encoded with.
TOKENIZER_DIR, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: The public pre-tokenisation pattern of this vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_BYTES, CACHED = 48, 200_000
#: The same pattern for the standard library's faster matcher, and the characters on which the two agree: no numerals other than decimal
#: digits, no separators below the space, nothing assigned lately. Text with any other character takes the first pattern.
PLAIN_PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?(?:[^\W\d_]+|\d+|(?:[^\s\w]|_)+)|\s+(?!\S)|\s+"
PLAIN = "\0-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u0391-\u03a1\u03a3-\u0481\u200b-\u2027\u20ac\u2190-\u21ff\u3000-\u3006\u3008-\u3020\u3041-\u3096\u30a1-\u30ff\u4e00-\u9fa5\uff01-\uff5e\ufe0f\U0001f300-\U0001f64f"


class RankQueue:
    """Positions by rank, lowest rank first."""

    def __init__(self) -> None:
        self.top, self.mid, self.low, self.buckets = 0, {}, {}, {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and all its positions, or None."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        m = self.mid[b]
        a = b << 6 | (m & -m).bit_length() - 1
        w = self.low[a]
        rank = a << 6 | (w & -w).bit_length() - 1
        if w := w & w - 1:
            self.low[a] = w
        else:
            del self.low[a]
            if m := m & m - 1:
                self.mid[b] = m
            else:
                del self.mid[b]
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class Encoder:
    """Text to ids. Null and empty text have no ids."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.words = {i: b for b, i in self.ranks.items()}
        self.byte = [self.ranks[bytes([i])] for i in range(256)]
        self.exact = regex.compile(pattern).findall
        self.quick = re.compile(PLAIN_PATTERN).findall if pattern == PATTERN else None
        self.plain = re.compile(f"[{PLAIN}]*").fullmatch
        self.pairs: dict[tuple[int, int], int] = {}
        self.cache: dict[str, list[int]] = {}

    def _rank(self, a: int, b: int) -> int:
        """The rank of merging two tokens, which is the id of the result; -1 if they don't merge."""
        r = self.pairs.get((a, b))
        if r is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            r = self.pairs[a, b] = self.ranks.get(self.words[a] + self.words[b], -1)
        return r

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        rank_of, queue = self._rank, RankQueue()
        ids = [self.byte[x] for x in piece]
        n = len(ids)
        following, leading = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            r = rank_of(ids[i], ids[i + 1])
            if r >= 0:
                queue.push(r, i)
        while (top := queue.pop()) is not None:
            rank, bucket = top
            bucket.sort()
            for i in bucket:
                j = following[i]
                if ids[i] < 0 or j >= n or rank_of(ids[i], ids[j]) != rank:
                    continue  # stale
                ids[i], ids[j] = rank, -1
                k = following[i] = following[j]
                if k < n:
                    leading[k] = i
                    r = rank_of(rank, ids[k])
                    if r >= 0:
                        queue.push(r, i)
                h = leading[i]
                if h >= 0:
                    r = rank_of(ids[h], rank)
                    if r >= 0:
                        queue.push(r, h)
        return [x for x in ids if x >= 0]

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return self.quick(text) if self.quick and self.plain(text) else self.exact(text)

    def encode_piece(self, piece: str) -> list[int]:
        got = self.merge(piece.encode("utf-8", "replace"))
        if len(piece) <= CACHED_BYTES:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            self.cache[piece] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for piece in self.split(text or ""):
            got = cache.get(piece)
            out += self.encode_piece(piece) if got is None else got
        return out

    def count(self, text: str | None) -> int:
        """The number of ids; of short pre-tokens met before no list is made."""
        cache, n = self.cache, 0
        for piece in self.split(text or ""):
            got = cache.get(piece)
            n += len(self.encode_piece(piece) if got is None else got)
        return n


def kept_encoder(vocabulary: bytes) -> Encoder:
    """The worker process's encoder of a vocabulary: its tables and the pre-tokens it has met (a bounded number) serve the tasks to come."""
    kept = sys.modules.setdefault("_tracewright_kept", types.ModuleType("_tracewright_kept")).__dict__
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in kept:
        kept[key] = Encoder(vocabulary)
    return kept[key]


def vocabulary_bytes(directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> bytes:
    with open(os.path.join(directory, name), "rb") as f:
        return f.read()


def _share(spark: SparkSession, directory: str, name: str):
    """The vocabulary file (under 1 MB) as a broadcast: executors needn't have it."""
    return spark.sparkContext.broadcast(vocabulary_bytes(directory, name))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every document, whole texts, without special tokens (their strings are ordinary text). Null and empty text: an empty list.

    Repeated documents each have their row; further columns are ignored; an empty table gives no rows.
    """
    shared = _share(docs.sparkSession, directory, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = kept_encoder(shared.value)
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "ids": [e.encode(t) for t in b["t"]]})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def token_counts(docs: DataFrame, text: str = "text", directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all without it) plus tokens, the number of ids of its text (0 for null and empty text); a column
    tokens is replaced. The counts of texts met lately are kept, so that a text repeated all over a partition is encoded seldom."""
    docs = docs.drop("tokens")
    kept = list(keep or docs.columns)
    shared = _share(docs.sparkSession, directory, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, lately = kept_encoder(shared.value), {}
        for b in batches:
            counts = []
            for t in b["__text"]:
                key = hash(t)
                got = lately.get(key)
                if got is None or got[0] != t:
                    if len(lately) >= 4096:
                        lately.clear()
                    got = lately[key] = (t, e.count(t))
                counts.append(got[1])
            out = b[kept].copy()
            out["tokens"] = counts
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + ", tokens bigint"
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text")).mapInPandas(run, schema)


def statistics(encoded: DataFrame) -> DataFrame:
    """How often each token id occurs and in how many documents."""
    each = encoded.select("doc_id", F.explode("ids").alias("token"))
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("occurrences"))
