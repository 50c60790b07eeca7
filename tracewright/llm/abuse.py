"""Abusive, hateful or sexual content (problem 10): FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A passage is short and a document may be long, so the model scores every window of a document and the document by its highest window.
Labels are known for documents only: training alternates between choosing the most telling window of each abusive document and fitting.
Text is normalised first (compatibility forms, look-alike letters, leet, stretched, spaced and masked words), so spelling tricks share features.
L1 leaves few weights, which are broadcast.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.runtime import materialize

#: Hash buckets.
BUCKETS = 1 << 20
#: The fitting sample: at most so many labelled documents, with at most so many tokens together (16 MB); a seeded choice of more.
MAX_LABELS, MAX_LABEL_TOKENS = 50_000, 1 << 22
#: Tokens in a window: a passage may be a few words or a sentence. Quiet windows are the longest ones, STRIDE apart.
WINDOWS, STRIDE = (4, 6, 9, 14), 7
#: Letters that look like Latin ones, and characters that stand for letters inside words.
LOOKALIKE = dict(zip("авеікмнорстухѕјԁьһԛԝαβεικνορτυχ", "abeikmhopctyxsjdbhqwabeiknoptux"))
LEET = str.maketrans("@$0134578!", "asoieastbi")

#: Tokens whose windows are scored in one step.
SCORED_AT_ONCE = 1 << 18

_TABLE = str.maketrans(LOOKALIKE)
_LOOKS = re.compile("[" + "".join(LOOKALIKE) + "]")
#: What a text must hold for the rules after it to change anything: a letter between two equal separators, three equal letters, a letter beside a stand-in.
_LONE, _TRIPLE = re.compile(r"([ .\-_*])[^\W\d_]\1"), re.compile(r"([a-z])\1\1")
_MIXED = re.compile(r"[a-z][@$0134578!]|[@$0134578!][a-z]")
_HIDDEN = re.compile("[­​-‏⁠-⁤﻿︀-️]")
_CJK = "㐀-鿿"
_CJK_GAP = re.compile(f"(?<=[{_CJK}])[\\s丨|*.\\-_·~/]{{1,2}}(?=[{_CJK}])")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_]([ .\-_*]))(?:[^\W\d_]\1)+[^\W\d_](?![^\W_])")
_STRETCH = re.compile(r"([a-z])\1{2,}")
_LONG = re.compile(r"0x[0-9a-f]{8,}|[0-9a-f]{24,}")
_LEETWORD = re.compile(r"(?<![\w@$])(?=[^\s]*[a-z])(?=[^\s]*[@$0134578!])[a-z@$0134578!]{2,16}(?![\w@$])")
_TOKEN = re.compile(f"[a-z]\\*+[a-z]*|[{_CJK}぀-ヿ]|[^\\W\\d_{_CJK}぀-ヿ]+|\\d+(?:[.,:/-]\\d+)*")


class _Hashes(dict):
    """Hash of each token, kept for those seen; a number counts as ``#``."""

    def __missing__(self, token: str) -> int:
        h = zlib.crc32(b"#" if token[0].isdigit() else token.encode("utf-8", "replace"))
        if len(self) >= 1 << 18:
            self.clear()
        self[token] = h
        return h


_HASHES = _Hashes()


def _raw_tokens(text: str | None) -> list[str]:
    s = unicodedata.normalize("NFKC", text or "").lower()
    s = _HIDDEN.sub("", s)
    s = _LONG.sub(" 0 ", s)
    if _LOOKS.search(s):
        s = s.translate(_TABLE)
    s = _CJK_GAP.sub("", s)
    if _LONE.search(s):
        s = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), s)
    if _MIXED.search(s):
        s = _LEETWORD.sub(lambda m: m[0].translate(LEET) if sum(c.isdigit() for c in m[0]) <= 0.6 * len(m[0]) else m[0], s)
    if _TRIPLE.search(s):
        s = _STRETCH.sub(r"\1", s)
    return _TOKEN.findall(s)


def tokens(text: str | None) -> list[str]:
    """Words, CJK characters and ``#`` for numbers of the normalised text; of a masked word the letters left and the mask's length."""
    return ["#" if t[0].isdigit() else t for t in _raw_tokens(text)]


def token_hashes(text: str | None) -> np.ndarray:
    found = _raw_tokens(text)
    return np.fromiter(map(_HASHES.__getitem__, found), dtype=np.uint32, count=len(found))


class Texts:
    """Token hashes of many documents end to end, and the buckets of each token's word, bigram, trigram and two skip-grams.

    An n-gram past the document's end falls into bucket 0. ``left`` is the number of the document's tokens from each token on.
    """

    def __init__(self, docs: Sequence[np.ndarray]):
        self.sizes = np.array([len(h) for h in docs], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        n = int(self.ends[-1]) if len(docs) else 0
        self.doc = np.repeat(np.arange(len(docs)), self.sizes)
        self.left = (self.ends[self.doc] - np.arange(n)) if n else np.zeros(0, np.int64)
        self.buckets = self._buckets(np.concatenate([*docs, np.zeros(3, np.uint32)]).astype(np.uint64), n)

    def _buckets(self, u: np.ndarray, n: int) -> np.ndarray:
        a, b, c, d = u[:n], u[1 : n + 1], u[2 : n + 2], u[3 : n + 3]
        mul = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
        out = np.empty((n, 5), np.uint64)
        out[:, 0] = (a + np.uint64(1)) * mul[0]
        out[:, 1] = ((a + np.uint64(2)) * mul[0]) ^ (b * mul[1])
        out[:, 2] = ((a + np.uint64(3)) * mul[0]) ^ (b * mul[1]) ^ ((c + np.uint64(7)) * mul[2])
        out[:, 3] = ((a + np.uint64(4)) * mul[0]) ^ (c * mul[2])
        out[:, 4] = ((a + np.uint64(5)) * mul[0]) ^ (d * mul[3])
        out ^= out >> np.uint64(29)
        out *= mul[1]
        out = (out >> np.uint64(40)) % np.uint64(BUCKETS - 1) + np.uint64(1)
        for k, reach in ((1, 1), (2, 2), (3, 2), (4, 3)):
            out[self.left <= reach, k] = 0
        return out.astype(np.int32)

    def best_windows(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(summed weights, first token, length) of each document's highest window of any of the lengths (the whole text if it is shorter).
        A document without tokens has minus infinity and length 0. Of equal windows the longest counts, then the first."""
        m = len(self.sizes)
        best, start, length = np.full(m, -np.inf), self.starts.copy(), np.zeros(m, np.int64)
        full = np.flatnonzero(self.sizes)
        if not len(full):
            return best, start, length
        run = np.concatenate([[0.0], np.cumsum(weights[self.buckets].sum(axis=1, dtype=np.float64))])
        short = full[self.sizes[full] < max(WINDOWS)]
        best[short] = run[self.ends[short]] - run[self.starts[short]]
        length[short] = self.sizes[short]
        for w in sorted(WINDOWS, reverse=True):
            sums = np.full(len(self.left), -np.inf)
            at = np.flatnonzero(self.left >= w)
            sums[at] = run[at + w] - run[at]
            top = np.full(m, -np.inf)
            top[full] = np.maximum.reduceat(sums, self.starts[full])
            better = top > best
            hit = np.flatnonzero((sums == top[self.doc]) & better[self.doc])
            d, first = np.unique(self.doc[hit], return_index=True)
            best[d], start[d], length[d] = top[d], hit[first], w
        return best, start, length

    def examples(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The distinct buckets of windows, one row each, padded with bucket 0."""
        longest = max(WINDOWS)
        inside = np.arange(longest) < length[:, None]
        rows = np.where(inside[:, :, None], self.buckets[np.minimum(start[:, None] + np.arange(longest), len(self.left) - 1)], 0).reshape(len(start), -1)
        rows.sort(axis=1)
        rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = 0
        return rows

    def tiles(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of windows of the longest kind, STRIDE apart, over all tokens of ``docs``."""
        longest, size = max(WINDOWS), self.sizes[docs]
        many = np.where(size > 0, np.maximum(1, -(-(size - longest + STRIDE) // STRIDE)), 0)
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(self.starts[docs], many) + k * STRIDE, np.minimum(longest, np.repeat(size, many) - k * STRIDE)


class Ftrl:
    """FTRL-proximal with per-coordinate rates and L1 (McMahan et al., 2013), a few hundred examples at a time; the intercept isn't regularised."""

    def __init__(self, alpha: float = 0.15, beta: float = 1.0, l1: float = 0.6, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n, self.w = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
        self.bias_z = self.bias_n = self.bias = 0.0

    def learn(self, rows: np.ndarray, y: np.ndarray) -> None:
        """Examples (distinct buckets each, padded with 0) and their labels."""
        logit = np.clip(self.w[rows].sum(axis=1) + self.bias, -35, 35)
        g = 1 / (1 + np.exp(-logit)) - y
        live = np.abs(g) >= 1e-4
        if not live.any():
            return
        g, rows = g[live], rows[live]
        at, back = np.unique(rows, return_inverse=True)
        each = np.repeat(g, rows.shape[1])
        total, squares = np.bincount(back.ravel(), each, len(at)), np.bincount(back.ravel(), each * each, len(at))
        total, squares, at = (x[at > 0] for x in (total, squares, at))
        n = self.n[at]
        self.n[at] = n + squares
        z = self.z[at] + total - (np.sqrt(n + squares) - np.sqrt(n)) / self.alpha * self.w[at]
        self.z[at] = z
        self.w[at] = np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n + squares)) / self.alpha + self.l2))
        n, squares = self.bias_n, float((g * g).sum())
        self.bias_z += float(g.sum()) - (np.sqrt(n + squares) - np.sqrt(n)) / self.alpha * self.bias
        self.bias_n = n + squares
        self.bias = -self.bias_z / ((self.beta + np.sqrt(self.bias_n)) / self.alpha + self.l2)


def _first_windows(t: Texts, y: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Weights to choose the first windows by: the log-odds of a feature's documents, at least two of them abusive."""
    pairs = np.sort(np.repeat(t.doc, 5) * BUCKETS + t.buckets.ravel())
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
    count = lambda k: np.bincount((pairs % BUCKETS)[(used & (y == k))[pairs // BUCKETS]], minlength=BUCKETS)
    p, n = count(1), count(0)
    w = np.log((p + 0.5) / ((used & (y == 1)).sum() + 1)) - np.log((n + 0.5) / ((used & (y == 0)).sum() + 1))
    w[(p < 2) | (w < 0)] = 0
    w[0] = 0
    return w


def fit(t: Texts, y: np.ndarray, used: np.ndarray, rounds: int = 3, seed: int = 7, batch: int = 256) -> np.ndarray:
    """Weights with the intercept last, from the documents that ``used`` marks. Each round takes the best window of every abusive document
    as loud, and all windows of the others plus their own best ones (the hardest) as quiet. Without both classes: nothing is abusive."""
    rng = np.random.default_rng(seed)
    loud, quiet = (np.flatnonzero(used & (y == k) & (t.sizes > 0)) for k in (1, 0))
    if not len(loud) or not len(quiet):
        return np.zeros(0, np.float32)
    tiles = t.examples(*t.tiles(quiet))
    weights, bias = _first_windows(t, y, used), 0.0
    for _ in range(rounds):
        _, start, length = t.best_windows(weights)
        best = lambda docs: t.examples(start[docs], length[docs])
        a, b = best(loud), best(quiet)
        rows = np.concatenate([a, a, a, b, b, tiles])
        label = np.zeros(len(rows))
        label[: 3 * len(a)] = 1
        model, order = Ftrl(), rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            at = order[k : k + batch]
            model.learn(rows[at], label[at])
        weights, bias = model.w, model.bias
    return np.append(weights, bias).astype(np.float32)


def logits_of(model: np.ndarray, t: Texts) -> np.ndarray:
    """The logit of each document's highest window; minus infinity without tokens, -35 without a model."""
    if len(model) <= BUCKETS:
        return np.where(t.sizes > 0, -35.0, -np.inf)
    return t.best_windows(model[:BUCKETS])[0] + float(model[BUCKETS])


FOLDS = 3


def choose_cut(scores: list[tuple[float, int]], stands_for: float) -> tuple[float, float]:
    """(cut, F1) of held-out (logit, label) pairs. A quiet labelled document stands for ``stands_for`` times as many documents as an
    abusive one, so a false alarm weighs as many hits; the cut lies in the gap below the lowest score that is worth flagging, nearer to that score."""
    ranked = sorted(scores, reverse=True)
    total, hits, alarms, best, at = sum(y for _, y in ranked), 0, 0.0, 0.0, None
    for k, (s, y) in enumerate(ranked):
        hits, alarms = hits + y, alarms + (1 - y) * stands_for
        f1 = 2 * hits / (hits + alarms + total) if total else 0.0
        if y and f1 > best and (k + 1 == len(ranked) or ranked[k + 1][0] < s):
            best, at = f1, k
    if at is None:
        return 0.0, 0.0
    low = ranked[at][0]
    below = ranked[at + 1][0] if at + 1 < len(ranked) else low - 1
    return low - 0.25 * (low - below), best


def fit_tasks(spark: SparkSession, labelled: list[tuple[np.ndarray, int]], seed: int = 7) -> tuple[np.ndarray, list[tuple[float, int]]]:
    """(weights from all labels, held-out (logit, label) of every labelled document).

    The model of all labels and those of the FOLDS folds are fitted as parallel tasks on a broadcast of the sample (at most MAX_LABEL_TOKENS
    tokens); L1 leaves a few thousand weights to come back.
    """
    shared = spark.sparkContext.broadcast(([h for h, _ in labelled], np.array([y for _, y in labelled], np.int64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, y = shared.value
        for b in batches:
            for k in b["id"]:
                t, fold = Texts(hashes), np.random.default_rng(seed).permutation(len(y)) % FOLDS
                model = fit(t, y, fold != k, seed=seed)
                if k == FOLDS:  # no document is in this fold: the model of all labels
                    at = np.flatnonzero(model)
                    yield pd.DataFrame({"kind": "weight", "at": at, "value": model[at].astype(np.float64)})
                elif len(model):
                    held = np.flatnonzero((fold == k) & (t.sizes > 0))
                    yield pd.DataFrame({"kind": "held", "at": held, "value": logits_of(model, t)[held]})

    rows = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInPandas(run, "kind string, at bigint, value double").collect()
    weights = np.zeros(BUCKETS + 1, np.float32)
    for r in rows:
        if r.kind == "weight":
            weights[r["at"]] = r.value
    return weights if any(r.kind == "weight" for r in rows) else np.zeros(0, np.float32), [(r.value, labelled[r["at"]][1]) for r in rows if r.kind == "held"]


def labelled_hashes(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, max_tokens: int = MAX_LABEL_TOKENS, seed: int = 7) -> list[tuple[np.ndarray, int]]:
    """Token hashes and labels of the fitting sample: labelled documents with text in a seeded order, as long as both bounds hold; a
    document that would pass the second one is left out whole. A document labelled abusive once is abusive."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("is_abusive").isNotNull()).groupBy("doc_id").agg(F.max("is_abusive").alias("y"))
    sample = one.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_labels)
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")  # at most max_labels rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = [token_hashes(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"].astype("int32"), "n": [len(x) for x in h], "h": [x.tobytes() for x in h]})

    found = materialize(texts.select("doc_id", "y", "text").mapInPandas(run, "doc_id bigint, y int, n bigint, h binary"), "labelled")
    # At most max_labels numbers come first, then the hashes of the documents within the bound.
    order = found.select("doc_id", "n").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").collect()
    total, kept = 0, []
    for r in order:
        if total + r.n <= max_tokens:
            total += r.n
            kept.append((r.doc_id,))
    rows = found.join(F.broadcast(docs.sparkSession.createDataFrame(kept, "doc_id bigint")), "doc_id").collect()
    return [(np.frombuffer(r.h, np.uint32), int(r.y > 0)) for r in sorted(rows, key=lambda r: (r.doc_id, r.h))]


def document_logits(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """(doc_id, source, logit) of every document; a text without tokens has minus infinity."""
    used = np.flatnonzero(model)
    shared = docs.sparkSession.sparkContext.broadcast((used.astype(np.int32), model[used], len(model)))  # L1 leaves a few thousand of 2^20 weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, values, n = shared.value
        dense = np.zeros(n, np.float32)
        dense[at] = values
        for b in batches:
            logits = np.empty(len(b))
            at_row, group, size = [], [], 0
            for i, text in enumerate(b["text"]):
                h = token_hashes(text)
                at_row.append(i)
                group.append(h)
                size += len(h)
                if size >= SCORED_AT_ONCE or i + 1 == len(b):
                    logits[at_row] = logits_of(dense, Texts(group))
                    at_row, group, size = [], [], 0
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "logit": logits})

    return docs.select("doc_id", "source", "text").mapInPandas(run, "doc_id bigint, source string, logit double")


def score(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, max_tokens: int = MAX_LABEL_TOKENS) -> DataFrame:
    """(doc_id, source, score, abusive) of every document; score is the highest window's probability, relative to the cut.

    Null, empty and blank texts score 0. Whole texts are scored, whatever their length; repeated documents each have their row. All labels of
    the sample give the weights; every labelled document is also scored once by a model that hasn't seen it, and those scores choose the cut.
    Both classes weigh there what they stand for: the share of abusive documents is what the model itself takes for abusive among all
    documents with text. Without both classes nothing is abusive.
    """
    labelled = labelled_hashes(docs, labels, max_labels, max_tokens)
    model, held = fit_tasks(docs.sparkSession, labelled)
    logits = materialize(document_logits(docs, model), "logits")
    share = logits.filter(F.col("logit") > float("-inf")).agg(F.avg((F.col("logit") >= 0).cast("double"))).first()[0] or 0.0
    cut = choose_cut(held, quiet_weight(share, labelled))[0]
    above = F.col("logit") - F.lit(float(cut))
    p = F.when(F.col("logit") > float("-inf"), 1 / (1 + F.exp(-F.greatest(F.least(above, F.lit(35.0)), F.lit(-35.0))))).otherwise(0.0)
    return logits.select("doc_id", "source", p.alias("score"), (above >= 0).alias("abusive"))


def quiet_weight(share: float, labelled: list[tuple[np.ndarray, int]]) -> float:
    """How many times as many documents a quiet labelled document stands for as an abusive one, if ``share`` of all are abusive."""
    loud = sum(y for _, y in labelled)
    quiet = len(labelled) - loud
    return (1 - share) / quiet / (share / loud) if 0 < share < 1 and loud and quiet else 1.0


def rates(scored: DataFrame) -> DataFrame:
    """Per source (null is one): documents, abusive documents, their rate and the mean score."""
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("abusive").alias("abusive"), F.round(F.count_if("abusive") / F.count(F.lit(1)), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score")
    )
