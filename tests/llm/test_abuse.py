"""Problem 10: normalisation, the learner, and held-out accuracy."""

import random

import numpy as np
import pytest
from tracewright.llm import abuse as ab


@pytest.mark.parametrize("text, want", [("1mb3c1l3", ["imbecile"]), ("s h i t", ["shit"]), ("s-h-i-t", ["shit"]), ("fuuuuck", ["fuck"]), ("ｔｒａｓｈ", ["trash"]), ("раrаsitе", ["parasite"]), ("m​oron", ["moron"]), ("f**k", ["f**k"]), ("废-物", ["废", "物"]), ("白 痴", ["白", "痴"]), ("12,345.6", ["#"]), (None, []), ("", [])])
def test_spelling_tricks(text, want):
    assert ab.tokens(text) == want


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(0)
    m = ab.Ftrl()
    for _ in range(60):
        y = (rng.random(50) < 0.3).astype(int)
        rows = np.sort(np.column_stack([rng.integers(100, 5000, (50, 6)), np.where(y, 7, 0)]), axis=1)
        rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = 0
        m.learn(rows, y)
    assert m.w[7] > 2 and (m.w != 0).sum() < 4000 and abs(m.w[100:5000]).max() < m.w[7] and m.w[0] == 0


def slow_windows(f, w):
    """(best sum, start, length) of one document's buckets, by trying every window."""
    best = (-np.inf, 0, 0)
    for size in sorted({min(x, len(f)) for x in ab.WINDOWS}, reverse=True):
        for i in range(len(f) - size + 1):
            s = float(w[f[i : i + size]].sum(dtype=np.float64))
            if size and s > best[0] + 1e-9:
                best = (s, i, size)
    return best


def test_windows_of_many_documents_at_once():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 2**32, n, dtype=np.uint32) for n in (0, 1, 3, 4, 5, 13, 14, 15, 60, 0, 7, 200)]
    w = np.round(rng.normal(size=ab.BUCKETS), 3)
    w[0] = 0
    t = ab.Texts(docs)
    best, start, length = t.best_windows(w)
    tiles = list(zip(*t.tiles(np.arange(len(docs)))))
    for i, d in enumerate(docs):
        alone = ab.Texts([d]).buckets
        assert (alone == t.buckets[t.starts[i] : t.ends[i]]).all()
        s, a, n = slow_windows(alone, w)
        assert (best[i] == s or abs(best[i] - s) < 1e-6) and length[i] == n and (not n or start[i] - t.starts[i] == a)
        mine = [(a - t.starts[i], n) for a, n in tiles if t.starts[i] <= a < t.ends[i]]
        assert mine == [(k, min(14, len(d) - k)) for k in range(0, max(1, len(d) - 14 + ab.STRIDE), ab.STRIDE) if len(d)]
    rows = t.examples(start, length)
    for i in range(len(docs)):
        assert sorted(set(rows[i]) - {0}) == sorted(set(t.buckets[start[i] : start[i] + length[i]].ravel()) - {0})


QUIET = "the ledger and the statement differ by the fee column mixes two currencies so far nobody has answered ticket row confirms no link is proven".split()


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(QUIET) for _ in range(rng.randrange(5, 120))]
        y = int(rng.random() < 0.2)
        if y:
            at = rng.randrange(len(words) + 1)
            words[at:at] = ["you", rng.choice(["useless", "worthless", "stinking"]), rng.choice(["m o r o n", "idiot", "1d10t", "ｉｄｉｏｔ", "moron"]), rng.choice(["get lost", "go rot"])]
        elif rng.random() < 0.3:
            words.insert(0, rng.choice(["worthless share certificate", "useless column", "kill the worker"]))
        rows.append((i, " ".join(words), y))
    return rows


def test_held_out_accuracy(spark):
    labelled = [(ab.token_hashes(t), y) for _, t, y in corpus(700, 1)]
    model, scores = ab.fit_tasks(spark, labelled)
    cut = ab.choose_cut(scores, 1.0)[0]
    held = corpus(500, 2)
    got = ab.logits_of(model, ab.Texts([ab.token_hashes(t) for _, t, _ in held])) >= cut
    assert len(scores) == 700 and np.mean([g == bool(y) for g, (_, _, y) in zip(got, held)]) > 0.97


def test_the_sample_is_bounded_in_documents_and_tokens(spark):
    docs = spark.createDataFrame([(i, "word " * (1000 if i == 3 else 10)) for i in range(20)] + [(21, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i == 3)) for i in range(22)], "doc_id bigint, is_abusive int")
    whole = ab.labelled_hashes(docs, labels)
    assert len(whole) == 20 and sum(y for _, y in whole) == 1
    assert [len(h) for h, _ in ab.labelled_hashes(docs, labels, max_tokens=105)] == [10] * 10  # the long one doesn't fit, whole ones do
    assert len(ab.labelled_hashes(docs, labels, max_labels=7)) in (6, 7)


def test_documents(spark):
    rows = corpus(300, 3)
    docs = spark.createDataFrame([(i, t, "s" if i % 2 else None, "x") for i, t, _ in rows] + [(9001, None, "s", ""), (9002, "", "s", ""), (9003, " \n", "s", ""), (9004, "you useless moron go rot " + "the fee column " * 30000, "s", "")], "doc_id bigint, text string, source string, score string")
    labels = spark.createDataFrame([(i, y, "c") for i, _, y in rows[:250]] + [(None, 1, "c"), (5, None, "c"), (777777, 1, "c")], "doc_id bigint, is_abusive int, category string")
    got = {r.doc_id: r for r in ab.score(docs, labels).collect()}
    assert len(got) == 304 and all(got[k].score == 0 and not got[k].abusive for k in (9001, 9002, 9003)) and got[9004].abusive
    assert np.mean([got[i].abusive == bool(y) for i, _, y in rows[250:]]) > 0.9
    rates = {r.source: r for r in ab.rates(ab.score(docs, labels)).collect()}
    assert rates["s"].documents == 154 and rates[None].documents == 150
    none = ab.score(docs, labels.limit(0)).collect()
    assert len(none) == 304 and not any(r.abusive for r in none)
    assert ab.score(docs.limit(0), labels).count() == 0


def test_cut_does_not_depend_on_the_number_of_documents(spark):
    rows = corpus(300, 4)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "doc_id bigint, text string, source string")
    more = docs.crossJoin(spark.range(20).withColumnRenamed("id", "k")).selectExpr("doc_id + k * 1000 AS doc_id", "text", "source")
    wrong = [i for i, _, y in rows if y][:6]  # abusive documents labelled as quiet
    labels = spark.createDataFrame([(i, 0 if i in wrong else y, "c") for i, _, y in rows], "doc_id bigint, is_abusive int, category string")
    few, many = ({r.doc_id: r for r in ab.score(d, labels).filter("doc_id < 1000").collect()} for d in (docs, more))
    assert {i: (r.score, r.abusive) for i, r in few.items()} == {i: (r.score, r.abusive) for i, r in many.items()}
    assert np.mean([many[i].abusive for i, _, y in rows if y]) > 0.9
