"""Scores of the backoff automaton against a plain one, and its parts."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from geofold.llm import lm
from geofold.llm.words import LOWER, distinct_sorted, fast_order, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{a}{b}" for a in "abcdefgh" for b in "kl"]


def made():
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(WORDS, rng.integers(0, 40))), "en", "s", 0) for i in range(150)]
    rows += [(500 + i, rows[3][1] + " Rare" + str(i % 3), "en", "s", 0) for i in range(20)]
    rows += [(700 + i, "the " + " the ".join(rng.choice(WORDS, 30)), "en", "s", 0) for i in range(30)]
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "a null id", "en", "s", 0), (902, " \t\n ", "en", "s", 0), (903, "x " * 3000 + "y", "en", "s", 0), (904, "One", "en", "s", 0), (904, "One", "en", "s", 0), (905, "é" * 90 + " É", "en", "s", 0)]
    return rows


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def plain_scores(rows, order):
    """Each n-gram's probability by the recursion, in Python's dictionaries."""
    texts = [[*lower(r[1]), b"\n"] for r in rows]
    train = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 != 0 for r in rows]
    single = Counter(w for t, own in zip(texts, train, strict=True) if own for w in t)
    n, v = sum(single.values()), len(single)
    grams = {o: Counter() for o in range(2, order + 1)}
    histories = {o: Counter() for o in grams}
    steps = [[tuple(([b"<s>"] * (order - 1) + t)[i : i + order]) for i in range(len(t))] for t in texts]
    for own, t in zip(train, steps, strict=True):
        for g in t if own else ():
            for o in grams:
                grams[o][g[-o:]] += 1
                histories[o][g[-o:-1]] += 1
    failure = {o: defaultdict(lambda: 1.0) for o in grams}
    for o in grams:
        for g, c in grams[o].items():
            if c >= 2:
                failure[o][g[:-1]] -= (c - 0.75) / histories[o][g[:-1]]
    out = []
    for r, own, t in zip(rows, train, steps, strict=True):
        base = score = 0.0
        for g in t:
            p = (single[g[-1]] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            for o in grams:
                c = grams[o][g[-o:]]
                p = (c - 0.75 if c >= 2 else 0) / max(histories[o][g[-o:-1]], 1) + failure[o][g[-o:-1]] * p
            score += math.log10(p)
        out.append((r[0] or -1, not own, len(t), sum(single[g[-1]] > 0 for g in t), n, round(base, 4), round(score, 4)))
    return sorted(out)


@pytest.mark.parametrize("order, bucket_tokens, sample, piece, held", [(3, 2_000_000, 64, 1024, 2_500_000), (3, 40, 1, 50, 300), (2, 2_000_000, 1, 1024, 2_500_000), (4, 200, 1, 64, 100)])
def test_scores_match_a_plain_automaton(spark, monkeypatch, order, bucket_tokens, sample, piece, held):
    monkeypatch.setattr(lm, "PIECE", piece)
    monkeypatch.setattr(lm, "HELD", held)
    rows = made()
    docs = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", "1 AS g", "'clash' AS path", "2 AS row", "true AS train")
    got = lm.score(docs, order=order, bucket_tokens=bucket_tokens, hot_sample=sample).collect()
    mine = sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got)
    assert mine == plain_scores(rows, order)


def test_scoring_of_nothing_and_without_training_rows(spark):
    assert lm.score(spark.createDataFrame([], DOCS)).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = lm.score(spark.createDataFrame([(only, "one two", "en", "s", 0)], DOCS)).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(True, 3, 0, 0, 0.0, 0.0)]


def test_texts_that_occur_twice_score_above_others(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(WORDS, 60)), "en", "s", 0) for i in range(300)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    again = [(1000 + i, rows[i][1], "en", "s", 0) for i in range(0, 40) if zlib.crc32(str(1000 + i).encode()) % 10]
    twice = {r[0] for r in again} | {rows[r[0] - 1000][0] for r in again}
    got = lm.score(spark.createDataFrame(rows + again, DOCS), order=4).collect()
    per_token = lambda own: [r.score / r.n_tokens for r in got if (r.doc_id in twice) == own]
    assert min(per_token(True)) > max(per_token(False))


def test_probabilities_of_every_state_sum_to_one():
    rows = [(r[0], r[1]) for r in made() if r[0] is not None and r[1]]
    words = sorted({w.decode() for r in rows for w in lower(r[1])} | {"unseen"})
    for h in ("wak wal", "the", "rare1"):
        p = _last_token(rows, [(1, f"{h} {w}") for w in words] + [(0, h)])
        assert sum(p) == pytest.approx(1.0, abs=1e-9)


def _last_token(rows, asked):
    """Probability of each asked text's last word (or of the end, for id 0) by the operator's own counting and transitions, without Spark."""
    texts = [t for _, t in rows] + [t for _, t in asked]
    train = np.array([True] * len(rows) + [False] * len(asked))
    bits = lm.Bits(10_000, 3)
    grams = lm.Grams(pa.array(texts), np.zeros(len(texts), int), np.array([True] * len(rows) + [i == 0 for i, _ in asked]), 3, {}, bits)
    blob = [(1, 0, 9, 0, k, lm.pack_sorted(d), lm.pack(c)) for k, (who, keys) in grams.keys.items() if len(keys) for d, c in [lm.counted(keys, train[grams.text[who]])]]
    t = lm._sum(pa.Table.from_pylist([dict(zip(("g", "first", "final", "bucket", "kind", "keys", "counts"), b, strict=True)) for b in blob]), bits)
    counts, states, n, v = {}, {}, 0, 0
    for r in t.to_pylist():
        n, v = n + r["tokens"], v + r["distinct"]
        if r["kind"]:
            keys = np.unique(grams.keys[r["kind"]][1])
            counts[r["kind"]] = lm.unpack(r["counts"], len(keys))
            if r["kind"] > 1:
                states[r["kind"]] = lm.unpack(r["states"], 3 * len(np.unique(bits.state(r["kind"], keys)))).reshape(3, -1)
    _, _, p = lm.transitions(grams, counts, states, lm.HotStates([], n, v), 3, bits)
    ends = np.cumsum(np.bincount(grams.text, minlength=len(texts))) - 1
    return p[ends[len(rows) :]].tolist()


def test_words_and_orders():
    texts = [None, "", " a\tbB  \x0b", "x" * 200, "é B", "a"]
    w = words_of(pa.array(texts))
    plain = [x for t in texts for x in lower(t)]
    assert w.counts.tolist() == [0, 0, 2, 1, 2, 1] and len(set(w.hashes(LOWER).tolist())) == len(set(plain))
    assert w.hashes(LOWER)[0] == w.hashes(LOWER)[-1] and w.hashes()[1] != w.hashes(LOWER)[1]
    cut = words_of(pa.array(texts).slice(4))
    assert cut.hashes(LOWER).tolist() == w.hashes(LOWER)[3:].tolist()
    assert len({int(words_of(pa.array(["y" * n])).hashes()[0]) for n in range(1, 300)}) == 299
    x = np.random.default_rng(0).integers(0, 1 << 64, 5000, np.uint64)
    x[::3] = x[0] + (np.arange(len(x[::3])) % 5).astype(np.uint64)
    assert fast_order(x).tolist() == np.argsort(x, kind="stable").tolist() and distinct_sorted(x).tolist() == sorted(set(x.tolist()))
    for n in (0, 1, 2, 3):
        assert fast_order(x[:n]).tolist() == np.argsort(x[:n], kind="stable").tolist()
    assert True
    assert (lm.unpack(lm.pack(x), len(x)) == x).all() and (lm.unpack_sorted(lm.pack_sorted(np.sort(x))) == np.sort(x)).all()
