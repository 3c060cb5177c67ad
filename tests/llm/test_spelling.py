"""Spelling variants against brute force, and the automata."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from geofold.llm import spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, error):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % error else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    form, out = {}, []
    for w in words:
        others = sorted((x for x in words if near(w, x)), key=lambda x: (-words[x], x))
        form[w] = others[0] if others and words[others[0]] >= 5 * words[w] else None
        out.append((w, len(others)))
    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), words[w], k, words.get(form[w])) for w, k in out), key=repr)


def made():
    rng = np.random.default_rng(4)
    stems = ["".join(rng.choice(list("aeélnrst"), rng.integers(6, 12))) for _ in range(25)]
    words = []
    for s in stems:
        for _ in range(12):
            at, kind = int(rng.integers(0, len(s))), int(rng.integers(0, 3))
            words.append([s, s[:at] + s[at + 1 :], s[:at] + "xÿ×"[kind] + s[at:], s[:at] + "éa" + s[at + 1 :]][int(rng.integers(0, 4))])
    words += ["chainaaa", "chainaab", "chainabb", "chainbbb"]
    weight = np.array([1.0 / (1 + i % 9) ** 2 for i in range(len(words))])
    weight[-4:] = [0.02, 0.2, 2, 20]
    pick = lambda n: rng.choice(words, n, p=weight / weight.sum())
    rows = [(i, "1".join(w.upper() if j % 7 == 0 and w.isascii() else w for j, w in enumerate(pick(300))), "en", "s", 0) for i in range(40)]
    rows += [(i, "chainaaa " * 6 + "chainaab " * 30 + "chainabb " * 160, "en", "s", 0) for i in range(50, 52)]
    rows += [(100, "A" * 3000 + " ", "en", "s", 0)] * 6 + [(100, "A" * 2999 + "Č ž", "en", "s", 0)] * 5
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, "123 Ā ă", "en", "s", 0), (None, "withoutid " * 6, "en", "s", 0), (203, rows[0][1], "en", "s", 0), (203, rows[0][1], "en", "s", 0)]
    return rows


@pytest.mark.parametrize("error, piece", [(199, 4096), (3, 20), (1, 3)])
def test_variants_are_those_of_brute_force(spark, error, piece):
    rows = made()
    docs = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", "'w' AS word", "1 AS n", "true AS back", "2 AS bucket")
    got = spelling.group_variants(docs, error=error, piece=piece).collect()
    want = plain(rows, error)
    assert sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got), key=repr) == want
    assert error > 3 or any(w[0] == w[2] for w in want)
    assert error != 199 or (any(w[1] and w[1] != w[2] for w in want) and max(len(w[0]) for w in want) >= 2999)


def test_no_rows_and_bad_parameters(spark):
    assert spelling.group_variants(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError, match="letters"):
        spelling.group_variants(spark.createDataFrame([], DOCS), least_letters=5)


def test_automata_are_minimal_and_number_their_words():
    rng = np.random.default_rng(1)
    for _ in range(30):
        words = sorted({bytes(rng.choice(list(b"abc"), rng.integers(0, 8))) for _ in range(150)})
        a = spelling.Automaton(words)
        tails = {frozenset(w[i:] for w in words if w[:i] == p) for p in {w[:k] for w in words for k in range(len(w) + 1)} for i in [len(p)]}
        assert len(a) == len(tails) and a.words == len(words)
        for number, w in enumerate(words):
            state, passed = np.array([a.root]), 0
            for c in w:
                edge, there = a.step(state, np.array([c]))
                assert there[0]
                passed, state = passed + int(a.skip[edge[0]]), a.to[edge]
            assert passed == number and a.final[state[0]]
        exact = np.array([len(w) // 2 for w in words])
        query, found = a.near(words, np.zeros(len(words), np.int64))
        assert list(zip(query.tolist(), found.tolist(), strict=True)) == [(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if near(x, y)]
        query, found = a.near(words, exact)
        assert all(words[j][: exact[i]] == words[i][: exact[i]] for i, j in zip(query, found, strict=True))
