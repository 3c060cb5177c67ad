"""Code lengths of the context trees against a plain coder, and languages of held-out texts."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from geofold.llm import language_id
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text, order):
    return b"\n" * order + bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())


class Plain:
    """Counts by context in dictionaries; escapes with exclusion, symbol by symbol."""

    def __init__(self, texts, order, least=1):
        self.order, self.of = order, defaultdict(Counter)
        for t in texts:
            b = lowered(t, order)
            for i in range(order, len(b)):
                for k in range(order + 1):
                    self.of[b[i - k : i]][b[i]] += 1
        self.of = {c: kept for c, n in self.of.items() if (kept := {s: k for s, k in n.items() if k >= least})}

    def p(self, context, symbol):
        out, gone = 1.0, set()
        for k in range(self.order, -1, -1):
            n = {s: c for s, c in self.of.get(context[len(context) - k :], {}).items() if s not in gone}
            if not n:
                continue
            total = sum(n.values()) + len(n)
            if symbol in n:
                return out * n[symbol] / total
            out *= len(n) / total
            gone |= set(n)
        return out / (256 - len(gone))

    def bits(self, text):
        b = lowered(text, self.order)
        return -sum(math.log2(self.p(b[i - self.order : i], b[i])) for i in range(self.order, len(b)))


def made():
    rng = np.random.default_rng(6)
    parts = {"aa": ["the", "and", "ing", "er", "tion", "Is"], "bb": ["der", "und", "ß", "ung", "ein", "Äh"], "cc": ["que", "é", "ment", "la", "Les", "ö"]}
    word = lambda lang: "".join(rng.choice(parts[lang], rng.integers(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.integers(2, 40))), lang, "s", 0) for i, lang in enumerate(rng.choice(list(parts), 240))]
    return rows + [(500, None, "aa", None, None), (501, "", "bb", "s", 0), (502, "12 34 ...", "cc", "s", 0), (503, rows[0][1], None, "s", 0), (None, rows[1][1], rows[1][2], "s", 0), (504, "the and " * 4000, "aa", "s", 0), (rows[2]), (rows[2])]


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4


@pytest.mark.parametrize("order, nodes, block", [(4, 2_000_000, 1 << 20), (2, 300, 50), (0, 2_000_000, 1), (6, 800, 1000)])
def test_predictions_are_those_of_a_plain_coder(spark, monkeypatch, order, nodes, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    monkeypatch.setattr(language_id, "HELD", 1 << 21 if order == 4 else 100)
    rows = [r for r in made() if block > 40 or not r[1] or len(r[1]) < 200]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", "1 AS window", "'x' AS lang_pred", "true AS held_out", "0 AS readable")
    train = [r for r in rows if fold(r[0]) != 2 and r[1] is not None and r[2] is not None]
    model = language_id.train(spark.createDataFrame(train, DOCS).repartition(2), F.col("lang"), F.col("text"), order, nodes)
    counts = Counter(r[2] for r in train)
    held = sum(len(level[0]) for t in model.trees for level in t.levels)
    whole = sum(len(n) for x in counts for n in Plain([r[1] for r in train if r[2] == x], order).of.values())
    least = 1
    while sum(len(n) for x in counts for n in Plain([r[1] for r in train if r[2] == x], order, least).of.values()) > nodes:
        least *= 2
    assert held <= nodes and (held == whole) == (least == 1) and model.langs == sorted(counts)
    trees = {x: Plain([r[1] for r in train if r[2] == x], order, least) for x in counts}
    got = {(r.doc_id, r.held_out, r.lang_pred, round(r.score, 3)) for r in language_id.identify(docs, order=order, nodes=nodes).collect()}
    for doc_id, text, *_ in rows:
        pred, score = "und", 0.0
        if text and any(c.isalpha() for c in text):
            bits = {x: t.bits(text) - math.log2(counts[x] / counts.total()) for x, t in trees.items()}
            pred = min(sorted(bits), key=bits.get)
            score = 1 / sum(2 ** min(0.0, max(-1000, bits[pred] - b)) for b in bits.values())
        assert any(g[:3] == (doc_id, fold(doc_id) == 2, pred) and abs(g[3] - score) < 0.002 for g in got), (doc_id, pred, score)


def test_probabilities_of_all_bytes_sum_to_one_and_lengths_are_those_of_the_plain_coder(spark):
    texts = ["the thing and the other thing", "Athing", "", "zz"]
    docs = spark.createDataFrame([(i, t, "aa", "s", 0) for i, t in enumerate(texts)], DOCS)
    model, plain = language_id.train(docs, F.col("lang"), F.col("text"), 3), Plain(texts, 3)
    for before in (b"\n\n\n", b"the", b" th", b"qqe", b"zzz", b"qqq", b"\xff\x00\x01"):
        window = (np.uint64(int.from_bytes(before, "big")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        bits = model.trees[0].bits(window)
        assert abs(np.exp2(-bits).sum() - 1) < 1e-9
        assert np.allclose(bits, [-math.log2(plain.p(before, s)) for s in range(256)])
    for t in ("the other", "Something é", "z"):
        assert abs(model.totals(pa.array([t, None]))[0, 0] / language_id.UNIT - plain.bits(t)) < 0.001


def test_a_full_memory_gives_the_same_lengths(spark, monkeypatch):
    docs = spark.createDataFrame(made(), DOCS)
    model = language_id.train(docs, F.col("lang"), F.col("text"))
    texts = pa.array([r[1] for r in made()])
    first, again = model.totals(texts), model.totals(texts)
    monkeypatch.setattr(language_id, "KNOWN_BITS", 3)
    model.keys = None
    assert np.array_equal(first, again) and np.array_equal(first, model.totals(texts))


def test_without_rows_or_languages(spark):
    assert language_id.identify(spark.createDataFrame([], DOCS)).collect() == []
    got = language_id.identify(spark.createDataFrame([(1, "abc", None, "s", 0), (2, None, "aa", "s", 0)], DOCS)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2


def test_held_out_documents_of_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 200 and np.mean([r.lang_pred == r.lang for r in got]) > 0.99
