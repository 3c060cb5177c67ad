"""Importance resampling against a plain one, and its suffix arrays."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from geofold.llm import checksum, resampling
from geofold.llm.words import Words, flat

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def features(text, max_n=3):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, buckets, least, share, seed=42):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [features(r[1]) for r in rows]
    s, t = Counter(bucket(f) for _, x in own for f in x), Counter(bucket(f) for r in target for f in features(r[0])[1])
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (s.total() + buckets)) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for r, (n, x) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in x)
        out.append([r[0], n, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    long = sorted((o for o in out if o[1] >= least), key=lambda o: (-o[4], o[0] is None, o[0] or 0))
    drawn = long[: len(long) * share[0] // share[1]]
    rank = {id(o): i + 1 for i, o in enumerate(drawn)}
    return sorted(((*o, rank.get(id(o))) for o in out), key=repr)


def made():
    rng = np.random.default_rng(5)
    pool = ["The", "the", "cat's", "SAT", "é", "École", "x1", "日本", "—", "_", "a-b"]
    rows = [(i, " ".join(rng.choice(pool, rng.integers(0, 60))), "en", "s", 0) for i in range(120)]
    rows += [(200 + i, "the cat sat on the mat " * 5, "en", "s", 0) for i in range(30)] + [(300, rows[3][1], "en", "s", 0)] * 3
    rows += [(400, None, None, None, None), (401, "", "en", "s", 0), (402, " \t\n.,", "en", "s", 0), (None, "no id " * 12, "en", "s", 0), (403, "x " * 5000, "en", "s", 0), (404, "z" * 5000, "en", "s", 0)]
    return rows


@pytest.mark.parametrize("block, share", [(1 << 19, (5, 100)), (7, (50, 100)), (1, (1, 1))])
def test_ranks_are_those_of_a_plain_resampling(spark, monkeypatch, block, share):
    monkeypatch.setattr(resampling, "BLOCK", block)
    monkeypatch.setattr(resampling.buckets_of, "__defaults__", (block,))
    rows, target = made(), [("the cat sat. École",), (None,), ("",), ("日本 x1 x1",)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", "'a' AS bucket", "1 AS rank", "2 AS weight", "3 AS __n")
    got = resampling.resample(docs, spark.createDataFrame(target, "text string"), buckets=50, share=share).collect()
    mine = sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=repr)
    assert mine == plain(rows, target, 50, 20, share)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert resampling.resample(none, none).collect() == []
    docs = spark.createDataFrame([(1, "a b " * 20, "en", "s", 0)], DOCS)
    assert [(r.n_features, r["rank"]) for r in resampling.resample(docs, none, share=(1, 1)).collect()] == [(40 + 39 + 38, 1)]


def test_suffix_array_orders_suffixes_and_gives_common_prefixes():
    rng = np.random.default_rng(2)
    for depth in (1, 2, 3, 5):
        sizes = rng.integers(0, 12, 30)
        ids = rng.integers(0, 3, sizes.sum())
        ends = np.repeat(np.cumsum(sizes), sizes)
        a = resampling.SuffixArray(ids, ends - np.arange(len(ids)), depth)
        cut = [tuple(ids[i : min(i + depth, ends[i])]) for i in range(len(ids))]
        own = [cut[i] for i in a.order]
        assert own == sorted(own)
        common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert a.lcp.tolist() == [0, *(common(x, y) for x, y in zip(own, own[1:], strict=False))]
        places, run, _ = a.runs(depth)
        of = dict(zip(places.tolist(), run.tolist(), strict=True))
        assert len(set(of.values())) == len({cut[i] for i in of}) and all(len(cut[i]) == depth for i in of)


def test_checksums_of_strings_put_together():
    rng = np.random.default_rng(0)
    a, b = ([rng.bytes(int(k)) for k in rng.integers(0, 1500, 200)] for _ in range(2))
    crc = lambda x: np.array([zlib.crc32(s) for s in x], np.uint32)
    assert checksum.appended(crc(a), crc(b), np.array([len(s) for s in b])).tolist() == crc([s + t for s, t in zip(a, b, strict=True)]).tolist()


def test_very_long_texts_in_one_batch():
    text = " ".join(f"w{i % 977}" for i in range(300_000))
    words = Words(*flat(pa.array([text, None, text])), resampling.KINDS)
    total = np.zeros(10_000, np.int64)
    for _, room, parts in resampling.buckets_of(words, 3, 10_000, 50_000):
        for n, own in enumerate(parts, 1):
            total += np.bincount(own[room >= n], minlength=10_000)
    want = Counter(zlib.crc32(f.encode()) % 10_000 for f in features(text)[1])
    assert {int(i): int(total[i]) for i in np.flatnonzero(total)} == {k: 2 * v for k, v in want.items()}
