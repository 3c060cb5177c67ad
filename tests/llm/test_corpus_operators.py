"""Corpus operators against brute force and on their defined edge cases."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geofold.llm import classifier, html_text, line_rules, lm, mixing, packing, sharding, simhash, topk, url_rules
from geofold.llm.queries import URL_RULES, tokenizer_path
from geofold.operators.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def made(n, seed=0, words=(5, 120)):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lines = [" ".join(rng.choice(WORDS, rng.integers(3, 12))) for _ in range(max(1, rng.integers(*words) // 8))]
        out.append((i, "\n".join(lines), "en", f"s{rng.integers(0, 4)}" if i % 3 else "s0", len("\n".join(lines))))
    return out


EDGES = [
    (1000, None, None, None, None), (1001, "", "en", "s1", 0), (None, "a null id has text too", "en", "s0", 22), (1002, " \t\n ", "en", "s1", 4),
    (1003, "same words " * 30, "en", "s1", 330), (1003, "same words " * 30, "en", "s1", 330), (1004, "x " * 40_000, "de", "s2", 80_000), (1005, "one", "en", None, 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = made(120)
    copies = [(500 + i, rows[i % 5][1], "en", "s1", rows[i % 5][4]) for i in range(40)]
    near = [(700 + i, rows[7][1] + f" tail{i}", "en", "s2", 0) for i in range(25)]
    return spark.createDataFrame(rows + copies + near + EDGES, DOCS).withColumn("bucket", F.lit(1)).withColumn("key", F.lit("x"))


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def union_find(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


# ---- 1


def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_all_pairs(docs, rows):
    fps = [slow_fingerprint(r.text) for r in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = union_find(len(rows), linked)
    first = {}
    for r, k in zip(rows, root, strict=True):
        first[k] = min([x for x in (first.get(k), r.doc_id) if x is not None], default=None)
    expected = Counter((r.doc_id, f"{fp:016x}", first[k]) for r, fp, k in zip(rows, fps, root, strict=True))
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, got)) == expected


@pytest.mark.parametrize("block", [3, 50_000])
def test_links_reach_all_close_fingerprints(spark, block):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set()
    for b in base:
        for _ in range(12):
            fps.add(int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 6), replace=False)))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = simhash.links(nodes, block).collect()
    at = {f: i for i, f in enumerate(fps)}
    unsigned = lambda x: x % (1 << 64)
    assert all((unsigned(e.a) ^ unsigned(e.b)).bit_count() <= 4 for e in edges)
    got = union_find(len(fps), [(at[unsigned(e.a)], at[unsigned(e.b)]) for e in edges])
    want = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    same = lambda r: {frozenset(i for i in range(len(r)) if r[i] == k) for k in set(r)}
    assert same(got) == same(want)


def test_some_segment_starts_a_chain_for_every_close_pair():
    rng = np.random.default_rng(1)
    for bits in range(5):
        x = np.array([sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(300)], np.uint64)
        assert np.any([simhash.chained(x, i) for i in range(5)], axis=0).all()


def test_keep_first_keeps_one_of_each_group(docs, rows):
    groups = simhash.near_duplicates(docs).select("component_id", "fingerprint").distinct().collect()
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    n = len({g.component_id for g in groups if g.component_id is not None}) + sum(g.component_id is None for g in groups)
    assert len(ids) == n and {500, 501, 510}.isdisjoint(ids)


def test_components_of_a_star_a_chain_and_a_loop(spark):
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(70)] + [(300, 301), (301, 302), (302, 300), (9, 9)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(60)) and all(got[i] == 100 for i in range(100, 171)) and got[302] == 300
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 2


def check_pieces(pieces, texts, most=1024):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for key, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(by_doc[key], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = total = 0
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= most
        total += at
        padding += 0 if at & (at - 1) == 0 else most - at
    return padding / max(total, 1)


def test_packing_is_a_round_trip(docs, rows):
    odd = [(2000, "a  b\t\tc \n\n d é…—<|endoftext|>'s 12 345\u3000x\x1c y", None, None, 0), (2001, "\nline\n", None, None, 0)]
    all_docs = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars").unionByName(docs.sparkSession.createDataFrame(odd, DOCS))
    texts = {r.doc_id: r.text for r in all_docs.collect()}
    pieces = packing.pack_documents(all_docs, tokenizer_path()).collect()
    assert check_pieces(pieces, texts) < 0.02


def test_packing_keeps_all_limits(spark):
    examples = spark.createDataFrame([(i, "prompt words " * (i % 40), "answer text " * (i % 25)) for i in range(300)], "doc_id long, prompt string, response string")
    pieces = packing.pack_examples(examples, tokenizer_path(), max_tokens=256, max_segments=4, max_loss=60, buffer=32).collect()
    sums = defaultdict(lambda: [0, 0, 0])
    for p in pieces:
        for k, v in enumerate((p.length, 1, p.loss_tokens)):
            sums[p.sequence_id][k] += v
    assert all(t <= 256 and s <= 4 and n <= 60 for t, s, n in sums.values())
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty, tokenizer_path()).collect() == []


# ---- 3


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_have_equal_bytes_and_gapless_slots(docs, rows, shards):
    got = sharding.shard_by_bytes(docs, shards).collect()
    sizes = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((g.doc_id, g.size, g.text_crc32) for g in got) == sizes
    slots, loads = defaultdict(list), Counter()
    for g in got:
        slots[g.shard].append(g.slot)
        loads[g.shard] += g.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    big = 80_016
    rest = [loads[s] for s in range(shards) if loads[s] < big]
    if shards > 1:
        assert max(rest) - min(rest) <= 0.05 * max(rest) + 400


def test_one_text_may_fill_many_shards(spark):
    rows = [(i, "hot text of a third of all rows" if i % 3 else f"text {i} " * 3, None, None, 0) for i in range(6000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, DOCS), 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    loads = [g.b for g in got]
    assert len(loads) == 8 and max(loads) - min(loads) <= 0.01 * max(loads) + 100


def test_equal_rows_fill_no_window(spark, monkeypatch):
    rows = [(7, "one text and one id", None, None, 0)] * 4000 + [(i, f"text {i} " * 3, None, None, 0) for i in range(2000)]
    most = []
    dealt = sharding._dealt
    monkeypatch.setattr(sharding, "_dealt", lambda placed, limit: (lambda out: most.append(out.groupBy("no", "part", "piece").count().agg(F.max("count")).first()[0]) or out)(dealt(placed, limit)))
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, DOCS), 8).collect()
    loads, slots = Counter(), defaultdict(list)
    for g in got:
        loads[g.shard] += g.size
        slots[g.shard].append(g.slot)
    assert len(got) == 6000 and max(loads.values()) - min(loads.values()) <= 100 and most[0] < 400
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_of_nothing(empty):
    assert sharding.shard_by_bytes(empty).collect() == []


# ---- 4


def test_base_facts_by_hand():
    text = b"a b c a b c\nx #y\nx #y\n\n\n z\n"
    assert line_rules.facts(text) == (11, 13, 2, 1, 6)
    words = [b"a"] * 5
    assert line_rules.repeated_words(words) == 5 and line_rules.repeated_words([b"a", b"b"]) == 0


def test_line_rules_remove_boilerplate_and_keep_the_rest(spark):
    rng = np.random.default_rng(2)
    body = lambda n: "\n".join(" ".join(f"{rng.choice(WORDS)}{rng.integers(1e6)}" for _ in range(12)) for _ in range(n))
    common = "  Cookie  notice number 123 of this HOST  "
    docs = [(i, common + "\n" + body(8), "en", "h", 0) for i in range(60)]
    docs += [(100 + i, "\n".join([common.replace("123", str(200 + i))] * 12) + "\nq " * 3 + body(1), "en", "h", 0) for i in range(5)]
    copied = body(9)
    docs += [(200 + i, copied, "en", "h", 0) for i in range(70)]
    df = spark.createDataFrame(docs, DOCS)
    got = {r.doc_id: r for r in line_rules.judge(df).collect()}
    assert all(got[i].kept and got[i].removed_words == 7 for i in range(60))
    assert not any(got[100 + i].kept for i in range(5)) and all(got[200 + i].kept for i in range(70))
    cleaned = {r.doc_id: r for r in line_rules.clean(df).collect()}
    assert "notice" not in cleaned[0].text and cleaned[0].n_chars == len(cleaned[0].text) and 100 not in cleaned
    assert cleaned[200].text == docs[65][1]


def test_line_rules_on_edges(docs, rows, empty):
    got = line_rules.judge(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1000].n_words == 0 and by[1000].base_failed and not by[1000].kept
    assert by[1003].n_repeat_words == 60 and by[1003].base_failed
    assert line_rules.judge(empty).collect() == [] and line_rules.clean(docs).columns == docs.columns


# ---- 5


def test_classifier_tells_held_out_documents_apart(spark):
    rng = np.random.default_rng(6)
    docs, labels = [], []
    for i in range(600):
        good = i % 4 > 0
        words = [rng.choice(WORDS) for _ in range(60)]
        docs.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), "en", "s", 0))
        labels.append((i, int(good)))
    docs += EDGES
    df, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels + [(1, 1), (None, 0), (5000, None)], "doc_id long, quality int")
    got = classifier.classify(df, known).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    again = classifier.classify(df.repartition(7), known).collect()
    assert sorted((r.doc_id or -1, round(r.score, 9)) for r in got) == sorted((r.doc_id or -1, round(r.score, 9)) for r in again)
    kept = classifier.keep_good(df, known)
    assert kept.columns == df.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 4").count() == 0


def test_classifier_without_labels(docs, rows, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in classifier.classify(docs, none).collect()} == {0.5}
    assert classifier.classify(empty, none).collect() == []


# ---- 6


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<html></html>", ""), ("plain &amp; simple", "plain & simple"),
        ("<body><nav><a href=x>Menu</a></nav><article><h1>T &eacute;</h1><p>One <b>two</b><br>three<p>Four</article><footer>&copy; x</footer>", "T é\n\nOne two three\n\nFour"),
        ("<div class='cookie-notice'>We use</div><div><h2>Head</h2><p>Body  text\n here</p></div><section id=comments><p>bad</p></section>", "Head\n\nBody text here"),
        ("<article><header><h1>A</h1></header><p>x</p><aside>no</aside><form><p>no</p></form><div class='advert'>no</div><p>y", "A\n\nx\n\ny"),
        ("<p>cut &am", "cut &am"), ("<p>cut <a hre", "cut"), ("<script>var t='</p>';</script><p>a<!-- <p>no -->b</p>", "ab"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_extract_keeps_every_row(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None), (2, "v", "<p>" + "long " * 50_000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(pages).collect()
    assert Counter((r.page_id, r.n_chars) for r in got) == Counter([(1, 1), (1, 1), (None, 0), (2, 249_999)])
    assert html_text.extract(pages.limit(0)).collect() == []


# ---- 7


def test_targets_fill_up_to_twice_a_source():
    assert mixing.targets([100, 100, 100]) == [200.0, 166.66666666666666, 83.33333333333333]
    assert mixing.targets([10, 1000, 1000])[0] == 20 and mixing.targets([]) == [] and sum(mixing.targets([5, 0, 9])) == pytest.approx(21)


def test_shard_counts_and_permutations():
    counts = mixing.shard_counts([100, 7, 0, 3000], shards=16)
    assert counts.sum(axis=0).tolist() == [100, 7, 0, 3000] and np.ptp(counts.sum(axis=1)) <= 1
    for n in (1, 2, 3, 1000, 4097):
        there = mixing.permuted(np.arange(n), n, 5)
        assert sorted(there.tolist()) == list(range(n)) and mixing.permuted(there, n, 5, back=True).tolist() == list(range(n))
        assert there[mixing._turn_of({"blocks": n}, 5 - 7 * 1_000_003, 7)] == n - 1


def test_mix_meets_targets(docs, rows, empty):
    got = mixing.digest(docs, block_words=16, shards=8).collect()
    size = lambda t: len((t or "").encode().split())
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, size(r.text)) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, mixing.targets([sizes[s] for s in names]), strict=True))
    source = {r.doc_id: r.source for r in rows}
    taken = Counter()
    for r in got:
        assert r.taken <= 2 * r.size and r.target == target[source[r.doc_id]] and r.source_size == sizes[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) < 1 for s in names)
    again = mixing.digest(docs, block_words=16, shards=8).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.digest(empty).collect() == []


def test_mixed_documents_hold_what_is_taken(docs):
    out = mixing.mixed_documents(docs.where("doc_id < 120")).collect()
    taken = {r.doc_id: r.taken for r in mixing.digest(docs.where("doc_id < 120")).collect()}
    assert {r.doc_id: len(r.text.split()) for r in out} == {k: v for k, v in taken.items() if v}
    assert mixing.taken_text("a b c\nd", [(1, 2), (0, 4)]) == "a b c\nd\nb c"


# ---- 8


def test_rules_and_trust(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a.com/", "<a href='http://b.net/x'>"), (2, "http://c.com/", "<a href=//A.com>"), (3, "http://b.net/q?x://y", None), (4, None, ""), (5, "https://G.org/fr/x", "<a href='https://H.com/'>"),
            (6, "http://h.com", ""), (7, "http://x.example.net/en/1", ""), (8, "http://y.example.com/de/", ""), (9, "http://notnet/", ""), (10, "nothing", ""), (6, "http://h.com", ""),
        ],
        "page_id long, url string, html string",
    )
    got = {r.page_id: r for r in url_rules.judge(pages, URL_RULES).collect()}
    verdicts = {k: (r.rule, r.verdict) for k, r in got.items()}
    assert verdicts == {1: (None, "block"), 2: (None, "allow"), 3: ("net/", "block"), 4: (None, "allow"), 5: ("org/fr/", "allow"), 6: (None, "allow"), 7: ("example.net/en/", "allow"), 8: ("example.com/de/", "block"), 9: (None, "allow"), 10: (None, "allow")}
    assert got[1].distrust_share == pytest.approx(1) and got[2].distrust_share == pytest.approx(0.85 / 1.85 * 1.0) and got[6].trust_share == pytest.approx(1)
    assert (got[3].host, got[3].path, got[4].host, got[5].host) == ("b.net", "/q", "", "g.org")
    assert url_rules.judge(pages, URL_RULES).count() == 11 and url_rules.judge(pages.limit(0), URL_RULES).count() == 0


# ---- 9


def test_search_is_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 12).astype(np.float32)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(8)] + [(50, rows[9][1])]
    odd = [(2000, None), (2050, [1.0, None] * 6), (2100, [float("nan")] * 12), (2150, [float("inf")] * 12), (2200, []), (2250, [0.5, 0.5]), (2251, [0.25, 1.0]), (None, rows[0][1]), (2300, [1e12] * 12)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5).selectExpr("*", "1 AS v", "'x' AS rank", "2 AS score", "3 AS query_id")
    got = topk.search(df, F.col("vec_id") % 50 == 0, 5, query_block=6).collect()
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows + odd[5:7] + odd[8:] if i is not None]
    for q, qv in usable:
        if q % 50 == 0 and q != 50:
            best = sorted((-min(sum(a * b for a, b in zip(qv, v)), (1 << 63) - 1), i) for i, v in usable if i != q and len(v) == len(qv))[:5]
            mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
            assert mine == [(n + 1, i, -s) for n, (s, i) in enumerate(best)], q
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_mixing_places_do_not_depend_on_ranges(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 7), "en", None if i % 11 == 0 else "ab"[i % 2], 9) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = {(r["doc_id"], r["start"]) for r in mixing.placed(docs).collect()}
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    monkeypatch.setattr(mixing, "RANGES_TOGETHER", 8)
    assert {(r["doc_id"], r["start"]) for r in mixing.placed(docs).collect()} == one
