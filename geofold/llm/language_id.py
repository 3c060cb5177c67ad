"""Language of a text by prediction by partial matching (PPM): the language whose model codes it in the fewest bits.

Each language has a tree of byte contexts of 0 to ``ORDER`` bytes, with the counts of the bytes that followed in all of its training texts (A-Z
lower-cased, ``ORDER`` line ends before each text). A byte is coded in the longest context that the tree holds; where the byte has not
followed, an escape leads to the context without its oldest byte, and what the longer context could have coded is left out there (exclusion):

    P(byte) = n / (T' + D'),  P(escape) = D' / (T' + D')

with n its count, T' and D' the sum and the number of the counts that are not left out (method C); an escape is free where nothing new is left.
Below the empty context all bytes left are alike. The statistics are frozen before a text is coded, so a byte's code length depends
on it and the ORDER bytes before it alone: it is computed once for each distinct window of bytes that a worker meets, in
1 / ``UNIT`` bits, and added up as whole numbers, so that results don't depend on batches.

Training counts windows of ORDER + 1 bytes in every task and sums them by key; shorter contexts are sums of longer ones. The trees together have at most
``NODES`` counts: where there are more, those under the least power of two that suffices go, and what starts in a lower context is still
there, as a shorter context's count is never lower. So the model has a fixed bound, and is what executors are sent.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as are all if nothing was learned; texts without language
or text teach nothing; a null id counts as the empty text in the split; very long texts are read whole, block by block; repeated rows are judged each; ties go to
the first language by name; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geofold.llm.common import doc_crc, mapped, stash, unstash
from geofold.llm.words import LOWER, flat

#: Bytes of the longest context, and the most that keys have room for.
ORDER, MOST = 4, 6
#: Counts that the trees of all languages hold, at most.
NODES = 2_000_000
UNIT = 1 << 16
UNKNOWN = "und"
#: Bytes that are looked at together; distinct windows that a counting task holds; windows that a worker remembers.
BLOCK, HELD, KNOWN_BITS = 1 << 20, 1 << 21, 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mask(length: int) -> np.uint64:
    return np.uint64((1 << 8 * length) - 1)


def windows(data: np.ndarray, ends: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first byte's place, text of each byte, window of each byte): the byte itself lowest, the order bytes before it above."""
    for a in range(0, len(data), BLOCK):
        z, from_ = min(a + BLOCK, len(data)), max(0, a - order)
        own = LOWER[data[from_:z]].astype(np.uint64)
        text = np.searchsorted(ends, np.arange(a, z), "right") - 1
        place = np.arange(a, z) - ends[text]
        window = np.zeros(z - a, np.uint64)
        for k in range(order + 1):
            before = own[max(0, a - from_ - k) : len(own) - k] if k else own[a - from_ :]
            before = np.r_[np.full(z - a - len(before), 10, np.uint64), before]
            window |= np.where(place >= k, before, np.uint64(10)) << np.uint64(8 * k)
        yield a, text, window


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, weights=counts).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(lang, window, n) of batches of lang and text, windows of a language summed until ``HELD`` are held."""
    held: dict[str, tuple[list, list]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, n = _summed(*parts)
            names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(keys), np.int32)), pa.array([lang])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "window", "n"])

    size = 0
    for b in batches:
        names = b.column(0).dictionary_encode()
        codes, langs = names.indices.to_numpy(), names.dictionary.to_pylist()
        for _, text, window in windows(*flat(b.column(1)), order):
            of = codes[text]
            for c in np.unique(of).tolist():
                keys, n = np.unique(window[of == c], return_counts=True)
                own = held.setdefault(langs[c], ([], []))
                own[0].append(keys)
                own[1].append(n)
                size += len(keys)
        if size > HELD:
            held.update({lang: tuple([x] for x in _summed(*parts)) for lang, parts in held.items()})
            size = sum(len(k[0]) for k, _ in held.values())
            if size > HELD // 2:
                yield from out()
                held, size = {}, 0
    yield from out()


class Tree:
    """Counts by context of one language, of all orders: sorted nodes (context and byte) and, for each context, the sum and number of its counts and the sum that they have in the next shorter context."""

    def __init__(self, nodes: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.levels = []
        for k in sorted(nodes):
            key, n = nodes[k]
            order = np.argsort(key)
            key, n = key[order], n[order]
            heads = np.flatnonzero(np.r_[True, (key[1:] >> np.uint64(8)) != (key[:-1] >> np.uint64(8))])
            below = np.zeros(len(n), np.int64)
            if k:
                lower_key, lower_n = self.levels[-1][:2]
                below = lower_n[np.searchsorted(lower_key, key & _mask(k))]
            add = lambda x: np.add.reduceat(x, heads) if len(x) else x  # noqa: B023, E731
            self.levels.append((key, n, key[heads] >> np.uint64(8), add(n), np.diff(np.r_[heads, len(key)]), add(below)))

    def bits(self, window: np.ndarray) -> np.ndarray:
        """Code lengths of the lowest bytes of windows, in bits."""
        out = np.zeros(len(window))
        todo = np.arange(len(window))
        less_n, less_d = np.zeros(len(window), np.int64), np.zeros(len(window), np.int64)  # what longer contexts could have coded
        for k in range(len(self.levels) - 1, -1, -1):
            key, n, contexts, total, kinds, below = self.levels[k]
            context = (window[todo] >> np.uint64(8)) & _mask(k)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            known = todo[contexts[at] == context]
            at = at[contexts[at] == context]
            node = np.searchsorted(key, window[known] & _mask(k + 1))
            node = np.minimum(node, len(key) - 1)
            there = key[node] == window[known] & _mask(k + 1)
            left, new = total[at] - less_n[known], kinds[at] - less_d[known]
            out[known[there]] += np.log2((left[there] + new[there]) / n[node[there]])
            gone, at, left, new = known[~there], at[~there], left[~there], new[~there]
            out[gone] += np.log2((left + new) / np.maximum(new, 1), where=new > 0, out=np.zeros(len(new)))
            less_n[gone], less_d[gone] = below[at], kinds[at]
            todo = np.setdiff1d(todo, known[there], assume_unique=True)
        out[todo] += np.log2(256 - less_d[todo])
        return out


class Model:
    """Trees of all languages, and a memory of windows' code lengths in each worker."""

    def __init__(self, langs: list[str], trees: list[Tree], prior: np.ndarray, order: int):
        self.langs, self.trees, self.prior, self.order = langs, trees, prior, order
        self.keys = None

    def __getstate__(self):
        return self.__dict__ | {"keys": None, "known": None}

    def lengths(self, window: np.ndarray) -> np.ndarray:
        """Code lengths of windows in every language, in 1 / ``UNIT`` bits."""
        if self.keys is None:
            self.keys, self.known = np.full(1 << KNOWN_BITS, ~np.uint64(0)), np.zeros((1 << KNOWN_BITS, len(self.langs)), np.int32)
        slot = ((window * _MIX) >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)
        out = self.known[slot]
        new = np.flatnonzero(self.keys[slot] != window)
        if len(new):
            distinct, first, at = np.unique(window[new], return_index=True, return_inverse=True)
            found = np.rint(np.array([t.bits(distinct) for t in self.trees]).T * UNIT).astype(np.int32)
            out[new] = found[at]
            slots, who = np.unique(slot[new[first]], return_index=True)
            self.keys[slots], self.known[slots] = distinct[who], found[who]
        return out

    def totals(self, column) -> np.ndarray:
        """Code lengths of texts in every language, in 1 / ``UNIT`` bits."""
        data, ends = flat(column)
        out = np.zeros((len(ends) - 1, len(self.langs)), np.int64)
        for _, text, window in windows(data, ends, self.order):
            heads = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            out[text[heads]] += np.add.reduceat(self.lengths(window), heads, axis=0, dtype=np.int64)
        return out

    def judge(self, column, readable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, its probability) of texts; -1 and 0 of those that aren't readable."""
        bits = self.totals(column) / UNIT - self.prior
        best = bits.argmin(axis=1)
        score = 1 / np.exp2(np.minimum(0, bits[np.arange(len(bits)), best][:, None] - bits)).sum(axis=1)
        return np.where(readable, best, -1), np.where(readable, score, 0.0)


def train(docs: DataFrame, lang: Column, text: Column, order: int = ORDER, nodes: int = NODES) -> Model:
    """The model of all rows whose language and text aren't null."""
    if not 0 <= order <= MOST:
        raise ValueError(f"contexts have 0 to {MOST} bytes")
    rows = docs.select(lang.cast("string").alias("lang"), text.cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    langs = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    counted = mapped(rows, lambda batches: _counted(batches, order), "lang string, window long, n long").groupBy("lang", "window").agg(F.sum("n").alias("n"))
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("window").bitwiseAND(F.lit(int(_mask(k + 1)))).alias("node")) for k in range(order + 1))))
    counts = stash(stash(counted, "language-windows").select("lang", levels.alias("x"), "n").groupBy("lang", "x.k", "x.node").agg(F.sum("n").alias("n")), "language-nodes")
    held = sorted((r[0], r[1]) for r in counts.groupBy(F.floor(F.log2("n")).alias("power")).count().collect())  # at most 63 rows
    least = next((1 << p for p, _ in held if sum(c for q, c in held if q >= p) <= nodes), 1 << 63)
    kept = counts.where(F.col("n") >= least).toArrow() if least < 1 << 63 else counts.limit(0).toArrow()
    unstash(counts)
    name, level, node, n = (kept.column(i).to_numpy() for i in range(4))
    trees = []
    for x in sorted(langs):
        of = name == x
        own = {k: (node[of & (level == k)].astype(np.uint64), n[of & (level == k)]) for k in range(order + 1)}
        trees.append(Tree({k: v for k, v in own.items() if len(v[0])}))
    total = sum(langs.values())
    return Model(sorted(langs), trees, np.log2(np.array([langs[x] for x in sorted(langs)]) / max(total, 1)), order)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, nodes: int = NODES, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; rows of the held-out fold teach nothing."""
    out = doc_crc("doc_id") % folds == held_out
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).withColumn("held_out", out)
    model = train(own.where(~F.col("held_out")), F.col("lang"), F.col("text"), order, nodes)
    rows = own.select("doc_id", "held_out", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("readable"), "text")
    if not model.langs:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [*model.langs, UNKNOWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = sent.value.judge(b.column(3), b.column(2).to_numpy(zero_copy_only=False))
            named = pa.DictionaryArray.from_arrays(pa.array(np.where(lang < 0, len(names) - 1, lang).astype(np.int32)), pa.array(names)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), named, pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return mapped(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")
