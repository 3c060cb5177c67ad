"""Spelling variants: words one inserted, deleted or replaced letter apart, and the form that each stands for.

Words are maximal runs of letters (A-Z, a-z and U+00C0 to U+00FF), A-Z lower-cased; of those whose id and text hash to
a multiple of ``ERROR`` one letter is left out. Words of at least ``LEAST_LETTERS`` letters and ``LEAST_COUNT`` occurrences count.

A word is split in half. One error leaves one half as it is: a forward automaton reads the first half exactly and
completes the rest with one error, a backward automaton (of reversed words) does the same from the end. Halves have at least three
letters, so the words that a word can reach share its first three letters, or its last three; words are dealt to buckets
by these, on both sides. A bucket's words become a minimal acyclic automaton: equal ends of words are one state, and a state knows how many words go
on from it, so a path's sum of words passed by is the number of its word (a perfect hash). All words of a bucket are looked up at once. Buckets of over
``PIECE`` words are dealt to pieces on both sides, each met by each. What both directions or several paths find is one link.

A form is a word's most frequent near word, if that is ``TIMES`` times as frequent; so counts grow fivefold from form to form, and roots
are found in a few rounds of doubling.

Defined cases: null texts have no words; a null id counts as the empty text; repeated rows are counted each; a run left empty by the
deletion is no word; runs of any length are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofold.llm import checksum
from geofold.llm.common import mapped, stash, unstash
from geofold.llm.words import LOWER, Words, flat

ERROR, LEAST_LETTERS, LEAST_COUNT, TIMES = 199, 6, 5, 5
#: Letters of a half that choose a word's bucket; halves of words of LEAST_LETTERS have as many.
KEY = 3
#: Words of a bucket, about, and of a piece of a bucket, at most about.
PIECE = 4096

_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
#: Fixed value: the first byte of U+00C0 to U+00FF in UTF-8; they have two.
WIDE = 0xC3


def letters(column) -> Words:
    """Words of letters, lower-cased, of an Arrow column."""
    data, ends = flat(column)
    own = _ASCII[data] | (data == WIDE)
    own[1:] |= data[:-1] == WIDE
    return Words(np.where(own, LOWER[data], np.uint8(32)), ends)


def _counted(batches: Iterator[pa.RecordBatch], error: int, least: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of each batch of doc_id and text; words of under ``least`` letters are left out."""
    for b in batches:
        words = letters(b.column(1))
        raw = words.data.tobytes()
        _, example, ids = np.unique(words.hashes(), return_index=True, return_inverse=True)
        start, stop = words.start[example], words.stop[example]
        wide = np.r_[0, np.cumsum(words.data == WIDE)]
        size = (stop - start) - (wide[stop] - wide[start])
        before = np.array([crc32(f"{'' if i is None else i}:".encode()) for i in b.column(0).to_pylist()], np.uint32)
        h = checksum.appended(np.repeat(before, words.counts), checksum.of_slices(raw, start, stop)[ids], (stop - start)[ids])
        hit = np.flatnonzero(h % np.uint32(error) == 0)
        n = np.bincount(ids, minlength=len(example)) - np.bincount(ids[hit], minlength=len(example))
        kept = np.flatnonzero((n > 0) & (size >= least))
        out, times = [raw[a:z].decode() for a, z in zip(start[kept].tolist(), stop[kept].tolist(), strict=True)], n[kept]
        cut = hit[size[ids[hit]] > least]
        place, many = np.unique(np.array([ids[cut], h[cut].astype(np.int64) % size[ids[cut]]]), axis=1, return_counts=True)
        for i, at in place.T.tolist():
            whole = raw[start[i] : stop[i]].decode()
            out.append(whole[:at] + whole[at + 1 :])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(np.r_[times, many])], ["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", error: int = ERROR, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that count."""
    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    found = mapped(chosen, lambda batches: _counted(batches, error, least_letters), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words of one byte a letter; its words are numbered from 0 in order."""

    def __init__(self, words: list[bytes]):
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size) - size
        node, final = np.zeros(len(words), np.int64), [np.zeros(int((size == 0).any()), np.int64)]
        parent, label, nodes = [], [], 1
        for depth in range(int(size.max(initial=0))):  # a tree, level by level: nodes and edges come in order
            own = np.flatnonzero(size > depth)
            at, char = node[own], data[start[own] + depth]
            new = np.r_[True, (at[1:] != at[:-1]) | (char[1:] != char[:-1])]
            node[own] = nodes + np.cumsum(new) - 1
            parent.append(at[new])
            label.append(char[new])
            nodes += int(new.sum())
            final.append(node[own[size[own] == depth + 1]])
        ends = np.zeros(nodes, bool)
        ends[np.concatenate(final)] = True
        parent, label = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parent, label))
        self._merge(ends.tolist(), np.searchsorted(parent, np.arange(nodes + 1)).tolist(), label.tolist())

    def _merge(self, ends: list[bool], edge: list[int], label: list[int]) -> None:
        """Nodes with equal ends and equal ways on become one state, leaves first. The child of edge e is node e + 1."""
        state, known = [0] * len(ends), {}
        for node in range(len(ends) - 1, -1, -1):
            a, z = edge[node], edge[node + 1]
            state[node] = known.setdefault((ends[node], *label[a:z], *state[a + 1 : z + 1]), len(known))
        first, self.final, size, to, skip, key = [0], [], [], [], [], []
        for s, (end, *ways) in enumerate(known):
            total = int(end)
            for char, target in zip(ways[: len(ways) // 2], ways[len(ways) // 2 :], strict=True):
                key.append(s << 8 | char)
                to.append(target)
                skip.append(total)
                total += size[target]
            size.append(total)
            first.append(len(to))
            self.final.append(end)
        self.root, self.words = state[0], size[state[0]]
        self.first, self.to, self.skip, self.key = (np.array(x, np.int64) for x in (first, to, skip, key))
        self.final = np.array(self.final, bool)

    def __len__(self) -> int:
        return len(self.final)

    def step(self, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edge, whether there is one) from each state by each letter."""
        key = (state << 8) | char
        edge = np.searchsorted(self.key, key)
        return edge, np.r_[self.key, -1][edge] == key

    def near(self, words: list[bytes], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word's place, number of a word one error away), distinct; the first ``exact`` letters of each word are read as they are."""
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size) - size
        data = np.r_[np.frombuffer(b"".join(words), np.uint8), np.uint8(0)].astype(np.int64)
        # what is under way: word, letters read, state, words passed by
        sound = np.array([np.arange(len(words)), np.zeros(len(words), np.int64), np.full(len(words), self.root), np.zeros(len(words), np.int64)])
        wrong = np.zeros((4, 0), np.int64)
        found = []

        def read(now: np.ndarray) -> np.ndarray:
            now = now[:, now[1] < size[now[0]]]
            edge, there = self.step(now[2], data[start[now[0]] + now[1]])
            now, edge = now[:, there], edge[there]
            return np.array([now[0], now[1] + 1, self.to[edge], now[3] + self.skip[edge]])

        while sound.shape[1] or wrong.shape[1]:
            done = wrong[:, (wrong[1] == size[wrong[0]]) & self.final[wrong[2]]]
            found.append(done[[0, 3]])
            open_ = sound[:, sound[1] >= exact[sound[0]]]
            more = open_[1] < size[open_[0]]
            ways = self.first[open_[2] + 1] - self.first[open_[2]]
            spread = np.repeat(open_, ways, axis=1)
            edge = np.arange(spread.shape[1]) - np.repeat(np.cumsum(ways) - ways, ways) + self.first[spread[2]]
            beyond = np.array([spread[0], spread[1], self.to[edge], spread[3] + self.skip[edge]])
            other = np.repeat(more, ways) & ((self.key[edge] & 255) != data[start[spread[0]] + spread[1]])
            wrong = np.concatenate([read(wrong), beyond, beyond[:, other] + [[0], [1], [0], [0]], open_[:, more] + [[0], [1], [0], [0]]], axis=1)
            sound = read(sound)
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1)) if found else (np.zeros(0, np.int64),) * 2


def _linked(words: pa.Table, asked: pa.Table) -> pa.Table:
    """(word, near, near_n): the dictionary's words one error from those asked, found in one direction."""
    turn = -1 if (asked if len(asked) else words)["back"][0].as_py() else 1
    own = {w.encode("latin-1")[::turn]: n for w, n in zip(words["word"].to_pylist(), words["n"].to_pylist(), strict=True)}
    order = sorted(own)
    ask = [w.encode("latin-1")[::turn] for w in asked["word"].to_pylist()]
    half = np.array([len(w) // 2 if turn > 0 else len(w) - len(w) // 2 for w in ask], np.int64)
    query, number = Automaton(order).near(ask, half)
    text = lambda w: w[::turn].decode("latin-1")
    return pa.table({"word": pa.array([text(ask[i]) for i in query.tolist()], pa.string()), "near": pa.array([text(order[i]) for i in number.tolist()], pa.string()), "near_n": pa.array([own[order[i]] for i in number.tolist()], pa.int64())})


def near_words(words: DataFrame, piece: int = PIECE) -> DataFrame:
    """(word, near, near_n) of all pairs of words (word, n) one error apart, both ways; words have ``LEAST_LETTERS`` letters or more."""
    buckets = max(1, words.count() // piece)
    sides = F.explode(F.array(*(F.struct(F.lit(back).alias("back"), F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")) for back, key in ((False, F.substring("word", 1, KEY)), (True, F.substring("word", -KEY, KEY))))))
    rows = words.select("word", "n", sides.alias("s")).select("s.*", "word", "n")
    sizes = rows.groupBy("back", "bucket").agg(F.ceil(F.count("*") / piece).alias("pieces"))
    rows = rows.join(sizes, ["back", "bucket"]).withColumn("own", F.pmod(F.xxhash64("word", F.lit(1)), F.col("pieces")))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))
    held = rows.withColumn("asked", each).select("back", "bucket", F.col("own").alias("held"), "asked", "word", "n")
    asked = rows.withColumn("held", each).select("back", "bucket", "held", F.col("own").alias("asked"), "word")
    keys = ["back", "bucket", "held", "asked"]
    asked = asked.toDF(*asked.columns)
    links = held.toDF(*held.columns).groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_linked, "word string, near string, near_n long")
    return links.repartition("word").groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", error: int = ERROR, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES, piece: int = PIECE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that counts."""
    if least_letters < 2 * KEY or times < 2:
        raise ValueError(f"words need {2 * KEY} letters at least, and forms twice the count")
    words = stash(vocabulary(docs, id_col, text_col, error, least_letters, least_count), "spelling-words")
    near = near_words(words, piece).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("best"))
    is_form = -F.col("best.down") >= times * F.col("n")
    judged = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.down")).alias("form_n"))
    judged = stash(judged, "spelling-forms")
    most = judged.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(max(most / least_count, 1), times)) + 1)  # a chain's forms, at most
    roots = judged.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        last, roots = roots, stash(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        unstash(last)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
