"""Token ids by public tokenizer files; no tokenizer is trained."""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np

from geofold.llm.words import Words, fast_order, words_of

#: Fixed value: the byte-level split.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words whose ids a worker remembers, at most (and one batch more); about 50 bytes each.
KNOWN_WORDS = 1_000_000


def _byte_of() -> dict[str, int]:
    """Byte of each character by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Known:
    """Ids of words met before, by hash: sorted hashes, places in one pool. Three arrays of at most ``KNOWN_WORDS`` words; then it starts anew."""

    def __init__(self):
        self.keys, self.begin, self.n, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def ids(self, keys: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, begin and number of each word's ids) for sorted distinct keys; encode: (ids, numbers) of the words at the given places."""
        if len(self.keys) > KNOWN_WORDS:
            self.__init__()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool) if not len(self.keys) else self.keys[np.minimum(at, len(self.keys) - 1)] != keys
        if new.any():
            got, n = encode(np.flatnonzero(new))
            begin = len(self.pool) + np.cumsum(n) - n
            self.keys, self.begin, self.n = (np.insert(a, at[new], b) for a, b in ((self.keys, keys[new]), (self.begin, begin), (self.n, n)))
            self.pool = np.r_[self.pool, got]
            at = at + np.cumsum(new) - new
        return self.pool, self.begin[at], self.n[at]


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    Reads a byte-level BPE file of ``tokenizers``. If its merges stand in the order
    of their results' ids, ``tiktoken`` with these ids as ranks yields the same ids
    several times faster; else ``tokenizers`` itself is used. No token spans the
    start of a "space + word" chunk, so where single spaces and line ends between words
    are a text's only white space, each distinct word of a batch is encoded once. Other texts are encoded whole.

    Defined cases: null and empty texts have no ids; white space of any kind, names of special tokens and texts of any
    length are encoded as the file says.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        spec = json.loads(tokenizer.to_str())
        split = spec.get("pre_tokenizer") or {}
        self.byte_level = not spec.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.encode = self._ranked(spec) or (lambda x: np.array(tokenizer.encode(x, add_special_tokens=False).ids, "<u4"))
        self.known = Known()
        self.line_end = self.encode("\n") if self.byte_level else None
        self.lengths = None
        if self.byte_level:
            vocab = tokenizer.get_vocab(with_added_tokens=True)
            byte = _byte_of()
            self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
            for x, i in vocab.items():
                self.lengths[i] = len(x) if all(c in byte for c in x) else 0

    def _ranked(self, spec: dict):
        import tiktoken

        model, special = spec["model"], {x["content"] for x in spec["added_tokens"]}
        vocab = model.get("vocab", {})
        order = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model.get("merges", [])]
        if not self.byte_level or model["type"] != "BPE" or model.get("ignore_merges") or any(a >= b for a, b in zip(order, order[1:], strict=False)):
            return None
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in x): i for x, i in vocab.items() if x not in special}
        ranked = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda x: ranked.encode_to_numpy(x, disallowed_special=())

    def __call__(self, text: str) -> bytes:
        return self.encode(text).astype("<u4").tobytes()

    def batch(self, column) -> list[bytes]:
        """Ids of each text of an Arrow column."""
        words = words_of(column)
        size = np.diff(words.ends)
        odd = irregular(words) if self.byte_level else np.ones(len(size), bool)
        regular = ~np.repeat(odd, words.counts)
        first, last = words.start[regular], words.stop[regular]
        spaced = (first > 0) & (words.data[first - 1] == 32)
        lined = (first > 0) & (words.data[first - 1] == 10)
        texts = np.repeat(np.arange(len(size)), words.counts)[regular]
        opens = np.r_[True, texts[1:] != texts[:-1]] if len(texts) else np.zeros(0, bool)
        spaced, lined = spaced & ~opens, lined & ~opens
        keys = words.hashes()[regular] ^ spaced.astype(np.uint64)
        order = fast_order(keys)
        new = np.r_[True, keys[order[1:]] != keys[order[:-1]]] if len(order) else np.zeros(0, bool)
        at = np.empty(len(keys), np.int64)
        at[order] = np.cumsum(new) - 1
        example = order[new]
        pool, begin, n = self.known.ids(keys[example], lambda new: self._distinct(words.data, first[example[new]], last[example[new]], spaced[example[new]]))
        begin, n = begin[at], n[at]
        heads = np.cumsum(n + lined) - n
        ids = np.empty(int(heads[-1] + n[-1]) if len(n) else 0, "<u4")
        if len(n):
            ids[(heads - 1)[lined]] = self.line_end[0]
            place, before = np.arange(int(n.sum())), np.cumsum(n) - n
            ids[place + np.repeat(heads - before, n)] = pool[place + np.repeat(begin - before, n)]
        ends = np.zeros(len(size) + 1, np.int64)
        np.add.at(ends, texts + 1, n + lined)
        ends = np.cumsum(ends)
        data = words.data
        return [self(data[words.ends[i] : words.ends[i + 1]].tobytes().decode("utf-8", "replace")) if odd[i] else ids[ends[i] : ends[i + 1]].tobytes() for i in range(len(size))]

    def _distinct(self, data, first, last, spaced) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and the number of each. All are encoded as two texts, cut by the tokens' bytes."""
        out, begins = [], np.zeros(len(first) + 1, np.int64)
        raw = data.tobytes()
        for with_space in (True, False):
            who = np.flatnonzero(spaced == with_space)
            if not len(who):
                continue
            mark = b" " if with_space else b"\n"
            joined = mark + mark.join(raw[a:z] for a, z in zip(first[who], last[who], strict=True))
            ids = self.encode(joined.decode("utf-8", "replace"))
            upto = np.cumsum(self.lengths[ids])
            starts = np.cumsum(last[who] - first[who] + 1) - (last[who] - first[who] + 1)
            cut = np.searchsorted(upto, starts, "right")
            if upto[-1] != len(joined) or not np.array_equal(np.r_[0, upto][cut], starts):
                raise RuntimeError("a token spans the start of a word")
            counts = np.diff(np.r_[cut, len(ids)])
            if not with_space:  # the line ends that set the words apart aren't theirs
                keep = np.ones(len(ids), bool)
                keep[cut] = False
                ids, counts = ids[keep], counts - 1
            begins[who + 1] = counts
            out.append((who, ids, counts))
        begins = np.cumsum(begins)
        pool = np.empty(int(begins[-1]), "<u4")
        for who, ids, counts in out:
            pool[np.arange(len(ids)) + np.repeat(begins[who] - (np.cumsum(counts) - counts), counts)] = ids
        return pool, np.diff(begins)


#: First bytes and what follows of Unicode's white space beyond ASCII.
_WIDE_SPACE = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", *(b"\xe2\x80" + bytes([x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\xe2\x81\x9f", b"\xe3\x80\x80"]
_THIN, _OTHER = np.zeros(256, bool), np.zeros(256, bool)
_THIN[[10, 32]] = True
_OTHER[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_WIDE_FIRST = np.zeros(256, bool)
_WIDE_FIRST[[x[0] for x in _WIDE_SPACE]] = True


def irregular(words: Words) -> np.ndarray:
    """Whether each text has white space other than single blanks or line ends between its words."""
    data, ends = words.data, words.ends
    size = np.diff(ends)
    if not len(data):
        return np.zeros(len(size), bool)
    thin = _THIN[data]
    bad = _OTHER[data]
    bad[1:] |= thin[1:] & thin[:-1]
    full = size > 0
    bad[ends[:-1][full]] |= thin[ends[:-1][full]]
    bad[ends[1:][full] - 1] |= thin[ends[1:][full] - 1]
    wide = np.flatnonzero(_WIDE_FIRST[data])
    if len(wide):
        three = np.r_[data, np.zeros(2, np.uint8)].astype(np.uint32)
        code = (three[wide] << 16) | (three[wide + 1] << 8) | three[wide + 2]
        known = np.array([int.from_bytes(x, "big") for x in _WIDE_SPACE if len(x) == 3], np.uint32)
        pairs = np.array([int.from_bytes(x, "big") for x in _WIDE_SPACE if len(x) == 2], np.uint32)
        bad[wide] |= np.isin(code, known) | np.isin(code >> 8, pairs)
    at = np.flatnonzero(bad)
    return np.bincount(np.searchsorted(ends, at, "right") - 1, minlength=len(size)) > 0


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
