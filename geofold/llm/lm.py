"""Language-model scores by a weighted backoff automaton of n-grams.

States are histories, the last ``ORDER`` - 1 tokens or fewer. An arc from state h reads a token w and carries, by
interpolated absolute discounting over the n-grams that occur at least ``MIN_COUNT`` times,

    P(w | h) = (c(h w) - D) / c(h) + L(h) P(w | h'),   L(h) = 1 - sum over kept arcs of (c(h w) - D) / c(h)

where h' is h without its oldest token: the failure arc of weight L(h) leads there. Where h has no arc for
w (or isn't a state), only the failure arc counts. The root's arcs are the single tokens,
(c(w) + 0.1) / (N + 0.1 (V + 1)). A text is read once from left to right: each token's state
is the one of the tokens before it, and the logarithms of all transitions are summed.

Nothing holds the automaton as a whole. Documents form groups of neighbouring rows of a file, long
ones in pieces of ``PIECE`` tokens, so a group is bounded. A group counts its n-grams of all orders in one pass; sorted
keys are cut into buckets by history, so a bucket's task sees all arcs of its states and computes
counts and failure weights, which it sends back in the order of each group's keys. A group so gets the part of the automaton
that its texts can reach, without keys. Arcs of histories that make up a large part of a bucket (found on a
sample of rows, which decides nothing but the task) are spread over all buckets by their key;
their weights are summed over buckets and sent to all groups. These histories are at most 1 / ``LEAST_HOT``.

A key has at most 64 bits, some for the history and some for the token (``Bits``), so tokens after one history may share an arc: of order 3, 0.3 % of
10,000 different successors, 5 % of 100,000. Counts cover all training documents.
Every n-gram that occurs ``MIN_COUNT`` times has an arc, whatever the size of the corpus.

Defined cases: null and empty texts have one token, the end; tokens never seen in training
have c = 0; without training documents every token is unseen, and scores are log10 of
0.1 / 0.1 = 0; repeated rows are counted and scored each on their own; null ids count as the empty
text in the split; very long texts are scored piece by piece, each piece with the tokens before it as
history; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofold.llm.common import doc_crc, mapped, stash, unstash
from geofold.llm.words import LOWER, distinct_sorted, fast_order, joined_key, mixed, words_of

SMOOTH = 0.1
DISCOUNT = 0.75
MIN_COUNT = 2
ORDER = 3
#: Rows of a file that form a group, and tokens of a document in one of its groups: together they bound a group.
GROUP_ROWS, PIECE = 2048, 8192
#: Tokens whose n-grams a counting task holds before it hands on counts.
HELD = 1_500_000
#: Tokens for each bucket, about, and the least number of buckets.
BUCKET_TOKENS, LEAST_BUCKETS = 1_000_000, 16
#: A history is hot if it makes up this part of a bucket, and this part of all tokens.
HOT_PART, LEAST_HOT = 0.25, 1e-6
#: One row of so many is looked at for hot histories.
HOT_SAMPLE = 64
#: Bits of a history beyond those that number the corpus' tokens.
SPARE = 12
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)

_ROWS = pa.schema([("path", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("context", pa.int32()), ("last", pa.bool_()), ("text", pa.string())])
_BLOBS = "g long, first long, final long, bucket int, kind int, keys binary, counts binary"
_SCORED = pa.schema([("path", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SUMS = "g long, first long, final long, bucket int, kind int, counts binary, states binary, tokens long, distinct long, hot array<struct<kind:int,history:long,count:long,kept:long,arcs:long>>"


class Bits:
    """How many bits of a key tell the history, and how many the token. Histories get ``SPARE`` bits more than the corpus has tokens, but 44 at most: beyond some 26 GB fewer are to spare."""

    def __init__(self, size: int, order: int):
        tokens = max(1, size // 6).bit_length()
        self.token = {1: 56, 2: 28} | dict.fromkeys(range(3, order + 1), 20)
        self.history = {1: 0, 2: 36} | dict.fromkeys(range(3, order + 1), min(44, tokens + SPARE))

    def key(self, order: int, state: np.ndarray, token: np.ndarray, hot: bool) -> np.ndarray:
        """History first, so that a state's arcs are neighbours; token first for hot histories, so that they are spread."""
        h, t = np.uint64(self.history[order]), np.uint64(self.token[order])
        return (token << h) | state if hot else (state << t) | token

    def state(self, kind: int, key: np.ndarray) -> np.ndarray:
        h, t = np.uint64(self.history[abs(kind)]), np.uint64(self.token[abs(kind)])
        return key & ((np.uint64(1) << h) - np.uint64(1)) if kind < 0 else key >> t

    def bucket(self, kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
        """Buckets are ranges of the keys' upper bits, so sorted keys have sorted buckets."""
        upper = keys >> np.uint64(self.history[abs(kind)] + self.token[abs(kind)] - 32)
        return ((upper * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of their bytes, lowest first."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : data[0]] = np.frombuffer(pa.decompress(data[1:], data[0] * n, "zstd"), np.uint8).reshape(-1, n).T
    return out.view("<u8")[:, 0]


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and the steps from each to the next; their number comes first."""
    return np.array([len(keys), keys[0]], "<u8").tobytes() + pack(np.diff(keys))


def unpack_sorted(data: bytes) -> np.ndarray:
    n, first = np.frombuffer(data[:16], "<u8")
    return np.cumsum(np.r_[first, unpack(data[16:], int(n) - 1)], dtype=np.uint64)


class Grams:
    """N-grams of pieces of texts. Kind 1 is single tokens, 2 to order the longer ones; -2 to -order those of hot histories."""

    def __init__(self, texts, context: np.ndarray, last: np.ndarray, order: int, hot: dict[int, np.ndarray], bits: Bits, all_histories: bool = False):
        words = words_of(texts)
        n, last = words.counts, last.astype(np.int64)
        size = n + last
        upto = np.cumsum(size)
        token = np.empty(int(size.sum()), np.uint64)
        token[np.arange(len(words)) + np.repeat(np.cumsum(last) - last, n)] = words.hashes(LOWER)
        token[upto[last > 0] - 1] = END
        place = np.arange(len(token), dtype=np.int32) - np.repeat((upto - size).astype(np.int32), size)
        own = place >= np.repeat(context, size)
        #: Which text each token belongs to; tokens that are only context are left out.
        self.text = np.repeat(np.arange(len(size), dtype=np.int32), size)[own]
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # kind: which tokens, their keys
        self.histories: dict[int, np.ndarray] = {}  # of every token, or of those of kind -order
        all_ = np.arange(len(self.text), dtype=np.int32)
        follower = mixed(token[own] ^ START)
        self.keys[1] = all_, follower >> np.uint64(64 - bits.token[1])
        history = None
        for o in range(2, order + 1):
            before = np.r_[np.full(min(o - 1, len(token)), START), token[: max(0, len(token) - o + 1)]]
            before = np.where(place >= o - 1, before, START)
            history = before if history is None else joined_key(before, history)
            state = mixed(history[own]) >> np.uint64(64 - bits.history[o])
            last_bits = follower >> np.uint64(64 - bits.token[o])
            is_hot = _member(hot.get(o), state)
            for kind, who in ((o, all_[~is_hot] if is_hot.any() else all_), (-o, all_[is_hot])):
                self.keys[kind] = who, bits.key(o, state[who], last_bits[who], kind < 0)
            self.histories[o] = state if all_histories else state[is_hot]


def _member(among: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    if among is None or not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often they occur in training texts (0: elsewhere only)."""
    a, n = np.unique(keys[train], return_counts=True)
    b = distinct_sorted(keys[~train])
    new = ~_member(a, b)
    at = np.searchsorted(a, b[new])
    return np.insert(a, at, b[new]), np.insert(n, at, 0)


def _pieces(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of path, row, doc_id, train, text as (group, batch by ``_ROWS``), rows of a group in order. Texts of ``PIECE`` words or more are cut, each piece with the words before it."""
    for b in batches:
        texts = b.column(4).cast(pa.string()).fill_null("")
        words = words_of(texts)
        n = words.counts
        path, row = (_number(b.column(i)).astype(np.int64) for i in (0, 1))
        chunk = joined_key(path.view(np.uint64), (row // GROUP_ROWS).view(np.uint64))
        short = n < PIECE
        for c in dict.fromkeys(chunk[short].tolist()):
            at = np.flatnonzero(short & (chunk == c))
            whole = [pa.array(path[at]), pa.array(row[at]), b.column(2).take(pa.array(at)), b.column(3).take(pa.array(at)), pa.array(np.zeros(len(at), np.int32)), pa.array(np.ones(len(at), bool)), texts.take(pa.array(at))]
            yield _group(c, 0), pa.RecordBatch.from_arrays(whole, schema=_ROWS)
        for i in np.flatnonzero(~short):
            first, total = int(words.upto[i]), int(n[i])
            for p in range(total // PIECE + 1):
                a, z = max(0, p * PIECE - order + 1), min(total, (p + 1) * PIECE)
                cut = words.data[words.start[first + a] : words.stop[first + z - 1]].tobytes().decode("utf-8", "replace") if z > a else ""
                piece = [[path[i]], [row[i]], b.column(2).slice(i, 1), b.column(3).slice(i, 1), [p * PIECE - a], [p == total // PIECE], [cut]]
                yield _group(int(chunk[i]), p + 1), pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(piece, _ROWS.types, strict=True)], schema=_ROWS)


def _group(chunk: int, piece: int) -> int:
    return int(joined_key(np.array([chunk], np.uint64), np.array([piece], np.uint64)).view(np.int64)[0])


def _sent(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Each group's rows as compressed Arrow data, first row first."""
    for g, b in _pieces(batches, order):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _ROWS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["g", "data"])


def _received(data: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in data]).sort_by("row").combine_chunks()


def _number(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _count(batches: Iterator[pa.RecordBatch], order: int, buckets: int, hot: dict[int, np.ndarray], bits: Bits) -> Iterator[pa.RecordBatch]:
    """Counts of each group's n-grams by bucket; a group whose rows come in several batches or tasks may give several blobs, told apart by rows."""
    held: dict[int, list[pa.RecordBatch]] = defaultdict(list)
    tokens, chunk = 0, None

    def blobs() -> Iterator[pa.RecordBatch]:
        for g, parts in held.items():
            t = pa.Table.from_batches(parts)
            rows, train = _number(t["row"]), _number(t["train"]).astype(bool)
            grams = Grams(t["text"], _number(t["context"]), _number(t["last"]), order, hot, bits)
            out = []
            for kind, (who, keys) in grams.keys.items():
                if not len(keys):
                    continue
                distinct, n = counted(keys, train[grams.text[who]])
                bucket = bits.bucket(kind, distinct, buckets)
                edges = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
                out += [(g, int(rows.min()), int(rows.max()), int(bucket[a]), kind, pack_sorted(distinct[a:z]), pack(n[a:z])) for a, z in zip(edges[:-1], edges[1:], strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _BLOBS.split(", ")])

    for g, b in _pieces(batches, order):
        now = (b.column(0)[0].as_py(), b.column(1)[0].as_py() // GROUP_ROWS)
        if held and (now != chunk or tokens > HELD):
            yield from blobs()
            held.clear()
            tokens = 0
        chunk = now
        held[g].append(b)
        tokens += b.column(6).nbytes // 6 + 1
    if held:
        yield from blobs()


def _sum(t: pa.Table, bits: Bits) -> pa.Table:
    """Totals of one bucket: for each blob its keys' counts and its states' weights, and what only the whole bucket tells."""
    blobs = t.select(["g", "first", "final", "bucket", "kind"]).to_pylist()
    out: list[dict] = []
    tokens = distinct_tokens = 0
    hot = []
    for kind in sorted({b["kind"] for b in blobs}):
        at = [i for i, b in enumerate(blobs) if b["kind"] == kind]
        own = [unpack_sorted(t["keys"][i].as_py()) for i in at]
        keys = np.concatenate(own)
        counts = np.concatenate([unpack(t["counts"][i].as_py(), len(k)) for i, k in zip(at, own, strict=True)]).astype(np.int64)
        order = fast_order(keys)
        starts = np.flatnonzero(np.r_[True, keys[order[1:]] != keys[order[:-1]]])
        distinct, total = keys[order[starts]], np.add.reduceat(counts[order], starts)
        where = np.empty(len(keys), np.int64)
        where[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(keys)]))
        if kind == 1:
            tokens, distinct_tokens = int(total.sum()), int((total > 0).sum())
            kept = total
        else:
            kept = np.where(total >= MIN_COUNT, total, 0)
            history = bits.state(kind, distinct)
            if kind > 0:  # sorted, as the keys are
                heads = np.r_[True, history[1:] != history[:-1]]
                history, state = history[heads], np.cumsum(heads) - 1
            else:
                history, state = np.unique(history, return_inverse=True)
            add = lambda x: np.bincount(state, weights=x, minlength=len(history)).astype(np.int64)  # noqa: B023, E731
            weights = np.array([add(total), add(kept), add(kept > 0)])
            if kind < 0:
                hot += [{"kind": -kind, "history": h, "count": c, "kept": k, "arcs": a} for h, c, k, a in zip(history.astype(np.int64).tolist(), *weights.tolist(), strict=True)]
            weights[:, weights[2] == 0] = 0
        upto = np.cumsum([len(k) for k in own])
        for i, a, z in zip(at, upto - [len(k) for k in own], upto, strict=True):
            b = blobs[i]
            states = b""
            if kind > 1:
                s = state[where[a:z]]
                states = pack(weights[:, s[np.r_[True, s[1:] != s[:-1]]]].ravel())
            out.append(b | {"counts": pack(kept[where[a:z]]), "states": states, "tokens": 0, "distinct": 0, "hot": []})
    out.append(dict.fromkeys(("g", "first", "final", "bucket", "kind", "counts", "states")) | {"tokens": tokens, "distinct": distinct_tokens, "hot": hot})
    kind = pa.schema([("g", pa.int64()), ("first", pa.int64()), ("final", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("counts", pa.binary()), ("states", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("hot", pa.list_(pa.struct([("kind", pa.int32()), ("history", pa.int64()), ("count", pa.int64()), ("kept", pa.int64()), ("arcs", pa.int64())])))])
    return pa.Table.from_pylist(out, kind)


class HotStates:
    """Counts and arcs of the hot histories, summed over all buckets."""

    def __init__(self, rows: list, tokens: int, distinct: int):
        self.tokens, self.distinct = tokens, distinct
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for kind in {r["kind"] for r in rows}:
            found = sorted((r["history"], r["count"], r["kept"], r["arcs"]) for r in rows if r["kind"] == kind)
            table = np.array(found, np.int64).T
            self.of[kind] = table[0].astype(np.uint64), table[1:]


def transitions(grams: Grams, counts: dict[int, np.ndarray], states: dict[int, np.ndarray], hot: HotStates, order: int, bits: Bits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, probability as a single token, probability in its state) of each token. counts: of the sorted distinct keys by kind; states: (count, kept, arcs) of their sorted histories."""
    n = len(grams.text)
    single = p = known = None
    for o in range(1, order + 1):
        arc, weights = np.zeros(n), np.zeros((3, n))
        for kind in (o, -o) if o > 1 else (1,):
            who, keys = grams.keys[kind]
            if not len(who):
                continue
            at = fast_order(keys)
            new = np.r_[True, keys[at[1:]] != keys[at[:-1]]]
            key_no = np.cumsum(new) - 1
            if kind not in counts or len(counts[kind]) != key_no[-1] + 1:
                raise RuntimeError("the counts sent back are not those of this group's keys")
            arc[who[at]] = counts[kind][key_no]
            if kind > 1:
                history = bits.state(kind, keys[at])
                weights[:, who[at]] = states[kind][:, np.cumsum(np.r_[True, history[1:] != history[:-1]]) - 1]
            elif kind < 0:
                histories, table = hot.of[o]
                weights[:, who] = table[:, np.searchsorted(histories, grams.histories[o])]
        if o == 1:
            known = arc
            single = p = (arc + SMOOTH) / (hot.tokens + SMOOTH * (hot.distinct + 1))
        else:
            count = np.maximum(weights[0], 1)
            failure = 1 - (weights[1] - DISCOUNT * weights[2]) / count
            p = np.where(arc > 0, arc - DISCOUNT, 0) / count + failure * p
    return known, single, p


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """path (hash), row, doc_id, train and text; path and row: where a file holds the row, the same on every reading."""
    chosen = [docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")]
    path, row = F.xxhash64("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")
    try:
        rows = docs.select(path, row, *chosen)
    except AnalysisException:
        rows = stash(docs.select(*chosen), "lm-docs").select(path, row, "doc_id", "text")
    return rows.select("path", "row", "doc_id", (doc_crc() % 10 != 0).alias("train"), "text")


def hot_histories(rows: DataFrame, order: int, bits: Bits, share: float, sample: int = HOT_SAMPLE) -> dict[int, np.ndarray]:
    """Sorted histories, by order, that make up at least this share of a sample's tokens; at most (order - 1) / share of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in _pieces(batches, order):
            grams = Grams(b.column(6), _number(b.column(4)), _number(b.column(5)), order, {}, bits, all_histories=True)
            for o, state in grams.histories.items():
                h, n = np.unique(state, return_counts=True)
                # what is rare in a batch may be hot only in sum: it is handed on in full
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), o, np.int32)), pa.array(h.astype(np.int64)), pa.array(n)], ["kind", "history", "n"])

    looked = mapped(rows.where(F.pmod(F.xxhash64("path", "row"), F.lit(sample)) == 0), run, "kind int, history long, n long").groupBy("kind", "history").agg(F.sum("n").alias("n"))
    looked = stash(looked, "lm-sample")
    total = looked.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    found = looked.where(F.col("n") >= max(2.0, share * total)).select("kind", "history").collect()
    unstash(looked)
    return {o: np.array(sorted(r["history"] for r in found if r["kind"] == o), np.uint64) for o in range(2, order + 1)}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, bucket_tokens: int = BUCKET_TOKENS, hot_sample: int = HOT_SAMPLE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    context = docs.sparkSession.sparkContext
    rows = _grouped(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, int(size // (6 * bucket_tokens)))
    bits = Bits(size, order)
    hot = hot_histories(rows, order, bits, max(LEAST_HOT, HOT_PART / buckets), hot_sample)

    blobs = mapped(rows, lambda batches: _count(batches, order, buckets, hot, bits), _BLOBS)
    sums = stash(blobs.groupBy("bucket").applyInArrow(lambda t: _sum(t, bits), _SUMS), "lm-sums")
    tokens, distinct = (x or 0 for x in sums.agg(F.sum("tokens"), F.sum("distinct")).first())
    # at most as many as the hot histories above
    found = sums.where("g IS NULL").select(F.explode("hot").alias("x")).groupBy("x.kind", "x.history").agg(F.sum("x.count").alias("count"), F.sum("x.kept").alias("kept"), F.sum("x.arcs").alias("arcs")).collect()
    sent = context.broadcast(HotStates(found, int(tokens), int(distinct)))

    def run(texts: pa.Table, parts: pa.Table) -> pa.Table:
        texts = _received(texts["data"].to_pylist())
        row = _number(texts["row"])
        blobs: dict[tuple[int, int], list] = defaultdict(list)
        for i, (a, z) in enumerate(zip(parts["first"].to_pylist(), parts["final"].to_pylist(), strict=True)):
            blobs[a, z].append((parts["kind"][i].as_py(), parts["bucket"][i].as_py(), i))
        out = []
        for (a, z), own in sorted(blobs.items()):
            part = texts.slice(at := int(np.searchsorted(row, a)), int(np.searchsorted(row, z, "right")) - at)
            grams = Grams(part["text"], _number(part["context"]), _number(part["last"]), order, hot, bits)
            counts: dict[int, list] = defaultdict(list)
            states: dict[int, list] = defaultdict(list)
            edges: dict[int, np.ndarray] = {}
            for kind in {k for k, _, _ in own}:
                keys = distinct_sorted(grams.keys[kind][1])
                bucket, history = bits.bucket(kind, keys, buckets), bits.state(kind, keys)
                heads = np.r_[True, history[1:] != history[:-1]]
                edges[kind] = np.array([np.bincount(bucket, minlength=buckets), np.bincount(bucket, weights=heads, minlength=buckets)], np.int64)
            for kind, bucket, i in sorted(own):
                n, m = edges[kind][:, bucket]
                counts[kind].append(unpack(parts["counts"][i].as_py(), int(n)))
                if kind > 1:
                    states[kind].append(unpack(parts["states"][i].as_py(), 3 * int(m)).reshape(3, -1))
            known, single, p = transitions(grams, {k: np.concatenate(v) for k, v in counts.items()}, {k: np.concatenate(v, axis=1) for k, v in states.items()}, sent.value, order, bits)
            total = lambda x: np.bincount(grams.text, weights=x, minlength=len(part))  # noqa: B023, E731
            columns = [pa.array(total(np.ones(len(p))).astype(np.int64)), pa.array(total(known > 0).astype(np.int64)), pa.array(total(np.log10(single))), pa.array(total(np.log10(p)))]
            out.append(pa.Table.from_arrays([part["path"], part["row"], part["doc_id"], part["train"], *columns], ["path", "row", "doc_id", "train", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(out) if out else pa.Table.from_pylist([], _SCORED)

    cut = mapped(rows, lambda batches: _sent(batches, order), "g long, data binary")
    parts = sums.where("g IS NOT NULL").select("g", "first", "final", "bucket", "kind", "counts", "states")
    scored = cut.groupBy("g").cogroup(parts.groupBy("g")).applyInArrow(run, "path long, row long, doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    whole = scored.groupBy("path", "row").agg(F.first("doc_id").alias("doc_id"), F.first("train").alias("train"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return whole.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score")
