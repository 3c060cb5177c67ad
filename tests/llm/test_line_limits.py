"""Limits of frequent lines don't grow with a host, and hold over all hosts."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from geofold.llm import line_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_limits_are_numbers_of_documents(spark):
    rng = np.random.default_rng(3)
    body = lambda n=6: "\n".join(" ".join("".join(map(chr, rng.integers(97, 123, 9))) for _ in range(12)) for _ in range(n))
    docs = [(i, body() + ("\nshared in a large host" if i % 20 == 0 else ""), "en", "large", 0) for i in range(400)]
    docs += [(1000 + i, body() + "\nshared by all hosts", "en", f"h{i % 12}", 0) for i in range(60)]
    docs += [(2000 + i, body() + "\nrare line", "en", "large", 0) for i in range(10)]
    base = body(10)
    docs += [(3000 + i, base + "\n" + body(1), "en", "near", 0) for i in range(30)]
    copied = "a text of several hosts\n" + body()
    docs += [(4000 + i, copied, "en", f"h{i}", 0) for i in range(70)]
    got = {r.doc_id: r for r in line_rules.judge(spark.createDataFrame(docs, DOCS)).collect()}
    assert all(got[i].removed_words == (5 if i % 20 == 0 else 0) and got[i].kept for i in range(400))
    assert all(got[1000 + i].removed_words == 4 and got[1000 + i].kept for i in range(60))
    assert all(got[2000 + i].removed_words == 0 for i in range(10)) and all(got[4000 + i].removed_words == 0 for i in range(70))
    assert [i for i in range(30) if got[3000 + i].kept] == [0] and got[3000].removed_words == 0


def plain_verdicts(rows, min_docs, all_docs, copies):
    """Removed words and verdict of each row, by Python's sets and dictionaries."""
    norm = lambda x: re.sub("[0-9]", "0", " ".join(ascii_words("".join(c.lower() if "A" <= c <= "Z" else c for c in x))))
    of_host, of_all = defaultdict(set), defaultdict(set)
    lines = []
    for i, (_, text, _, host, _) in enumerate(rows):
        own = [(norm(x), len(ascii_words(x))) for x in (text or "").split("\n") if ascii_words(x)]
        lines.append(own)
        for x, _ in own:
            of_host[host, x].add(i if copies else text)
            of_all[x].add(i if copies else text)
    frequent = []  # (scope, line) over the limit that each row holds; a line frequent in all hosts has one scope
    for (_, _, _, host, _), own in zip(rows, lines, strict=True):
        frequent.append({(None, x) if len(of_all[x]) > all_docs else (host, x) for x, _ in own if len(of_all[x]) > all_docs or len(of_host[host, x]) > min_docs})
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    first = {}
    for i, found in enumerate(frequent):
        for f in found:
            first[f] = min(first.get(f, i), i, key=order)
    out = []
    for i, (own, found) in enumerate(zip(lines, frequent, strict=True)):
        n = sum(w for _, w in own)
        words = lambda chosen: sum(w for x, w in own if x in {f[1] for f in chosen})  # noqa: B023, E731
        removed = words(found)
        rest = words({f for f in found if rows[first[f]][1] != rows[i][1]})
        if n - removed < 0.5 * n <= n - rest:
            removed = rest
        flat = ascii_words(rows[i][1] or "")
        windows = Counter(zip(flat, flat[1:], flat[2:]))
        repeated = len({i + k for i in range(len(flat) - 2) if windows[tuple(flat[i : i + 3])] > 1 for k in range(3)})
        failed = n < 50 or 100 * repeated > 50 * n
        out.append((rows[i][0], n, repeated, removed, failed, not failed and not (removed and n - removed < 0.5 * n)))
    return Counter(out)


def ascii_words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x)


@pytest.mark.parametrize("copies", [False, True])
def test_verdicts_are_those_of_brute_force(spark, copies):
    rng = np.random.default_rng(8)
    pool = [" ".join(rng.choice(list("abcdefghij"), 6)) + f" No. {i}" for i in range(40)]
    fresh = lambda n: [" ".join("".join(map(chr, rng.integers(97, 123, 7))) for _ in range(8)) for _ in range(n)]
    rows = []
    for i in range(260):
        own = fresh(int(rng.integers(1, 8))) + [str(rng.choice(pool[: int(rng.integers(3, 40))])).replace(" ", "  " if i % 3 else " ") for _ in range(int(rng.integers(0, 9)))]
        rng.shuffle(own)
        rows.append((i, "\n".join(own) + ("\n\n" if i % 4 else "\r"), "en", [None, "a", "b", "A"][i % 4], 0))
    rows += [(300 + i, rows[5][1], "en", "a", 0) for i in range(30)] + [(300, rows[5][1], "en", "a", 0), (400, None, "en", None, 0), (401, "", "en", "a", 0), (402, " \t\n", "en", "a", 0), (None, rows[9][1], "en", "a", 0)]
    got = line_rules.judge(spark.createDataFrame(rows, DOCS).repartition(3), min_docs=6, all_docs=30, copies=copies).collect()
    mine = Counter((r.doc_id, r.n_words, r.n_repeat_words, r.removed_words, r.base_failed, r.kept) for r in got)
    want = plain_verdicts(rows, 6, 30, copies)
    assert mine == want, list((mine - want).items())[:5] + list((want - mine).items())[:5]
    assert sum(r.removed_words > 0 for r in got) > 50 and sum(not r.kept and not r.base_failed for r in got) > 5 and sum(r.kept and r.removed_words > 0 for r in got) > 20
