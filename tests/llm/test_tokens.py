"""Token ids by batches against the public tokenizer itself."""

import numpy as np
import pyarrow as pa
import pytest
from geofold.llm import tokens
from geofold.llm.queries import tokenizer_path

PARTS = ["a", "Word", "don't", "'s", "12", "é", "straße", "…", "—", "<|endoftext|>", "\u200b", "日本", "\U0001f600", "x" * 40, " ", " ", " ", "\n", "\n", "\t", "\r", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "  ", "\n\n", "\0"]
HAND = [None, "", " ", "\n", "a\tb\tc\n\n\nd", "a\tb\tc\n1\t2\n\n\nend", " a", "a ", "\na", "a\n", "a b\nc d", "a  b", "it's 'tis\n'll", "a\u3000b", "a\xa0b c", "one"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("ranked", [True, False])
def test_ids_of_random_texts(reference, ranked, monkeypatch):
    if not ranked:
        monkeypatch.setattr(tokens.Encoder, "_ranked", lambda self, spec: None)
    encode = tokens.Encoder(tokenizer_path())
    rng = np.random.default_rng(11)
    texts = HAND + ["".join(rng.choice(PARTS, rng.integers(0, 14))) for _ in range(6000)]
    # mostly regular texts as well, so that words are shared between texts
    texts += ["".join(w + s for w, s in zip(rng.choice(PARTS[:12], 12), [*rng.choice([" ", " ", " ", "\n"], 11), ""], strict=True)) for _ in range(1500)]
    for at in range(0, len(texts), 700):
        column = pa.array(texts[at : at + 700])
        got = [np.frombuffer(x, "<u4").tolist() for x in encode.batch(column)]
        want = [reference(x) for x in texts[at : at + 700]]
        assert got == want, next((t, a, b) for t, a, b in zip(texts[at : at + 700], got, want, strict=True) if a != b)
    assert np.frombuffer(encode("a b"), "<u4").tolist() == reference("a b")


def test_columns_of_any_kind(reference):
    encode = tokens.encoder(tokenizer_path())
    for column in (pa.array(["x y", "a b", None, "c\nd"]).slice(1), pa.array(["a b", None, "c\nd"], pa.large_string())):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode.batch(column)] == [reference("a b"), [], reference("c\nd")]
    assert encode.batch(pa.array([], pa.string())) == [] and encode.batch(pa.array([None, ""], pa.string())) == [b"", b""]
