"""The word table against the library, on hard characters, long words, nulls and slices of any cut."""

import random

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from webdelta.llm import token_files  # noqa: E402

VOCAB = public_tokenizers.path("word_bpe_49k.json")
HARD = ["a", "B", "7", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", " ", " ", "　", "é", "é", "日", "\U0001f600", "'s", "<|endoftext|>", ".", "-", "_", "​", "İ", "ß"]


def test_texts_equal_the_library(monkeypatch):
    t = tokenizers.Tokenizer.from_file(VOCAB)
    rng = random.Random(3)
    texts = [None, "", " ", "x" * 64, "x" * 65, "é" * 900, "word " * 400 + "y" * 3000]
    texts += ["".join(rng.choice(HARD) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    monkeypatch.setattr(token_files, "BLOCK", 1000)
    monkeypatch.setattr(token_files, "TABLE", 500)
    code = token_files.id_code(VOCAB, 2)
    words = token_files.Library(VOCAB, code, 2)
    column, got = pa.array(texts), []
    at = 0
    while at < len(texts):
        n = rng.randint(1, 400)
        got += words.ids(column.slice(at, n)).to_pylist()
        at += n
    want = [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert [np.frombuffer(g, code).tolist() for g in got] == want
    assert words.ids(pa.array([], pa.string())).to_pylist() == []


class Counted:
    """The library, counting the texts and lists that it gets."""

    def __init__(self, inner):
        self.inner, self.items = inner, 0

    def encode_batch_fast(self, items, **how):
        self.items += len(items)
        return self.inner.encode_batch_fast(items, **how)


def test_new_words_go_to_the_library_by_text():
    t = tokenizers.Tokenizer.from_file(VOCAB)
    rng = random.Random(4)
    plain = ["a", "Zq", "7", "42", "é", "ÀÉ", "ß", "ÿ", ".", ",", "-", "###", "|", "&", '"', "_"]
    odd = ["'", "'s", "'sun", "'LL", "<", "</w>", "<|endoftext|>", "<|startoftext|>", "×", "÷", "\x00", "\x1c", "\x7f", "\x85", "\xa0", "é", "́", "İ", "ǅ", "Σ", "日", "\U0001f600", "²", "¼"]
    words = ["".join(rng.choice(plain) for _ in range(rng.randint(1, 12))) + str(i) for i in range(20000)]
    words += ["".join(rng.choice(plain + odd) for _ in range(rng.randint(1, 8))) for _ in range(20000)]
    words += ["é" * 40 + ".", "'" * 70, "ab1" * 30]
    texts = [" ".join(words[a : a + 50]) for a in range(0, len(words), 50)]
    lib = token_files.Library(VOCAB, token_files.id_code(VOCAB, 2), 2)
    lib.tokenizer = counted = Counted(lib.tokenizer)
    ids = lambda some: [np.frombuffer(x, lib.code).tolist() for a in range(0, len(some), 300) for x in lib.ids(pa.array(some[a : a + 300])).to_pylist()]
    got = ids(texts[:400])
    assert counted.items * 40 < 20000
    assert got + ids(texts[400:]) == [e.ids + [2] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_words_that_are_miscounted_go_to_the_library_as_lists():
    t = tokenizers.Tokenizer.from_file(VOCAB)
    lib = token_files.Library(VOCAB, token_files.id_code(VOCAB, 2), 2)
    words = [b"stone", b"river-7", b"x"]
    ids, n = lib._joined(words, np.array([1, 1, 1]))
    want = [e.ids for e in t.encode_batch([w.decode() for w in words], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
