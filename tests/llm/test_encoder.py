"""Ids of whole texts by distinct words: against the library on whole texts, and how often the library is asked."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from utterlake.llm import bpe, packing

PATH = bpe.vocabulary()
SIMPLE = [c for c in map(chr, range(0x2100)) if bpe.SIMPLE.fullmatch(c)]
OTHER = ["\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", "İ", "ſ", "÷", "é", "́", "ﬁ", "Σ", "中文", "٣", "½", "😀", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "</w>"]
TEXTS = ["", " ", "\n\t ", " it's  'S 'll we'RE don't''s ", "a1b22 c-3.14!?", "</w> a</w>", "<|endoftext|>", "x<|endoftext|><|startoftext|>y", "a<|b", "é é É", "中文 abc", "\x85a\xa0b", "".join(SIMPLE), " ".join(SIMPLE), "ab".join(SIMPLE), None]


def drawn(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices(SIMPLE + OTHER * r.choice((0, 0, 5)) + [" "] * 60 + ["'", "s", "ll"] * 10, k=r.randint(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("most", [20, 1_000_000])
def test_ids_are_the_library_s(most):
    texts = TEXTS + drawn(1, 600)
    want = [bpe.tokenizer(PATH).encode(t or "", add_special_tokens=False).ids for t in texts]
    known = bpe.Encoder(PATH, most)
    for lo, hi in [(0, len(texts)), (0, 0), (0, 1), *[(i, i + 7) for i in range(0, len(texts), 7)]]:
        got = known.ids(pa.array(texts, pa.string())[lo:hi])
        assert [x.tolist() for x in got] == want[lo:hi]


def test_words_that_keep_coming_are_encoded_once(monkeypatch):
    """Where more words come than are kept, those of the last call stay."""
    asked, encode = [], bpe.encode_words
    monkeypatch.setattr(bpe, "encode_words", lambda words, path: asked.extend(words) or encode(words, path))
    known = bpe.Encoder(PATH, 50)
    for k in range(20):
        known.ids(pa.array(["always there " + " ".join("q" + chr(97 + k) + chr(97 + i) for i in range(26))]))
        assert len(known.known) <= 50 + 28
    assert asked.count("always") == asked.count("there") == 1 and len(asked) <= 2 + 20 * 26 + 1


def test_words_are_encoded_together(monkeypatch):
    """A call of the library for each word was most of the time of op4."""
    words = sorted({"".join(random.Random(i).choices("abcdefghij", k=6)) for i in range(5000)})
    real, texts = bpe.word_tokenizer(PATH), []

    class Spy:
        model, id_to_token, get_vocab_size = real.model, real.id_to_token, real.get_vocab_size

        def encode_batch_fast(self, batch, **more):
            texts.extend(batch)
            return real.encode_batch_fast(batch, **more)

    monkeypatch.setattr(bpe, "word_tokenizer", lambda path: Spy())
    count, flat = bpe.encode_words(words, PATH)
    assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] == [e.ids for e in real.encode_batch_fast(words, add_special_tokens=False)]
    assert len(texts) <= len(words) / 50


def test_slices_hold_every_text_once():
    texts = ["a" * n for n in (5, 0, 30, 1, 1, 9, 100, 0)] + [None, "b"]
    parts = packing.slices(pa.array(texts), 10)
    assert [t for p in parts for t in p.to_pylist()] == texts and 4 <= len(parts) <= 8
    assert packing.slices(pa.array([], pa.string())) == []
