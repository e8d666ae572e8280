"""Words that are split here against the library's own encoding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from corpusloom.llm import encode, token_shards

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", FILES)
def test_plain_words_leave_out_normaliser_and_splitter(name):
    """Plain words don't go through the whole tokenizer; others, and only they, do."""
    enc = encode.Encoder(public_tokenizers.path(name))
    want = [encode._packed(enc.whole.encode(t, add_special_tokens=False).ids) for t in ("It's déjà vu,\nI'LL 12² pay!", "漢字 and İx")]
    asked, whole = [], enc.whole

    class Asked:
        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return whole.encode_batch_fast(texts, **more)

    enc.whole = Asked()
    assert enc.encode_all(["It's déjà vu,\nI'LL 12² pay!"]) == want[:1]
    assert [t for t in asked if "pay" in t] == []
    assert enc.encode_all(["漢字 and İx"]) == want[1:] and any("漢字" in t for t in asked)


@pytest.mark.parametrize("name", FILES)
def test_any_letters_encode_as_the_library_does(name):
    g = random.Random(7)
    letters = [chr(c) for c in range(0x20, 0x250)] + list("\n\n\n'''''sstrevmld..0123456789ΣσİıſŉΆ漢😀́")
    texts = ["".join(g.choice(letters) if g.random() < 0.8 else " " for _ in range(g.randrange(1, 60))).replace("  ", " ").strip() for _ in range(3000)]
    texts += ["a\n's b 'll", "I'LL it's 'S x's. .'s 12²³ ¼½ªº\nx", "\n", "x\ny", "", None]
    enc = encode.Encoder(public_tokenizers.path(name))
    want = [encode._packed(e.ids) for e in enc.whole.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert [x for a in range(0, len(texts), 250) for x in enc.encode_all(texts[a : a + 250])] == want


def test_words_that_return_are_not_encoded_again():
    """Half a million words between two uses of a word are within the cache."""
    enc = encode.Encoder(public_tokenizers.path(FILES[0]))
    texts = [" ".join(f"w{k}" for k in range(a, a + 5000)) for a in range(0, 500_000, 5000)]
    first = [enc.encode_all([t])[0] for t in texts]
    asked = []
    enc._learn = asked.extend
    assert [enc.encode_all([t])[0] for t in texts] == first and asked == []


def test_shards_are_read_in_one_expansion(monkeypatch):
    """Reading a whole shard expands its symbols once, not for each document."""
    g = np.random.default_rng(4)
    docs = [(k, g.integers(0, 30, g.integers(0, 90)).astype("<u4")) for k in range(200)]
    payload, made = token_shards.pack(docs, 50), []
    expand = token_shards.Grammar.expand
    monkeypatch.setattr(token_shards.Grammar, "expand", lambda self, seq: made.append(1) or expand(self, seq))
    batch = pa.RecordBatch.from_pydict({"part": [0], "base": [7], "payload": [payload]})
    (got,) = token_shards._read(iter([batch]))
    sizes = [len(x) for _, x in docs]
    assert got.column(2).to_pylist() == [7 + sum(sizes[:k]) for k in range(200)] and got.column(3).to_pylist() == sizes
    assert got.column(4).to_pylist() == [zlib.crc32(x) for _, x in docs] and len(made) < 50


@pytest.mark.parametrize("name", FILES)
def test_a_piece_that_words_share_is_encoded_once(name):
    """First words, and words that differ by their signs, bring no piece twice and don't go through the whole tokenizer."""
    enc = encode.Encoder(public_tokenizers.path(name))
    texts = ["So, so. (so) so!\nSo so", "déjà, so? déjà.\nSo", "So"]
    want = [encode._packed(e.ids) for e in enc.whole.encode_batch_fast(texts, add_special_tokens=False)]
    asked, light = [], enc.light

    class Asked:
        def encode_batch_fast(self, texts, **more):
            asked.extend(x for t in texts for x in t.split(" "))
            return light.encode_batch_fast(texts, **more)

    enc.light, enc.whole = Asked(), None
    assert enc.encode_all(texts) == want and asked and len(asked) == len(set(asked))


def test_small_batches_are_encoded_together(monkeypatch):
    """Batches are gathered to AT_ONCE bytes, in order and with none left out."""
    rows = [[(1, "a" * 50), (2, None)], [], [(3, "b")], [(None, "c" * 200)], [(5, "d")]]
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in b], pa.int64()), pa.array([t for _, t in b], pa.string())], names=["id", "text"]) for b in rows]
    monkeypatch.setattr(token_shards, "AT_ONCE", 200)
    got = [list(zip(*x)) for x in token_shards._gathered(iter(batches))]
    assert got == [[r for b in rows[:4] for r in b], rows[4]]
