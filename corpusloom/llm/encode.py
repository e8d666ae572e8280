"""Encoding with the tokenizers library behind a cache of words.

Texts are cut at white space where no token of the vocabulary can cross.  Words
that a worker doesn't remember are encoded by the library in one call for a whole
batch of texts, set apart by a special token, and their ids are remembered.  Words
of Latin letters, digits and signs are split here by the two public patterns, and
the library gets the pieces without its normaliser and splitter, most of its time.
Texts
whose white space makes cutting unsafe, and texts that hold a special token's own
letters, are encoded whole by the library.  The ids are those of ``encode`` with
``add_special_tokens=False``.

Defined cases: a null text is empty and has no ids.
"""

from __future__ import annotations

import json
import re
from codecs import charmap_decode
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import worker_store

#: Words in the young half of the cache (some 170 bytes each), and words that the library gets at once.
WORDS, AT_ONCE = 1_000_000, 150
#: White space beyond ASCII, and separators on which libraries differ.
_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
_ODD_ASCII = "\x1c\x1d\x1e\x1f"
#: Runs of white space, or white space other than blanks and newlines.
_RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\v", "\f")
#: Characters below U+0180 but white space, controls and U+0130: their case and composition are one to one.
#: Runs of others; words are parted by blanks, and a newline only begins one.
_NOT_PLAIN = re.compile("[^ \n\r!-~\xa1-\xac\xae-\u012f\u0131-\u017f]+")
_L, _N = "A-Za-zªµº\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9²³¹¼½¾"
#: The splitters' patterns on plain words: byte-level (a blank or newline may come first), and lower-cased.
_SPACED = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^ \n{_L}{_N}]+|\n")
_LOWERED = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^ {_L}{_N}]+| ")
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
#: (normaliser, splitter, suffix) as vocabulary files have them, for which the patterns hold.
_KNOWN = (
    (None, _BYTE_LEVEL | {"use_regex": True}, None, _SPACED),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, _BYTE_LEVEL | {"use_regex": False}]},
        "</w>", _LOWERED,
    ),
)


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, others follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def _listed(values: pa.LargeStringArray, apart: str) -> list[str]:
    """The strings, none of which holds ``apart``; sooner made from one string than one by one."""
    ended = pc.binary_join_element_wise(values, *(pa.scalar(x, pa.large_string()) for x in ("", apart)))
    return ended.buffers()[2].to_pybytes()[: _offsets(ended)[-1]].decode().split(apart)[:-1]


def _offsets(values: pa.LargeStringArray | pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset)


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    A vocabulary without a normaliser is byte-level: a blank belongs to the word
    after it.  With others white space only separates.  The cache has two
    generations: words that aren't asked for again are forgotten.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.spaced = self.whole.normalizer is None
        added = self.whole.get_added_tokens_decoder()
        self.apart = next(((t.content, i) for i, t in sorted(added.items()) if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)), None)
        self.special = tuple({t.content for t in added.values()} | {t.content.lower() for t in added.values() if t.normalized})
        self.folded = any(t.normalized for t in added.values())
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        made = json.loads(self.whole.to_str())
        self.pattern = next((p for normaliser, splitter, suffix, p in _KNOWN if made["normalizer"] == normaliser and made["pre_tokenizer"] == splitter and made["model"].get("end_of_word_suffix") == suffix), None)
        if self.pattern is not None:
            self.light = Tokenizer.from_str(json.dumps(made | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
            # of pieces: a blank parts them
            letters = byte_letters() | {0: " "} | ({} if self.spaced else {32: " "})
            self.letters = "".join(letters[b] for b in range(256))
            self.sizes = np.zeros(self.whole.get_vocab_size(True), np.int64)
            for t, i in self.whole.get_vocab(False).items():
                self.sizes[i] = len(t.removesuffix("" if self.spaced else "</w>"))

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of ``words``."""
        if self.pattern is not None:
            words = self._learn_plain(words)
        for a in range(0, len(words), AT_ONCE):
            own = some = words[a : a + AT_ONCE]
            if self.spaced:  # how a word stands in its text: first, after a newline or after a blank
                some = [w[1:] if w[:1] == "\r" else w if w[:1] == "\n" else " " + w for w in own]
            if self.apart is None:
                ids = [e.ids for e in self.whole.encode_batch_fast(some, add_special_tokens=False)]
                self.young.update(zip(own, map(_packed, ids)))
                continue
            mark, number = self.apart
            ids = np.array(self.whole.encode_batch_fast([mark.join(some)], add_special_tokens=False)[0].ids, "<u4")
            stop = np.append(np.flatnonzero(ids == number), len(ids)) * 4
            if len(stop) != len(some):
                raise ValueError("a word holds a special token")
            raw = ids.tobytes()
            self.young.update(zip(own, [raw[x:y] for x, y in zip(np.append(0, stop[:-1] + 4).tolist(), stop.tolist())]))

    def _learn_plain(self, words: list[str]) -> list[str]:
        """Remember the ids of plain words; the other words.  A piece that several words share is encoded once."""
        odd = [m.start() for m in _NOT_PLAIN.finditer(" ".join(words))]
        if odd:
            stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            odd = sorted({*np.searchsorted(stops, odd, "right").tolist()})
            other, odd = [words[k] for k in odd], {*odd}
            words = [w for k, w in enumerate(words) if k not in odd]
        else:
            other = []
        if not words:
            return other
        if self.spaced:  # a first word stands as one after a newline, but for that newline's id
            found = self.pattern.findall("".join(["\n" + w[1:] if w[0] == "\r" else w if w[0] == "\n" else " " + w for w in words]))
        else:
            found = self.pattern.findall(" ".join(words).lower())
        pieces = pa.array(found, pa.large_string()).dictionary_encode()
        alike, at = _listed(pieces.dictionary, "\0"), pieces.indices.to_numpy()
        if self.spaced:
            begins = np.flatnonzero(np.array([x[0] in " \n" for x in alike])[at])
        else:  # blanks part words here
            blank = alike.index(" ") if " " in alike else len(alike)
            stops = np.flatnonzero(at == blank)
            begins, at = np.append(0, stops - np.arange(len(stops))), at[at != blank]
            at -= at > blank
            alike = [x for x in alike if x != " "]
        if len(begins) != len(words):
            raise ValueError("a piece crosses words")
        own = self._pieces(alike).take(pa.array(at))
        stops = _offsets(own)[np.append(begins[1:], len(own))].tolist()
        raw = own.buffers()[2].to_pybytes()
        self.young.update(zip(words, [raw[x:y] for x, y in zip([0, *stops], stops)]))
        if self.spaced:
            self.young.update([(w, self.young[w][4:]) for w in words if w[0] == "\r"])
        return other

    def _pieces(self, pieces: list[str]) -> pa.LargeBinaryArray:
        """Ids of pieces, which the library gets parted by blanks without its normaliser and splitter."""
        letters, ids = charmap_decode("\0".join(pieces).encode(), "strict", self.letters)[0].split(" "), []
        for a in range(0, len(letters), AT_ONCE):
            ids += self.light.encode_batch_fast([" ".join(letters[a : a + AT_ONCE])], add_special_tokens=False)[0].ids
        ids = np.array(ids, "<u4")
        # tokens are as long together as their piece
        done, ends = np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(map(len, letters), np.int64, len(letters)))
        last = np.searchsorted(done, ends)
        if last[-1] != len(ids) - 1 or (done[last] != ends).any():
            raise ValueError("a token crosses pieces")
        return pa.Array.from_buffers(pa.large_binary(), len(letters), [None, pa.py_buffer(np.append(0, 4 * (last + 1))), pa.py_buffer(ids)])

    def _words(self, text: str) -> str | None:
        """The words whose ids, end to end, are the text's, parted by single blanks; None if it can't be cut."""
        if (any(c in text for c in _ODD_ASCII) if text.isascii() else _ODD.search(text)) or any(t in text for t in self.special) or self.folded and any(t in text.lower() for t in self.special):
            return None
        if not self.spaced:
            return " ".join(text.split())
        if text[0] in " \n" or text[-1] in " \n" or any(r in text for r in _RUNS):
            return None
        return "\r" + text.replace("\n", " \n")  # the mark of a first word: no text that is cut has it

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        cut = [self._words(t) if t else "" for t in texts]
        if len(self.young) > WORDS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        full = [c for c in cut if c]
        raw, stops = b"", iter(())
        if full:
            # each word of the batch is looked up once
            flat = pc.split_pattern(pa.array([" ".join(full)], pa.large_string()), " ").values.dictionary_encode()
            words = _listed(flat.dictionary, " ")
            ids = list(map(young.get, words))
            new = [k for k, x in enumerate(ids) if x is None]
            if new:
                lost = [words[k] for k in new]
                known = [w for w in lost if w in old]
                young.update(zip(known, map(old.__getitem__, known)))
                if len(known) < len(new):
                    self._learn([w for w in lost if w not in old])
                for k, w in zip(new, lost):
                    ids[k] = young[w]
            ids = pa.array(ids, pa.large_binary()).take(flat.indices)
            raw = ids.buffers()[2].to_pybytes()
            stops = iter(_offsets(ids)[np.cumsum([c.count(" ") + 1 for c in full])].tolist())
        out, at = [], 0
        for text, words in zip(texts, cut):
            if words is None:
                out.append(_packed(self.whole.encode(text, add_special_tokens=False).ids))
            elif words:
                stop = next(stops)
                out.append(raw[at:stop])
                at = stop
            else:
                out.append(b"")
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


_encoders: dict[str, Encoder] = worker_store()


def encoder(path: str) -> Encoder:
    """One for each vocabulary and Python worker."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
