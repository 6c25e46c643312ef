"""Whole-text token ids by the tokenizers library, fast enough to sit in a scan.

A byte-level BPE with the usual word pattern never joins what stands before a single space or line end and what
follows it, so a text's ids are the ids of its chunks, led by a space or line end, one after another.  Chunks repeat, so each worker keeps the
ids of those it has met (a bounded number, the ones met in most batches) in one array, gives the library only new
ones, and puts a batch's ids together by one gather.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_loaded: dict = {}
_CUT = re.compile(r"(?= \S)|(?<=\S)(?=\n\S)")
_BLANK = r"[\s\v\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = _BLANK.replace(r"\s", r"\t\f\r") + rf"|^{_BLANK}|{_BLANK}{_BLANK}|{_BLANK}\z"
_LETTER = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]"  # letters in every version of Unicode
_MARKS = r"[!-/:-@\[-`{-~]+"
_MARKED, _ENDS_MARKED = rf"(?s)\A(?P<bare>.*{_LETTER})(?P<marks>{_MARKS})\z", rf"{_LETTER}{_MARKS}\z"


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _bytes(words: pa.Array) -> np.ndarray:
    return pc.binary_length(words).to_numpy().astype(np.int64)


class Encoder:
    def __init__(self, path: str, keep: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        model = json.loads(self.tok.to_str())
        pre = model.get("pre_tokenizer") or {}
        plain_tokens = all(t.get("special") for t in model.get("added_tokens") or [])  # others are found across spaces
        self.by_chunk = plain_tokens and model.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        vocab = self.tok.get_vocab()
        self.n_ids = max(vocab.values()) + 1
        self.width = np.zeros(self.n_ids, np.int64)
        for piece, i in vocab.items():
            self.width[i] = len(piece)  # a character stands for a byte
        self.keep = keep
        # A word (without the space that leads it, with a line end that does) has a slot -> where its ids start in `ids` and how many they are, and the batches that it was met in.
        self.slot: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint16 if self.n_ids <= 1 << 16 else np.uint32)
        self.start, self.size, self.met = (np.zeros(1 << 14, np.int32) for _ in range(3))
        self.used = 0

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Puts the ids of new words behind the others; their slots."""
        n, m = len(self.slot), len(sizes)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + m > len(self.start):
            self.start, self.size, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.met))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[n : n + m], self.size[n : n + m], self.met[n : n + m] = self.used + np.cumsum(sizes) - sizes, sizes, 0
        return np.arange(n, n + m)

    def _add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        slots = self._append(ids, sizes)
        self.used += len(ids)
        self.slot.update(zip(_strings(words), slots.tolist()))

    def _find(self, words: pa.Array) -> np.ndarray:
        """The slots of words, -1 for new ones."""
        return np.fromiter(map(self.slot.get, _strings(words), repeat(-1)), np.int64, len(words))

    def _learn(self, words: pa.Array) -> None:
        """Ids of words with what leads them by one call for many: the bytes that ids stand for show where a word ends.

        A call's texts are short, as long ones take the library more time a word.
        """
        for at in range(0, len(words), 5000):
            some = words.slice(at, 5000)
            led = pc.starts_with(some, "\n")
            names = _strings(pc.if_else(led, some, pc.binary_join_element_wise("", some, " ")))
            texts = ["".join(names[k : k + 200]) for k in range(0, len(names), 200)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(_bytes(some) + ~led.to_numpy(zero_copy_only=False))) + 1
            self._add(some, ids, np.diff(ends, prepend=0))

    def _learn_marked(self, words: pa.Array) -> None:
        """Words that end in a letter and marks: the pattern cuts between the two, so these are a word's ids and the marks'."""
        parts = pc.extract_regex(words, _MARKED)
        bare, marks = (parts.field(k).dictionary_encode() for k in range(2))
        known = self._find(bare.dictionary)
        self._learn(bare.dictionary.filter(pa.array(known < 0)))
        slots = self._find(bare.dictionary)[bare.indices.to_numpy()]
        ids = self._plain(_strings(marks.dictionary))
        some = self._append(np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64))[marks.indices.to_numpy()]
        self._add(words, self._gather(np.stack([slots, some], 1).ravel()), self.size[slots] + self.size[some])

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _slots(self, words: pa.Array) -> np.ndarray:
        """The slots of different words."""
        slots = self._find(words)
        if len(new := np.flatnonzero(slots < 0)):
            some = words.take(pa.array(new))
            marked = pc.match_substring_regex(some, _ENDS_MARKED)
            self._learn(some.filter(pc.invert(marked)))
            self._learn_marked(some.filter(marked))
            slots[new] = self._find(some)
        self.met[slots] += 1
        return slots

    def _forget(self) -> None:
        """Leaves the half of the words that were met in most batches."""
        names, n = list(self.slot), len(self.slot)
        kept = np.sort(np.argsort(-self.met[:n], kind="stable")[: self.keep // 2])
        ids, sizes, met = self._gather(kept), self.size[kept], self.met[kept]
        self.slot, self.used = {}, 0
        self._append(ids, sizes)
        self.used, self.met[: len(kept)] = len(ids), met
        self.slot = {names[k]: i for i, k in enumerate(kept.tolist())}

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        """The ids of slots, one after another."""
        size = self.size[slots]
        before = np.cumsum(size) - size
        return self.ids[np.repeat(self.start[slots] - before, size) + np.arange(int(size.sum()))]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) one after another, and where each text ends."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_chunk:
            out = self._plain(texts.to_pylist())
            return np.array([i for ids in out for i in ids], np.uint32), np.cumsum([len(x) for x in out], dtype=np.int64)
        if len(self.slot) > self.keep:
            self._forget()
        # Runs of white space: such texts are cut only where a word begins.
        odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)).tolist()
        cut = {i: _CUT.split(texts[i].as_py()) for i in odd}
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        code = split.flatten().dictionary_encode()
        at, code, words = split.offsets.to_numpy(), code.indices.to_numpy(), code.dictionary
        inner = np.ones(len(code), bool)
        inner[at[:-1]] = False
        for i in odd:
            inner[at[i] : at[i + 1]] = False
        used = np.zeros(len(words), bool)
        used[code[inner]] = True
        others = list(dict.fromkeys(w.removeprefix(" ") for i in odd for w in cut[i][1:]))
        slot_of = np.zeros(len(words), np.int64)
        slot_of[used] = self._slots(words.filter(pa.array(used)))
        other = dict(zip(others, self._slots(pa.array(others, pa.string())).tolist()))
        # The beginnings of texts have no space before them: they are looked up by nobody else, so they are not kept.
        first = _strings(words.take(pa.array(code[at[:-1]])))
        heads = self._plain([cut[i][0] if i in cut else w for i, w in enumerate(first)])
        head = self._append(np.array([i for ids in heads for i in ids], np.uint32), np.array([len(x) for x in heads], np.int64))
        slots = slot_of[code]
        slots[at[:-1]] = head
        counts = np.diff(at).astype(np.int64)
        if odd:
            pieces = [slots[at[i] : at[i + 1]] if i not in cut else np.array([head[i], *(other[w.removeprefix(" ")] for w in cut[i][1:])], np.int64) for i in range(len(texts))]
            slots, counts = np.concatenate(pieces), np.array([len(p) for p in pieces])
        ends = np.cumsum(self.size[slots])[np.cumsum(counts) - 1] if len(texts) else np.zeros(0, np.int64)
        return self._gather(slots).astype(np.uint32), ends


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def give_back() -> None:
    """Hands freed memory back to the system: a worker stays for later stages, beside an executor that then needs it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def encoded(path: str, texts: pa.Array, most: int = 1 << 23):
    """(position, ids) of each text, ids as little-endian unsigned 32-bit integers, a few MB of text at a time."""
    enc = encoder(path)
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most)))
        ids, ends = enc.encode(texts.slice(start, end - start))
        raw, at = ids.astype("<u4").tobytes(), 0
        for k, stop in enumerate((4 * ends).tolist(), start):
            yield k, raw[at:stop]
            at = stop
        start = end
