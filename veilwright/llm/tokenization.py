"""Ids of whole texts from a public tokenizer file, with each distinct piece of text encoded once per worker.

Both tokenizers first split a text at white space: no part of theirs reaches from a character that is not white space into
white space. So a text is cut before each blank and line feed, the pieces are encoded by the tokenizers library and remembered,
and their ids joined are the ids of the text. Where white space runs on, or a piece holds other white space or control
characters, the text is encoded whole. So it is where an added token such as ``<|endoftext|>`` stands in it: the ids are those of
the library's plain call. Texts are cut, and pieces looked up, many at a time by NumPy.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Sequence

import numpy as np
import regex

from .common import remembers
from .keys import WIDTH, KeyTable, groups, grown, keys_of

#: White space beyond blank and line feed, and characters that engines class in different ways.
UNUSUAL = regex.compile("[\\x00-\\x09\\x0b-\\x1f\\x7f-\\xa0\\xad\\u0300-\\u036f\\u061c\\u1680\\u180e"
                        "\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\ufeff]")
# The patterns by which the tokenizer files split a text.
BYTE_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
PLAIN = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
LIMIT = 1_500_000  # pieces that are remembered
PARTS = 250_000
CHARS = 4_000_000
LINE = 64  # new words that are encoded as one text
LONG_BYTES = 16_000_000  # of those in the dictionary, and their ids in the table

# Classes of bytes: where texts are cut, what is encoded whole, and what a comma or stop may follow.
OTHER, WHITE, CONTROL, LETTER, STOP = range(5)
NOTHING, FEED, COMMA, FULL_STOP = range(4)  # the first entries: no ids, and what a cut may stand for
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[:32] = CONTROL
CLASSES[127] = CONTROL
CLASSES[[10, 32]] = WHITE
CLASSES[np.r_[65:91, 97:123]] = LETTER
CLASSES[[44, 46]] = STOP


class Pieces(KeyTable):
    """Ids by piece. When ``limit`` entries are there, those that were met again since the last time stay. The entries of ``fixed``
    always stay. An entry of size -1 has no ids: its piece is unusual."""

    def __init__(self, limit: int, dtype: np.dtype, fixed: list[bytes]) -> None:
        self.limit, self.dtype, self.fixed = limit, dtype, fixed
        self._empty()

    def _empty(self) -> None:
        super().__init__()
        self.used = 0
        self.first, self.size = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.ids = np.zeros(1 << 12, self.dtype)
        self.longer: dict[tuple[int, bytes], int] = {}
        self.long_bytes = 0
        size = np.array([len(x) for x in self.fixed], np.int64) // self.dtype.itemsize
        self.enter(np.zeros((len(size), 3), np.uint64), np.frombuffer(b"".join(self.fixed), self.dtype), size)

    def turn(self) -> None:
        """Called between texts, never while numbers of entries are in use."""
        if self.n <= self.limit and self.long_bytes <= LONG_BYTES:
            return
        stay = self.met_again()
        stay = stay[self.size[stay] >= 0]
        keys, size = self.keys[stay], self.size[stay]
        ids = self.ids[spread(self.first[stay], size)]
        self._empty()
        if len(stay) <= self.limit // 2:
            self.enter(keys, ids, size)

    def enter(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entries for pieces that have none, their ids one after another."""
        new = self.add(keys)
        self.first, self.size = grown(self.first, self.n), grown(self.size, self.n)
        self.size[new] = size
        size = np.maximum(size, 0)
        self.first[new] = self.used + np.cumsum(size) - size
        self.ids = grown(self.ids, self.used + len(ids))
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        return new


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each stretch, one stretch after another."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """``keeps_space``: white space is part of the ids, as in byte-level vocabularies; else it is dropped, and so is case."""

    def __init__(self, path: str, keeps_space: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            source = json.load(f)
        self.full = Tokenizer.from_file(path)
        # Texts with added tokens in them are encoded whole, since those are found before anything is split.
        added = [t["content"] for t in source["added_tokens"]]
        self.marks = regex.compile("|".join(map(regex.escape, added)), regex.IGNORECASE) if added else None
        self.plain_marks = all(not c.isalpha() for t in added for c in (t[0], t[-1]))
        self.spaced_marks = any(c.isspace() for t in added for c in t)
        # In vocabularies with blanks a word's first id says so, in the others its last one.
        vocabulary = self.full.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        suffix = source["model"].get("end_of_word_suffix")
        for token, i in vocabulary.items():
            self.edge[i] = token.startswith("Ġ") if keeps_space else bool(suffix) and token.endswith(suffix)
        # For parts that are split and in lower case already; without blanks in them, several to a text.
        split = PLAIN if keeps_space else {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, PLAIN]}
        self.part = Tokenizer.from_str(json.dumps(source | {"normalizer": None, "pre_tokenizer": split, "added_tokens": []}))
        self.line = self.full if keeps_space else self.part
        self.keeps_space = keeps_space
        self.code = "H" if self.full.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        # A comma or stop after a letter, before white space, is a part of its own.
        self.cuts = self.plain_marks and not any(c in t for t in added for c in ",.")
        self.parts: dict[str, bytes] = {}
        self.feed = self._whole("\n") if keeps_space else b""  # before a character that is not white space
        fixed = [b"", self.feed, *self._pack(self.part.encode_batch_fast([",", "."], add_special_tokens=False))]
        self.known = Pieces(LIMIT, self.dtype, fixed)  # pieces after a blank, or after a line feed

    def _pack(self, encodings) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in encodings]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters, many words to a text."""
        if not self.edge.any():
            return self._pack(self.part.encode_batch_fast(words, add_special_tokens=False))
        lines = [words[i:i + LINE] for i in range(0, len(words), LINE)]
        texts = [" " + " ".join(line) if self.keeps_space else " ".join(line) for line in lines]
        out: list[bytes] = []
        size = self.dtype.itemsize
        for line, e in zip(lines, self.line.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            at = np.flatnonzero(self.edge[ids])
            ends = np.append(at[1:], len(ids)) if self.keeps_space else at + 1
            if len(ends) != len(line) or (self.keeps_space and at[0] != 0):  # the file splits words of letters
                out += self._pack(self.full.encode_batch_fast(
                    [" " + w if self.keeps_space else w for w in line], add_special_tokens=False))
                continue
            data, stops = ids.tobytes(), (ends * size).tolist()
            out += [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        return out

    def _learn(self, pieces: list[str]) -> list[bytes | None]:
        """The ids of different pieces, None where one is unusual; a piece after a blank, or with a line feed first."""
        known: dict[str, bytes | None] = {}
        parts, blank = self.parts, " " if self.keeps_space else ""
        if len(parts) > PARTS:
            parts.clear()
        marks, unusual = self.marks, UNUSUAL.search
        # Most pieces are words of ASCII letters; the others are looked at one by one.
        words = list(filter(str.isascii, filter(str.isalpha, pieces))) if self.plain_marks else []
        ended, whole = [], []  # ended: a word with a comma or stop after it
        more: dict[str, list[str]] = {}
        for p in set(pieces).difference(words):
            latin = p.isascii() or max(p) < "Ā"  # beyond Latin-1, engines may split and lower-case in different ways
            if latin and p[-1] in ",." and p[:-1].isalpha():
                ended.append(p)
            elif latin and self.plain_marks and p.isalpha():
                words.append(p)
            elif unusual(p) or (marks and marks.search(p)):
                known[p] = None
            elif not latin:
                whole.append(p)
            elif blank and p[0] == "\n" and p[1:].isalpha():
                more[p] = ["\n", p[1:]]
            elif blank:
                more[p] = BYTE_PARTS.findall(p if p[0] == "\n" else " " + p)
            else:
                more[p] = WORD_PARTS.findall(p.lower())
        words += {p[:-1] for p in ended}.difference(words)
        known.update(zip(words, self._words(words if blank else [w.lower() for w in words]), strict=True))
        new = [w for w in {",", "."}.union(*more.values()) if w not in parts]
        parts.update(zip(new, self._pack(self.part.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        known.update([(p, known[p[:-1]] + parts[p[-1]]) for p in ended])
        for p, ws in more.items():
            known[p] = b"".join([parts[w] for w in ws])
        texts = [p if p[0] == "\n" else blank + p for p in whole]
        known.update(zip(whole, self._pack(self.full.encode_batch_fast(texts, add_special_tokens=False)), strict=True))
        return [known[p] for p in pieces]

    def _whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def ids(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each text; of NULL as of an empty text. Some ``CHARS`` characters are in pieces at a time."""
        out, some, size = [], [], 0
        for t in texts:
            some.append(t)
            size += len(t or "")
            if size > CHARS:
                out += self._ids(some)
                some, size = [], 0
        return out + self._ids(some)

    def _ids(self, texts: list[str | None]) -> list[np.ndarray]:
        self.known.turn()
        raw = [(t or "").encode() for t in texts]
        # A line feed stands before each text and after the last one, so every text begins and ends like a line.
        data = b"\n".join([b"", *raw, b""])
        data = data if self.keeps_space else data.lower()
        buffer = np.frombuffer(data, np.uint8)
        head = np.cumsum([0, *[len(r) + 1 for r in raw]])
        kind = CLASSES[buffer]
        cut = kind == WHITE
        white = np.flatnonzero(cut)
        whole = np.zeros(len(texts) + 1, bool)  # the last one: the line feed after all texts
        for at in (white[:-1][np.diff(white) == 1], np.flatnonzero(kind == CONTROL)):  # white space runs on
            whole[np.searchsorted(head, at, side="right") - 1] = True
        if self.spaced_marks:
            for i, t in enumerate(texts):
                whole[i] |= bool(t and self.marks.search(t))
        if self.cuts:
            stops = np.flatnonzero(kind == STOP)
            cut[stops[(kind[stops - 1] == LETTER) & (kind[stops + 1] == WHITE)]] = True
        at = np.flatnonzero(cut)
        # Places in turn: what a cut stands for, and the piece up to the next cut.
        entry = np.zeros((len(at), 2), np.int64)
        sign = buffer[at]
        entry[:, 0] = np.where(sign == 32, NOTHING, np.where(sign == 10, FEED, np.where(sign == 44, COMMA, FULL_STOP)))
        heads = np.searchsorted(at, head)
        entry[heads, 0] = 0
        start, length = at + 1, np.diff(at, append=at[-1] + 1) - 1
        if whole.any():
            text_of = np.repeat(np.arange(len(texts) + 1), np.diff(heads, append=len(at)))
            entry[whole[text_of]] = 0
            length[whole[text_of]] = 0
        first = (sign == 10).astype(np.int64) if self.keeps_space else np.zeros(len(at), np.int64)
        some = np.flatnonzero(length > 0)
        entry[some, 1] = self._entries(data, start[some], length[some], first[some])
        entry = entry.ravel()
        size = self.known.size[entry]
        odd = np.flatnonzero(size < 0)  # a piece is unusual
        if len(odd):
            whole[np.searchsorted(heads, odd >> 1, side="right") - 1] = True
            size[odd] = 0
        ids = self.known.ids[spread(self.known.first[entry], size)]
        ends = np.concatenate(([0], np.cumsum(size)))[2 * heads].tolist()
        return [np.frombuffer(self._whole(t or ""), self.dtype) if w else ids[a:b]
                for t, w, a, b in zip(texts, whole.tolist(), ends, ends[1:], strict=False)]

    def _entries(self, data: bytes, start: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The entry of each piece, new ones made; ``first``: the piece begins a line."""
        known = self.known
        keys = keys_of(data, start, length, first + 1)
        out = known.find(keys)
        short = length <= WIDTH
        lost = np.flatnonzero((out < 0) & short)
        if len(lost):
            order, fresh = groups(keys[lost])
            order = lost[order]
            one = order[fresh]
            out[order] = self._make(data, start[one], length[one], first[one], keys[one])[np.cumsum(fresh) - 1]
        far = np.flatnonzero(~short).tolist()
        if far:
            names = [(f, data[a:a + n]) for f, a, n in zip(first[far].tolist(), start[far].tolist(), length[far].tolist(), strict=True)]
            new = {name: i for name, i in zip(names, far, strict=True) if name not in known.longer}
            if new:
                i = np.array(list(new.values()))
                made = self._make(data, start[i], length[i], first[i], np.zeros((len(i), 3), np.uint64))
                known.longer.update(zip(new, made.tolist(), strict=True))
                known.long_bytes += int(length[i].sum()) + int(known.size[made].sum())
            out[far] = [known.longer[name] for name in names]
        return out

    def _make(self, data: bytes, start: np.ndarray, length: np.ndarray, first: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Entries of different pieces that have none."""
        pieces = [data[a:a + n].decode() for a, n in zip(start.tolist(), length.tolist(), strict=True)]
        pieces = ["\n" + p if f else p for p, f in zip(pieces, first.tolist(), strict=True)]
        cut = len(self.feed)
        found = [x and x[cut:] if f else x for x, f in zip(self._learn(pieces), first.tolist(), strict=True)]
        size = np.array([-1 if x is None else len(x) // self.dtype.itemsize for x in found])
        return self.known.enter(keys, np.frombuffer(b"".join(filter(None, found)), self.dtype), size)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keeps_space: bool) -> Encoder:
    """One encoder per worker process, whose memory of pieces outlives a task."""
    remembers("tokenization", _encoders.clear)
    key = (path, keeps_space)
    if key not in _encoders:
        _encoders[key] = Encoder(path, keeps_space)
    return _encoders[key]
