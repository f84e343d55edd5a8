"""Ids of the word-level BPE tokenizer (lower case, white space dropped), text by text, as the tokenizers library gives them.

White space never enters an id, so a text's ids are those of its runs of other characters. A run of Latin letters with points or
commas after them is two pieces, its letters in lower case and the marks; any other run is one piece. A worker process keeps
the ids of the pieces it has met (by their bytes), up to a bounded number and size. New pieces of letters are given to the library
many at once, with spaces between: each is one word, and the last id of a word says that it ends one, so the ids are cut there.
All other pieces are given to it one by one.
"""

from __future__ import annotations

import itertools

import numpy as np

from lakeloom.llm._common import Texts, distinct, ragged, split
from lakeloom.llm.bpe import load

MOST_KNOWN, MOST_BYTES, AT_ONCE = 1_200_000, 32 << 20, 1 << 18
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord("."), ord(",")]] = True


def plain(words: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Which words are Latin letters (that normalisation to composed form leaves alone) with any points and commas after them, and
    how many points and commas those have."""
    data, first, last = words.data, words.offsets[:-1], words.offsets[1:]
    mark, lead = _MARK[data], data == 0xC3  # the lead byte of À to ÿ, of which × and ÷ are no letters
    after = np.concatenate([[False], lead[:-1]]) if len(data) else lead
    letter = _ASCII[data] | lead | (after & (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7))
    count = lambda x: np.concatenate([[0], np.cumsum(x)])
    odd, marks = count(~(letter | mark)), count(mark)
    back = count(np.concatenate([[False], mark[:-1] & letter[1:]])) if len(data) else count(mark)  # a letter behind a mark
    some = first < last
    good = some & (odd[last] == odd[first]) & (back[last] == back[np.minimum(first + 1, last)])
    good[good] &= letter[first[good]]
    return good, np.where(good, marks[last] - marks[first], 0)


def lower(words: Texts, which: np.ndarray) -> Texts:
    """Words with the Latin letters of those that `which` says in lower case."""
    data = words.data
    after = np.concatenate([[False], data[:-1] == 0xC3]) if len(data) else np.empty(0, bool)
    capital = ((data >= 65) & (data <= 90)) | (after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97))
    return Texts(data + ((capital & np.repeat(which, np.diff(words.offsets))).view(np.uint8) << 5), words.offsets)


class WordIds:
    def __init__(self, path: str, ordinary: bool):
        self.tokenizer = load(path, ordinary)
        self.known: dict[bytes, int] = {}
        self.begin, self.length, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)
        self.used = self.held = 0
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and how many each has."""
        every = Texts(np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in pieces])]).astype(np.int64))
        good, marks = plain(every)
        good &= marks == 0
        together, alone = np.flatnonzero(good), np.flatnonzero(~good)
        lengths, parts = np.zeros(len(pieces), np.int64), []
        for i in range(0, len(together), AT_ONCE):
            own = together[i : i + AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join([pieces[k] for k in own]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(own) or ends[-1] != len(ids):
                raise AssertionError("words and ends do not agree")
            lengths[own] = np.diff(np.concatenate([[0], ends]))
            parts.append(ids)
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[k].decode(errors="replace") for k in alone], add_special_tokens=False)]
        lengths[alone] = [len(x) for x in rest]
        parts.append(np.array([i for x in rest for i in x], np.uint32))
        order = np.concatenate([together, alone])
        flat, begin = np.concatenate(parts), np.zeros(len(pieces), np.int64)
        begin[order] = np.cumsum(lengths[order]) - lengths[order]
        return flat[ragged(begin, lengths)], lengths

    def _slots(self, pieces: Texts) -> np.ndarray:
        """Where the ids of distinct pieces are kept."""
        if len(self.known) > MOST_KNOWN or self.held > MOST_BYTES:
            self.known, self.used, self.held = {}, 0, 0
        data, at = pieces.data.tobytes(), pieces.offsets.tolist()
        keys = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        slot = np.fromiter(map(self.known.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new = [keys[k] for k in missing]
            flat, lengths = self._encode(new)
            self.held += sum(map(len, new))
            at = len(self.known)
            for name, need in (("begin", at + len(new)), ("length", at + len(new)), ("ids", self.used + len(flat))):
                array = getattr(self, name)
                if need > len(array):
                    setattr(self, name, np.concatenate([array, np.zeros(max(need - len(array), len(array)), array.dtype)]))
            self.begin[at : at + len(new)] = self.used + np.cumsum(lengths) - lengths
            self.length[at : at + len(new)] = lengths
            self.ids[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
            slot[missing] = np.arange(at, at + len(new))
        return slot

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit) one text after another, and where each text's ids begin (one more than texts)."""
        starts, ends, bounds = split(texts)
        words, inverse = distinct(texts, starts, ends)
        good, marks = plain(words)
        words, many = lower(words, good), 1 + (marks > 0)
        first = np.cumsum(many) - many  # of each word's pieces
        start, stop = np.zeros(int(many.sum()), np.int64), np.zeros(int(many.sum()), np.int64)
        start[first], stop[first] = words.offsets[:-1], words.offsets[1:] - marks
        two = np.flatnonzero(marks)
        start[first[two] + 1], stop[first[two] + 1] = stop[first[two]], words.offsets[1:][two]
        pieces, which = distinct(words, start, stop)
        slot = self._slots(pieces)[which]
        each = np.concatenate([[0], np.cumsum(many[inverse])])  # pieces of the words of the texts
        slot = slot[ragged(first[inverse], many[inverse])]
        lengths = self.length[slot].astype(np.int64)
        return self.ids[ragged(self.begin[slot], lengths)], np.concatenate([[0], np.cumsum(lengths)])[each[bounds]]


_READY: dict[tuple[str, bool], WordIds] = {}


def word_ids(path: str, ordinary: bool = False) -> WordIds:
    """One per worker process. ordinary: see load."""
    if (path, ordinary) not in _READY:
        _READY[path, ordinary] = WordIds(path, ordinary)
    return _READY[path, ordinary]
