"""Exact, cached tokenisation with a word-level BPE vocabulary file.

The vocabulary ends every merge at a pre-token, so the ids of a text are the ids of its
pre-tokens, one after the other.  Pre-tokens repeat heavily: a bounded table from pre-token to
ids answers most of them, for a whole batch of texts at once, and only unseen ones reach the
tokenizer.  The table holds the bytes of a pre-token and compares them, so a shared hash gives no
wrong ids.  Texts outside the range for which the split is reproduced here, and texts that hold an
added token of the vocabulary, go to the tokenizer whole, so the result is the tokenizer's for every
text.  Null counts as empty; texts of any length are taken whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: The vocabulary file used by the token operators and its id for the end of a text.
WORD_BPE = "word_bpe_49k.json"
END_OF_TEXT = 49407

#: Texts for which the split below (or lower-casing) could differ from the vocabulary's own:
#: beyond Latin-1, with control characters, or with an apostrophe (contractions are split apart).
_ELSE = re.compile("[^\t-\r -&(-~\xa1-\xac\xae-\xff]")

_SPACE, _LETTER, _DIGIT, _SYMBOL = range(4)


def _classes() -> np.ndarray:
    table = np.full(256, _SYMBOL, np.uint8)
    for i in range(256):
        c = chr(i)
        if c.isspace():
            table[i] = _SPACE
        elif c.isalpha():
            table[i] = _LETTER
        elif c.isnumeric():
            table[i] = _DIGIT
    return table


_CLASS = _classes()
_CHARS = 4_000_000
#: Pre-tokens of up to this many bytes are table keys, as whole 8-byte words; longer ones are kept by their bytes.
_KEY_WORDS = 4
_LONGEST = 8 * _KEY_WORDS
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def vocabulary_path(name: str = WORD_BPE) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class CachedTokenizer:
    """Token ids of texts.  ``slots`` (a power of two) bounds the table's memory, not the results.

    The vocabulary's added tokens (such as the end of a text) are recognised inside texts, as the tokenizer
    itself does; with ``special_as_text`` they are spelled out like any other text.
    """

    def __init__(self, path: str, slots: int = 1 << 21, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = special_as_text
        added = [] if special_as_text else [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.model = self.whole.model
        self.mask = np.uint64(slots - 1)
        self.most = slots // 2
        self.forget()

    def forget(self) -> None:
        slots = int(self.mask) + 1
        self.hashes = np.zeros(slots, np.uint64)
        self.entry = np.zeros(slots, np.int32)
        room = min(1 << 12, self.most)
        self.words = np.zeros((room, _KEY_WORDS), np.uint64)
        self.at = np.zeros(room, np.int64)
        self.size = np.zeros(room, np.int64)
        self.pool = np.zeros(1 << 16, np.uint16)
        self.pooled = self.known = 0
        self.long: dict[bytes, np.ndarray] = {}

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1 - the free slot where it may go."""
        slot = (hashes & self.mask).astype(np.int64)
        found = self.hashes[slot]
        out = np.where(found == hashes, slot, -1 - slot)
        open_ = np.flatnonzero((found != hashes) & (found != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            s, found = slot[open_], self.hashes[slot[open_]]
            same = found == hashes[open_]
            out[open_] = np.where(same, s, -1 - s)
            open_ = open_[~same & (found != 0)]
        return out

    def _ids_of(self, word: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize("".join([_BYTE_CHAR[b] for b in word.decode("latin-1").encode()]))]

    def _long_ids(self, word: bytes) -> np.ndarray:
        if word not in self.long:
            if len(self.long) >= 1024:
                self.long.clear()
            ids = np.array(self._ids_of(word), np.uint16)
            if len(word) > 4096:
                return ids
            self.long[word] = ids
        return self.long[word]

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number in each text."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = "\n".join(texts).encode("latin-1") + b"\n"
        padded = np.frombuffer(raw + bytes(_LONGEST), np.uint8)
        kind = _CLASS[padded[: len(raw)]]
        edge = np.empty(len(raw), bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge |= kind == _DIGIT
        at = np.flatnonzero(edge)
        stop = np.append(at[1:], len(raw))
        word = kind[at] != _SPACE
        at, stop = at[word], stop[word]
        if not len(at):
            return np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
        # the bytes of each pre-token as 8-byte words: equal keys are equal pre-tokens (none has a byte 0)
        eights = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(raw) + _LONGEST - 8,), (1,), writeable=False)
        width = stop - at
        keys = np.empty((len(at), _KEY_WORDS), np.uint64)
        hashes = np.zeros(len(at), np.uint64)
        for k in range(_KEY_WORDS):
            keys[:, k] = eights[at + 8 * k] & _MASKS[np.clip(width - 8 * k, 0, 8)]
            hashes = (hashes ^ keys[:, k]) * _ODD[k]
            hashes ^= hashes >> np.uint64(29)
        hashes |= np.uint64(1) << np.uint64(63)
        short = width <= _LONGEST
        slot = np.where(short, 0, -1)
        slot[short] = self._find(hashes[short])
        new = np.flatnonzero(short & (slot < 0))
        if len(new):
            fresh, first = np.unique(hashes[new], return_index=True)
            if self.known + len(fresh) > self.most:
                if len(fresh) > self.most:
                    return self._halves(texts)
                self.forget()
                return self._plain(texts)
            for i in new[first].tolist():
                self._learn(hashes[i], keys[i], raw[at[i] : stop[i]])
            slot[new] = self._find(hashes[new])
        entry = self.entry[slot]
        start, size = self.at[entry], self.size[entry]
        pool = self.pool
        # long pre-tokens, and those that share a hash with another one, go to the tokenizer one by one
        alone = np.flatnonzero(~short | (self.words[entry] != keys).any(1))
        if len(alone):
            own = [self._long_ids(raw[at[i] : stop[i]]) for i in alone.tolist()]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            start[alone], size[alone] = self.pooled + np.cumsum(sizes) - sizes, sizes
            pool = np.concatenate([pool[: self.pooled], *own])
        ends = np.cumsum(size)
        ids = pool[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)]
        bounds = np.searchsorted(at, np.cumsum(lengths + 1))
        until = np.concatenate([[0], ends])[bounds]
        return ids, np.diff(until, prepend=0)

    def _halves(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(texts) == 1:
            ids = np.asarray(self.whole.encode(texts[0], add_special_tokens=False).ids, np.uint16)
            return ids, np.array([len(ids)])
        half = len(texts) // 2
        a, b = self._plain(texts[:half]), self._plain(texts[half:])
        return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])

    def _learn(self, h: np.uint64, key: np.ndarray, word: bytes) -> None:
        ids = self._ids_of(word)
        if self.pooled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint16)])
        if self.known == len(self.at):
            self.words, self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.words, self.at, self.size))
        mask = int(self.mask)
        slot = int(h) & mask
        while self.hashes[slot]:
            slot = (slot + 1) & mask
        self.hashes[slot], self.entry[slot] = h, self.known
        self.words[self.known], self.at[self.known], self.size[self.known] = key, self.pooled, len(ids)
        self.pool[self.pooled : self.pooled + len(ids)] = ids
        self.pooled += len(ids)
        self.known += 1

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids (16 bits each) of each text, in order; null counts as empty."""
        out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(texts)
        group: list[int] = []
        chars = 0

        def flush() -> None:
            nonlocal chars
            ids, sizes = self._plain([texts[i].lower() for i in group])
            for i, part in zip(group, np.split(ids, np.cumsum(sizes)[:-1])):
                out[i] = part
            group.clear()
            chars = 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) >= _CHARS or _ELSE.search(text) or (self.added and self.added.search(text.lower())):
                out[i] = np.asarray(self.whole.encode(text, add_special_tokens=False).ids, np.uint16)
                continue
            if chars + len(text) + 1 > _CHARS:
                flush()
            group.append(i)
            chars += len(text) + 1
        if group:
            flush()
        return out


def _byte_chars() -> list[str]:
    """The characters that byte-level vocabularies write for the bytes 0 to 255."""
    out, other = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(other))
            other += 1
    return out


_BYTE_CHAR = _byte_chars()
_INSTANCES: dict[tuple[str, bool], CachedTokenizer] = {}


def tokenizer(path: str, special_as_text: bool = False) -> CachedTokenizer:
    """The tokenizer of this process for a vocabulary file; Python workers are reused, so is its table."""
    key = path, special_as_text
    if key not in _INSTANCES:
        _INSTANCES[key] = CachedTokenizer(path, special_as_text=special_as_text)
    return _INSTANCES[key]
