"""Token ids and spans of whole texts under the word BPE vocabulary.

That tokenizer lower-cases, drops white space and cuts a text into runs of letters,
single digits and runs of other characters; tokens never cross such runs. So a
text's ids are its runs' ids one after another, and each distinct run is encoded
once and remembered. Texts of ASCII and the Latin-1 letters are cut with array
arithmetic; any other text is cut at white space only or, where even that could
differ, encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from .textbytes import LOWER, Block, blocks, running, span_hash

#: Distinct runs that a worker remembers before it starts over.
REMEMBERED = 1_000_000
#: Runs encoded in one call.
_TOGETHER = 512

_LETTER, _DIGIT, _OTHER, _BLANK = 1, 2, 3, 0
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _BLANK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[0x80:] = _LETTER
_ODD = np.zeros(256, bool)  # bytes that send a text to the general way
_ODD[[39, 127]] = True
_ODD[:9] = _ODD[14:32] = True
_ODD[0xC0:] = True
_ODD[0xC3] = False
#: str.split() cuts at these, the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")

_shared: dict[int, "Encoder"] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(tokenizer_json: str) -> "Encoder":
    """One encoder for each worker process, so that what it remembers serves later tasks too."""
    key = hash(tokenizer_json)
    if key not in _shared:
        _shared.clear()
        _shared[key] = Encoder(tokenizer_json)
    return _shared[key]


class Encoder:
    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        vocab = self._tokenizer.get_vocab()
        n = max(vocab.values()) + 1
        self._ends, self._bytes = np.zeros(n, bool), np.zeros(n, np.int64)
        for token, i in vocab.items():
            self._ends[i] = token.endswith("</w>")
            self._bytes[i] = len(token) - 4 * self._ends[i]
        self._forget()

    def _forget(self) -> None:
        self._hash = np.zeros(0, np.uint64)
        self._at = np.zeros(0, np.int64)
        self._begin, self._size, self._n = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self._ids, self._used = np.zeros(4096, np.uint32), 0
        self._words: dict[str, np.ndarray] = {}

    def _learn(self, hashes: np.ndarray, runs: list[str]) -> None:
        found = []
        for i in range(0, len(runs), _TOGETHER * 64):
            texts = [" ".join(runs[j : j + _TOGETHER]) for j in range(i, min(i + _TOGETHER * 64, len(runs)), _TOGETHER)]
            found += [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(found)
        stop = np.flatnonzero(self._ends[ids]) + 1
        assert len(stop) == len(runs)
        begin = np.append(0, stop[:-1])
        while self._used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while self._n + len(runs) > len(self._begin):
            self._begin, self._size = (np.concatenate([x, np.zeros_like(x)]) for x in (self._begin, self._size))
        self._ids[self._used : self._used + len(ids)] = ids
        self._begin[self._n : self._n + len(runs)] = begin + self._used
        self._size[self._n : self._n + len(runs)] = stop - begin
        place = np.searchsorted(self._hash, hashes)
        self._hash = np.insert(self._hash, place, hashes)
        self._at = np.insert(self._at, place, np.arange(self._n, self._n + len(runs)))
        self._used += len(ids)
        self._n += len(runs)

    def _plain(self, block: Block, row_ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows marked: (ids, number of ids of each row, first byte of each id)."""
        raw = block.data
        data = LOWER[raw]
        second = np.zeros(len(data), bool)
        second[1:] = raw[:-1] == 0xC3
        data[second & (raw >= 0x80) & (raw <= 0x9E)] += 32
        kind = _KIND[data]
        size = np.diff(block.bounds)
        kind[np.repeat(~row_ok, size)] = _BLANK
        begins = kind != _BLANK
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        firsts = block.bounds[:-1][size > 0]
        begins[firsts] = kind[firsts] != _BLANK
        start = np.flatnonzero(begins)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(block.n, np.int64), np.zeros(0, np.int64)
        solid = running(kind != _BLANK)
        stop = start + np.diff(np.append(solid[start], solid[-1]))
        h = span_hash(data, start, stop)
        unique, index, back = np.unique(h, return_index=True, return_inverse=True)
        if self._n + len(unique) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self._hash, unique)
        known = np.zeros(len(unique), bool)
        inside = place < len(self._hash)
        known[inside] = self._hash[place[inside]] == unique[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            text = data.tobytes()
            self._learn(unique[new], [text[i:j].decode() for i, j in zip(start[index[new]].tolist(), stop[index[new]].tolist(), strict=True)])
            place = np.searchsorted(self._hash, unique)
        at = self._at[place][back]
        n = self._size[at]
        total = int(n.sum())
        first = np.cumsum(n) - n
        source = np.arange(total) - np.repeat(first - self._begin[at], n)
        ids = self._ids[source]
        length = self._bytes[ids]
        ends = np.cumsum(length)
        where = ends - length - np.repeat((ends - length)[first], n) + np.repeat(start, n)
        row = np.searchsorted(block.bounds, start, "right") - 1
        return ids, np.bincount(row, n, block.n).astype(np.int64), where

    def _general(self, text: str) -> np.ndarray:
        if _ODD_SPACE.search(text):
            return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        runs = text.split()
        if not runs:
            return np.zeros(0, np.uint32)
        if len(self._words) > REMEMBERED // 4:
            self._words.clear()
        new = list(set(runs) - self._words.keys())
        for x, e in zip(new, self._tokenizer.encode_batch_fast(new, add_special_tokens=False) if new else [], strict=True):
            self._words[x] = np.array(e.ids, np.uint32)
        out = np.concatenate([self._words[x] for x in runs])
        for x in new:
            if len(x) > 64:
                del self._words[x]
        return out

    def _sort(self, block: Block) -> np.ndarray:
        """Rows that the plain way encodes exactly."""
        data = block.data
        bad = _ODD[data]
        if len(data) > 1:
            lead = data[:-1] == 0xC3
            bad[1:] |= lead & ((data[1:] == 0x97) | (data[1:] == 0xB7))
            bad[1:] |= (data[:-1] == 60) & (data[1:] == 124)  # the special tokens' first two characters
        return np.diff(running(bad)[block.bounds]) == 0

    def ids(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string column, without any end token; null counts as empty."""
        out: list[np.ndarray] = []
        for block in blocks(column):
            ok = self._sort(block)
            ids, n, _ = self._plain(block, ok)
            cut = np.append(0, np.cumsum(n))
            for k in range(block.n):
                out.append(ids[cut[k] : cut[k + 1]] if ok[k] else self._general(block.data[block.bounds[k] : block.bounds[k + 1]].tobytes().decode()))
        return out

    def spans(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(first character, end) of every token of each text, in code points of the text as given.

        A token that holds part of a character's bytes covers that character.
        """
        out = []
        for block in blocks(column):
            ok = self._sort(block)
            ids, n, where = self._plain(block, ok)
            cut = np.append(0, np.cumsum(n))
            character = running((block.data & 0xC0) != 0x80)
            first, last = character[where + 1] - 1, character[where + self._bytes[ids]]
            base = character[block.bounds]
            for k in range(block.n):
                if ok[k]:
                    out.append((first[cut[k] : cut[k + 1]] - base[k], last[cut[k] : cut[k + 1]] - base[k]))
                else:
                    text = block.data[block.bounds[k] : block.bounds[k + 1]].tobytes().decode()
                    at = np.array(self._tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
                    out.append((at[:, 0], at[:, 1]))
        return out

