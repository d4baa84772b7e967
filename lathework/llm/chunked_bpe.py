"""Exact ids of the tokenizers library for many texts, with each distinct chunk encoded once.

Both public tokenizers cut a text at white space before merging, so a text's ids
are those of its chunks in order. Chunks are found and hashed with numpy; the
library encodes each new distinct chunk and the ids are gathered from a store.
Texts where chunks might not be independent (special-token marks, white space
outside ASCII, final sigma) are encoded whole by the library.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .shared import LOWER, SPACE, row_blocks, running_hash, span_hash, spread

#: Distinct chunks kept at once by a Python worker; then the store starts anew.
STORE_CHUNKS = 2_000_000
_WHOLE = re.compile("<\\||[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\u03a3]")
_SIGNS = (b"<|", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\xce\xa3")


#: Bytes of text encoded together.
ENCODE_BYTES = 200_000
#: Chunks given to the library as one string, with a special token between them.
JOINED = 256
#: A letter before one of these marks always ends a chunk.
_MARK = np.zeros(256, bool)
_MARK[list(b".,!?;:|&$%#*")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _letter_before(data: np.ndarray) -> np.ndarray:
    """Whether the character before each byte is an ASCII letter or one of U+00C0-U+00FF that is a letter."""
    out = np.zeros(len(data), bool)
    out[1:] = _LETTER[data[:-1]]
    low = data[1:-1]
    out[2:] |= (data[:-2] == 0xC3) & (low != 0x97) & (low != 0xB7)
    return out


class ChunkedEncoder:
    """path: a tokenizers file. keep_space: a chunk takes the space before it along (byte-level
    vocabularies); otherwise white space is dropped and ASCII case too (vocabularies with word ends).
    mark: a special token of the vocabulary; it only stands between chunks given to the library together."""

    def __init__(self, path: str, keep_space: bool, mark: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads only hold more memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep_space, self.mark = keep_space, mark
        self.mark_id = self.tokenizer.token_to_id(mark)
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int32)
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        space = SPACE[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        before |= first[:n]
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        after |= first[1:]
        marks = _MARK[data] & _letter_before(data) & ~before
        if not self.keep_space:
            starts = np.flatnonzero(~space & before | marks)
            after[:-1] |= marks[1:]
            return starts, np.flatnonzero(~space & after) + 1
        alone = space & ~before & ~after
        cut = first.copy()
        cut[:n] |= marks | alone & ((data == 0x20) | (data == 0x0A))
        cut[1:] |= np.append(alone & (data == 0x0A), False)[:n]
        places = np.flatnonzero(cut)
        return places[:-1], places[1:]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) == 0:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def _add(self, keys: np.ndarray, texts: list[str]) -> None:
        joined = self.tokenizer.encode_batch_fast([self.mark.join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)], add_special_tokens=False)
        flat = np.concatenate([np.array([*x.ids, self.mark_id], np.int32) for x in joined])
        stops = np.flatnonzero(flat == self.mark_id)
        counts = np.diff(stops, prepend=-1) - 1
        flat = flat[flat != self.mark_id]
        where = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, where, len(self.ids) + np.cumsum(counts) - counts)
        self.count = np.insert(self.count, where, counts)
        self.keys = np.insert(self.keys, where, keys)
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, data: np.ndarray, offsets: np.ndarray, most: int = ENCODE_BYTES):
        """Yields (first row, end row, ids, ids' offsets by row) for runs of rows."""
        for low, high in row_blocks(offsets, most):
            yield low, high, *self._block(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, rows = data.tobytes(), len(offsets) - 1
        if any(s in raw for s in _SIGNS):
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            whole = np.array([bool(_WHOLE.search(x)) for x in texts])
            if whole.any():
                return self._both(raw, offsets, texts, whole)
        if not self.keep_space:
            data = LOWER[data]
            raw = data.tobytes()
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        starts, ends = self._chunks(data, offsets)
        keys = span_hash(running_hash(data), starts, ends)
        distinct, sample, back = np.unique(keys, return_index=True, return_inverse=True)
        at, known = self._find(distinct)
        if not known.all():
            if len(self.keys) + int((~known).sum()) > STORE_CHUNKS:
                self._empty()
                known[:] = False
            if len(distinct) > STORE_CHUNKS:  # one very long text
                texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                return self._flat(self._library(texts))
            new = np.flatnonzero(~known)
            self._add(distinct[new], [raw[a:b].decode() for a, b in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist(), strict=True)])
            at, _ = self._find(distinct)
        at = at[back]
        counts = self.count[at]
        owner, place = spread(counts)
        ids = self.ids[self.at[at][owner] + place]
        per_row = np.bincount(np.searchsorted(offsets, starts, "right") - 1, weights=counts, minlength=rows).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_row)])

    @staticmethod
    def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
        counts = np.array([len(x) for x in lists], np.int64)
        ids = np.concatenate([np.asarray(x, np.int32) for x in lists]) if len(lists) else np.zeros(0, np.int32)
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def _both(self, raw: bytes, offsets: np.ndarray, texts: list[str], whole: np.ndarray):
        out: list = [None] * len(texts)
        for i, ids in zip(np.flatnonzero(whole), self._library([texts[i] for i in np.flatnonzero(whole)]), strict=True):
            out[i] = ids
        rest = np.flatnonzero(~whole)
        if len(rest):
            parts = [raw[offsets[i] : offsets[i + 1]] for i in rest]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
            ids, at = self._block(np.frombuffer(b"".join(parts), np.uint8), ends)
            for k, i in enumerate(rest):
                out[i] = ids[at[k] : at[k + 1]]
        return self._flat(out)
