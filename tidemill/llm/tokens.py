"""Token ids of whole texts by the tokenizers library, with repeated pieces encoded once.

A run of documents is one byte array. It is cut only where the tokenizer itself
always cuts, so the ids equal those of one call over each whole text:

* both kinds: before an ASCII sign, the apostrophe aside, that follows a Latin
  letter (letters and other signs never share a token);
* word vocabularies (white space dropped before the merges): before each word;
* byte-level vocabularies: around runs of white space as the split pattern takes
  them, where a single space belongs to the word after it.

Arrow finds the distinct pieces, the tokenizer encodes those not met before (many
to a call, with a separator token between), and numpy lays the ids out.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import LOWER

MEMO = 250_000  # distinct pieces kept by a worker; the first ones met are the frequent ones
SLICE = 6 << 20
RUN = 400  # pieces of one call
_APART = re.compile(r"[\x00-\x1f]|  |[^\S ]")  # in a piece that is encoded by a call of its own: white space other than single spaces, and controls
_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[b for b in b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~']] = True
#: Bytes that white space beyond ASCII's begins with, and separators that some libraries count as such.
_UNUSUAL = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


class Encoder:
    """encode(bytes, offsets) -> ids of all documents, and each document's first id with the total at the end.

    Documents that hold a special token's string, or unusual white space in the
    byte-level kind, are encoded by a call of their own.
    """

    def __init__(self, path: str, kind: str):
        if kind not in ("word", "byte"):
            raise ValueError(f"unknown kind of vocabulary: {kind}")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.kind = Tokenizer.from_file(path), kind
        self._fast = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        self.odd = tuple(t.content.encode() for t in self.tok.get_added_tokens_decoder().values()) + (_UNUSUAL if kind == "byte" else ())
        self.sep = "\n" if kind == "byte" else " \x01 "
        self.sep_id = self._direct([self.sep])[0]
        if len(self.sep_id) != 1:
            raise ValueError("the separator is not a single token of this vocabulary")
        self.memo: dict[str, int] = {"": 0}
        self.parts: list[np.ndarray] = [np.empty(0, np.uint32)]
        self.lens = np.zeros(1, np.int64)
        self.offs = np.zeros(1, np.int64)
        self.flat = np.empty(0, np.uint32)

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self._fast(texts, add_special_tokens=False)]

    def _run(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of pieces by one call; by a call each where a separator fused with what is beside it."""
        ids = self._direct([self.sep.join(pieces) + self.sep])[0]
        stop = np.flatnonzero(ids == self.sep_id[0])
        if len(stop) == len(pieces):
            return np.delete(ids, stop), np.diff(np.append(-1, stop)) - 1
        each = self._direct(pieces)
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of pieces."""
        alone = [i for i, w in enumerate(new) if _APART.search(w)]
        if alone:
            other = set(alone)
            mine = self._direct([new[i] for i in alone])
            rest = [w for i, w in enumerate(new) if i not in other]
        else:
            mine, rest = [], new
        got = [self._run(rest[i : i + RUN]) for i in range(0, len(rest), RUN)]
        ids = np.concatenate([x for x, _ in got]) if got else np.empty(0, np.uint32)
        lens = np.concatenate([n for _, n in got]) if got else np.empty(0, np.int64)
        if not alone:
            return ids, lens
        all_lens = np.empty(len(new), np.int64)
        keep = np.ones(len(new), bool)
        keep[alone] = False
        all_lens[keep], all_lens[alone] = lens, [len(x) for x in mine]
        out = np.empty(int(all_lens.sum()), np.uint32)
        owner = np.repeat(keep, all_lens)
        out[owner] = ids
        out[~owner] = np.concatenate(mine)
        return out, all_lens

    def _cuts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(buf)
        ws = _WS[buf]
        edge = off[1:-1]
        cut = np.zeros(n, bool)
        cut[off[:-1][off[:-1] < n]] = True
        sign = _STOP[buf[1:]]
        cut[1:] |= sign & _LETTER[buf[:-1]]
        if n > 2:  # a letter of two bytes, U+00C0 to U+00FF without the two signs among them
            at = np.flatnonzero(sign[1:] & (buf[:-2] == 0xC3)) + 2
            cut[at[(buf[at - 1] != 0x97) & (buf[at - 1] != 0xB7)]] = True
        if self.kind == "word":
            cut[1:] |= ~ws[1:] & ws[:-1]
        else:
            cut[1:] |= ws[1:] & ~ws[:-1]
            last = ws[:-1] & ~ws[1:]
            if len(edge):
                last[edge[(edge > 0) & (edge < n)] - 1] = False
            cut[:-1] |= last
            cut[1:] |= last & (buf[:-1] != 0x20)
        return np.flatnonzero(cut)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = self._odd(buf, off)
        if not odd:
            return self._encode(buf, off)
        size = np.diff(off)
        plain = np.ones(len(size), bool)
        plain[odd] = False
        ids, first = self._encode(buf[np.repeat(plain, size)], np.append(0, np.cumsum(size[plain])))
        cut: list[np.ndarray] = [None] * len(size)
        for k, d in enumerate(np.flatnonzero(plain).tolist()):
            cut[d] = ids[first[k] : first[k + 1]]
        for d, x in zip(odd, self._direct([buf[off[d] : off[d + 1]].tobytes().decode() for d in odd])):
            cut[d] = x
        return np.concatenate(cut), np.append(0, np.cumsum([len(x) for x in cut]))

    def _encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "word":
            buf = LOWER[buf]
        at = self._cuts(buf, off)
        if not len(at):
            return np.empty(0, np.uint32), np.zeros(len(off), np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(buf)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))).dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        which = np.asarray(pieces.indices)
        known = np.fromiter(map(self.memo.get, names, [-1] * len(names)), np.int64, len(names))
        miss = np.flatnonzero(known < 0)
        lens, offs, flat = self.lens, self.offs, self.flat
        if len(miss):
            new = [names[i] for i in miss]
            ids, new_lens = self._learn(new)
            known[miss] = np.arange(len(lens), len(lens) + len(new))
            new_offs = len(flat) + np.cumsum(new_lens) - new_lens
            lens, offs, flat = np.append(lens, new_lens), np.append(offs, new_offs), np.append(flat, ids)
            if len(self.memo) < MEMO:
                self.memo.update(zip(new, known[miss].tolist()))
                self.lens, self.offs, self.flat = lens, offs, flat
        which = known[which]
        k = lens[which]
        end = np.cumsum(k)
        ids = flat[np.arange(int(end[-1])) + np.repeat(offs[which] - (end - k), k)]
        return ids, np.append(0, end)[np.searchsorted(at, off)]

    def _odd(self, raw: np.ndarray, off: np.ndarray) -> list[int]:
        data = raw.tobytes()
        found = [s for s in self.odd if s in data]
        if not found:
            return []
        return [d for d in range(len(off) - 1) if any(data.find(s, off[d], off[d + 1]) >= 0 for s in found)]


@lru_cache(maxsize=1)
def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder; what it has learnt lasts as long as the worker."""
    return Encoder(path, kind)
