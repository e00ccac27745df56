"""Fast exact encoding with a public tokenizer: distinct units of text are encoded once and then looked up.

A unit is a piece of text whose ids don't depend on what stands around it. For a byte-level vocabulary, cuts go before a
single space, and around a single line end, between two characters that aren't white space; for one that drops white
space, words between ASCII white space are units.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
from . import rolling

#: Distinct units that a worker remembers; then it starts anew.
REMEMBERED = 1_500_000
_encoders: dict[tuple[str, bool], UnitEncoder] = {}


def byte_level_cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units start, over all texts back to back, for a byte-level vocabulary with the usual pattern."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    unsafe = raw <= 0x20
    # Lead bytes of characters among which Unicode has white space; being careful only makes units longer.
    for lead in (0xE1, 0xE2, 0xE3):
        at = np.flatnonzero(raw == lead)
        for j in range(3):
            unsafe[np.minimum(at + j, n - 1)] = True
    at = np.flatnonzero(raw[:-1] == 0xC2)
    at = at[(raw[at + 1] == 0x85) | (raw[at + 1] == 0xA0)]
    unsafe[at] = unsafe[at + 1] = True
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    mid = np.zeros(n, bool)
    mid[1:-1] = ~unsafe[:-2] & ~unsafe[2:]
    mid &= ~edge[:-1] & ~edge[1:]  # neither the first nor the last byte of a text
    cut = edge.copy()
    space, line = np.flatnonzero(mid & (raw == 0x20)), np.flatnonzero(mid & (raw == 0x0A))
    cut[space] = cut[line] = cut[line + 1] = True
    return np.flatnonzero(cut[:-1])


class UnitEncoder:
    """Encodes batches of texts; ``drops_space`` says that the vocabulary ignores white space."""

    def __init__(self, path: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # The strings of the vocabulary's own tokens, such as an end mark: they cut a text wherever they stand in it.
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.drops_space = drops_space
        # A separator that is one token by itself and never merges with what stands beside it.
        self.sep, self.mark = (" \x01 ", b"\x01") if drops_space else ("\n", b"\n")
        got = self.tok.encode(f"a{self.sep}b", add_special_tokens=False).ids
        self.sep_id = got[len(self.tok.encode("a", add_special_tokens=False).ids)]
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _lookup_new(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units back to back, and how many each has."""
        plain = [i for i, u in enumerate(units) if self.mark not in u]
        sizes, parts, order = [], [], []
        groups = [plain[i : i + 2000] for i in range(0, len(plain), 2000)]
        texts = [self.sep.join([units[i].decode() for i in g]) for g in groups]
        for g, e in zip(groups, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=np.uint32)
            stops = np.flatnonzero(ids == self.sep_id)
            assert len(stops) == len(g) - 1
            sizes.append(np.diff(np.concatenate([[-1], stops, [len(ids)]])) - 1)
            parts.append(np.delete(ids, stops))
            order += g
        odd = [i for i, u in enumerate(units) if self.mark in u]
        for i, e in zip(odd, self.tok.encode_batch_fast([units[i].decode() for i in odd], add_special_tokens=False), strict=True):
            sizes.append(np.array([len(e.ids)]))
            parts.append(np.array(e.ids, dtype=np.uint32))
            order.append(i)
        size, flat = np.concatenate(sizes).astype(np.int64), np.concatenate(parts)
        start = np.cumsum(size) - size
        rank = np.empty(len(units), np.int64)
        rank[np.array(order)] = np.arange(len(order))
        return _gather(flat, start[rank], size[rank]), size[rank]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts back to back, and offsets by text. Texts with special strings are encoded as they are."""
        whole = self._with_special(raw, offsets)
        if not whole:
            return self._encode(raw, offsets)
        size = np.diff(offsets)
        size[whole] = 0
        rest = np.concatenate([raw[a:b] for a, b in zip([0, *offsets[1:][whole]], [*offsets[:-1][whole], len(raw)], strict=True)])
        ids, o = self._encode(rest, np.concatenate([[0], np.cumsum(size)]))
        parts, n, at = [], np.diff(o), 0
        for i, e in zip(whole, self.tok.encode_batch_fast([raw[offsets[i] : offsets[i + 1]].tobytes().decode() for i in whole], add_special_tokens=False), strict=True):
            parts += [ids[at : o[i]], np.array(e.ids, np.uint32)]
            n[i], at = len(e.ids), o[i]
        return np.concatenate([*parts, ids[at:]]), np.concatenate([[0], np.cumsum(n)])

    def _with_special(self, raw: np.ndarray, offsets: np.ndarray) -> list[int]:
        """The texts in which a special string stands."""
        data, found = raw.tobytes(), set()
        for s in self.special:
            at = data.find(s)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, side="right")) - 1
                inside = at + len(s) <= offsets[i + 1]
                found |= {i} if inside else set()
                at = data.find(s, int(offsets[i + 1]) if inside else at + 1)
        return sorted(found)

    def _encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.drops_space:
            starts, ends, by = rolling.words(raw, offsets)
        else:
            starts = byte_level_cuts(raw, offsets)
            ends = np.append(starts[1:], len(raw)) if len(starts) else starts
            by = np.searchsorted(starts, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        h, first, inv = np.unique(rolling.word_hashes(raw, starts, ends, False), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, h)
        new = np.ones(len(h), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != h
        if new.any():
            if len(self.known) + int(new.sum()) > REMEMBERED:
                self.forget()
                at, new = np.zeros(len(h), np.int64), np.ones(len(h), bool)
            data = raw.tobytes()
            f = first[new]
            ids, size = self._lookup_new([data[a:b] for a, b in zip(starts[f].tolist(), ends[f].tolist(), strict=True)])
            self.at = np.insert(self.at, at[new], len(self.ids) + np.cumsum(size) - size)
            self.size = np.insert(self.size, at[new], size)
            self.known = np.insert(self.known, at[new], h[new])
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.known, h)
        size = self.size[at][inv]
        total = np.concatenate([[0], np.cumsum(size)])
        return _gather(self.ids, self.at[at][inv], size), total[by]


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    end = np.cumsum(size)
    return flat[np.repeat(start - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]


def encoder(path: str, drops_space: bool) -> UnitEncoder:
    """The worker's own encoder for this vocabulary."""
    key = (path, drops_space)
    if key not in _encoders:
        _encoders[key] = UnitEncoder(path, drops_space)
    return _encoders[key]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``end`` after each text, and the offsets then."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    place = np.ones(len(out), bool)
    stops = offsets[1:] + np.arange(n)
    place[stops] = False
    out[place] = ids
    return out, np.concatenate([[0], stops + 1])


def encoded(column_raw: np.ndarray, offsets: np.ndarray, path: str, drops_space: bool, end: int, slice_: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, ids with end ids, offsets) for each range of rows."""
    enc = encoder(path, drops_space)
    for a, b in slice_:
        ids, o = enc.encode(column_raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, *with_end(ids, o, end)
