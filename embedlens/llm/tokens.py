"""Exact encoding with the tokenizers library, each distinct unit of text encoded once in a worker.

Both vocabularies cut texts at places that don't depend on what stands further away: at white space, and between a letter or digit and
a mark after it. Texts are cut there in numpy, units are found by 64-bit hash, their prefixes and bytes are compared, new ones are
encoded together by the library, and ids are gathered with numpy. Byte-level units of letters alone are single words to the library's
model, so they go to it with no search for words. Texts in which such places are in doubt (byte-level BPE keeps white
space, so runs of it, rare kinds of it, and special tokens) or a unit has another's hash go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np

from embedlens.llm import textnp
from embedlens.llm.shared import remembered

#: Units that a worker remembers (about 90 bytes each, more where arrays have room to grow, and 8 MB that find them); at this count it keeps the half that was used most. Only speed depends on it.
MEMORY = 600_000
U = np.uint64
#: Bits of a hash that find a unit at once; units that share them with an earlier one are searched for.
FRONT = 21
_LETTER = textnp._ALNUM.copy()
_LETTER[48:58] = False
#: The letters by which byte-level vocabularies write bytes: themselves where they can be shown, else code points from 256 on. The line end
#: stays, it parts units.
_SHOWN = np.arange(256, dtype="<u4")
_HIDDEN = [*range(33), *range(127, 161), 173]
_SHOWN[_HIDDEN] = 256 + np.arange(len(_HIDDEN))
_SHOWN[10] = 10
_RARE = np.zeros(256, dtype=bool)
_RARE[[0, 9, 11, 12, 13, *range(0x1C, 0x20)]] = True
#: UTF-8 of white space beyond ASCII: fixed values.
_WIDE = [c.encode() for c in "\x85\xa0                　"]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with room for ``n`` at least; it grows by doubling."""
    return a if len(a) >= n else np.append(a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype))


def _place(keys: np.ndarray) -> np.ndarray:
    return (keys >> U(64 - FRONT)).astype(np.int64)


def _letters(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which of the units that begin at ``start`` and fill ``data`` have letters of ASCII and Latin-1 alone."""
    good, two = _LETTER[data], np.flatnonzero(data == 0xC3)
    two = two[(data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]  # the signs of times and division
    good[two] = good[two + 1] = True
    return np.logical_and.reduceat(good, start) if len(start) else np.zeros(0, bool)


def _find(data: np.ndarray, pattern: bytes) -> np.ndarray:
    """Where ``pattern`` begins; quick where its first byte is rare."""
    at = np.flatnonzero(data == pattern[0])
    for i, b in enumerate(pattern[1:], 1):
        at = at[at + i < len(data)]
        at = at[data[at + i] == b]
    return at


class UnitEncoder:
    """``kind`` "byte": byte-level BPE that keeps white space; "word": BPE that drops white space and case."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library, self.kind = Tokenizer.from_file(path), kind
        self.mark, self.sep = ("\n", "\n") if kind == "byte" else ("\x00", " \x00 ")
        (self.mark_id,) = self._whole(self.mark)
        if kind == "byte":
            from tokenizers import pre_tokenizers

            self.plain = Tokenizer(self.library.model)  # the same model over units that are parted already
            self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
            names = self.plain.get_vocab()
            self.bytes_of = np.zeros(max(names.values()) + 1, np.int64)
            self.bytes_of[list(names.values())] = list(map(len, names))
        self._reset()

    def _reset(self) -> None:
        self.keys, self.slots = np.zeros(0, U), np.zeros(0, np.int64)
        self.starts, self.sizes, self.flat, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0
        #: the units' bytes as they stand in texts, and their prefixes
        self.texts, self.text_starts, self.text_sizes, self.prefixes, self.text_used = np.zeros(1 << 16, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8), 0
        self.uses, self.hashes, self.front = np.zeros(0, np.int64), np.zeros(0, U), np.full(1 << FRONT, -1, np.int32)

    def _forget(self) -> None:
        """Keeps the half of the units that was used most."""

        def spans(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
            return flat[np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)]

        kept = np.zeros(len(self.uses), bool)
        kept[np.argsort(-self.uses, kind="stable")[: MEMORY // 2]] = True
        mine, place = kept[self.slots], np.cumsum(kept) - 1
        self.keys, self.slots = self.keys[mine], place[self.slots[mine]]
        mine = np.flatnonzero(kept)
        self.flat, self.texts = spans(self.flat, self.starts[mine], self.sizes[mine]), spans(self.texts, self.text_starts[mine], self.text_sizes[mine])
        self.sizes, self.text_sizes, self.prefixes, self.uses, self.hashes = self.sizes[mine], self.text_sizes[mine], self.prefixes[mine], self.uses[mine] // 2, self.hashes[mine]
        self.starts, self.text_starts = np.cumsum(self.sizes) - self.sizes, np.cumsum(self.text_sizes) - self.text_sizes
        self.used, self.text_used = len(self.flat), len(self.texts)
        self.front[:] = -1
        order = np.argsort(self.uses, kind="stable")  # of units with one place the one used most is written last
        self.front[_place(self.hashes[order])] = order
        # room to grow by doubling
        self.flat, self.texts = np.append(self.flat, np.zeros(1 << 16, np.uint32)), np.append(self.texts, np.zeros(1 << 16, np.uint8))

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that go to the library whole."""
        at = [_find(data, b"<|")]
        if self.kind == "byte":
            space = textnp._SPACE[data]
            ends = offsets[1:][np.diff(offsets) > 0] - 1
            begins = offsets[:-1][np.diff(offsets) > 0]
            at += [np.flatnonzero(_RARE[data]), np.flatnonzero(space[1:] & space[:-1]), ends[space[ends]], begins[space[begins]]]
            for first in (0xC2, 0xE1, 0xE2, 0xE3):
                if (data == first).any():
                    at += [_find(data, w) for w in _WIDE if w[0] == first]
        else:
            at.append(np.flatnonzero(data == 0))
        odd = np.zeros(len(offsets) - 1, bool)
        odd[np.searchsorted(offsets, np.concatenate(at), "right") - 1] = True
        return odd

    def _encode_new(self, new: list[str]) -> list[np.ndarray]:
        """Many units in one string, with a separator whose id occurs in no unit."""
        parts = [new[a : a + 64] for a in range(0, len(new), 64)]  # in longer ones a unit takes the library more time
        out = []
        for part, found in zip(parts, self.library.encode_batch_fast([self.sep.join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            cut = [-1, *np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            assert len(cut) == len(part) + 1
            out += [ids[x + 1 : y] for x, y in zip(cut, cut[1:])]
        return out

    def _encode_plain(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units of letters, and the count of each. They tell where a unit ends by their bytes."""
        joined = np.frombuffer(b"\n".join(new), np.uint8)
        shown = _SHOWN[joined].tobytes().decode("utf-32-le")
        cuts = [-1, *np.flatnonzero(joined == 10)[63::64].tolist(), len(shown)]
        found = self.plain.encode_batch_fast([shown[a + 1 : b] for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)
        flat = np.concatenate([np.array(x.ids, np.uint32) for x in found])
        ends, want = np.cumsum(self.bytes_of[flat]), np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        last = np.searchsorted(ends, want)
        assert last[-1] == len(flat) - 1 and (ends[last] == want).all()
        return flat, np.diff(last, prepend=-1)

    def _learn(self, keys: np.ndarray, raw: list[bytes], prefix: np.ndarray) -> None:
        each = np.fromiter(map(len, raw), np.int64, len(raw))
        plain = np.zeros(len(raw), bool)
        if self.kind == "byte":
            plain = _letters(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(each) - each)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        keys, raw, prefix, each, n = keys[order], [raw[i] for i in order.tolist()], prefix[order], each[order], int(plain.sum())
        flat, sizes = self._encode_plain([b" " + x if p == 1 else x for x, p in zip(raw[:n], prefix[:n].tolist())]) if n else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if n < len(raw):
            ids = self._encode_new([(" " if p == 1 else "") + x.decode() for x, p in zip(raw[n:], prefix[n:].tolist())])
            flat, sizes = np.concatenate([flat, *ids]).astype(np.uint32), np.append(sizes, np.fromiter(map(len, ids), np.int64, len(ids)))
        newline = prefix == 2
        flat, sizes = np.insert(flat, (np.cumsum(sizes) - sizes)[newline], self.mark_id), sizes + newline
        whole = np.frombuffer(b"".join(raw), np.uint8)
        at, end = len(self.uses), len(self.uses) + len(raw)
        self.flat, self.texts = _room(self.flat, self.used + len(flat)), _room(self.texts, self.text_used + len(whole))
        self.texts[self.text_used : self.text_used + len(whole)], self.flat[self.used : self.used + len(flat)] = whole, flat
        self.starts, self.sizes, self.text_starts = _room(self.starts, end), _room(self.sizes, end), _room(self.text_starts, end)
        self.text_sizes, self.prefixes, self.hashes = _room(self.text_sizes, end), _room(self.prefixes, end), _room(self.hashes, end)
        self.starts[at:end], self.sizes[at:end], self.text_starts[at:end] = self.used + np.cumsum(sizes) - sizes, sizes, self.text_used + np.cumsum(each) - each
        self.text_sizes[at:end], self.prefixes[at:end], self.hashes[at:end] = each, prefix, keys
        self.used, self.text_used, self.uses = self.used + len(flat), self.text_used + len(whole), np.append(self.uses, np.zeros(len(raw), np.int64))
        place = _place(keys)
        free = self.front[place] < 0
        self.front[place[free]] = np.arange(at, end)[free]
        sort = np.argsort(keys)
        here = np.searchsorted(self.keys, keys[sort])
        self.keys, self.slots = np.insert(self.keys, here, keys[sort]), np.insert(self.slots, here, (at + np.arange(len(raw)))[sort])

    def _slots(self, data: np.ndarray, offsets: np.ndarray, w: textnp.Words, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where this encoder has each unit of the texts that aren't odd; and the texts with a unit that isn't what its hash says."""
        h, start, end = w.hash, w.start, w.end
        prefix, low = np.zeros(len(h), np.int8), textnp._LOWER[data] if self.kind == "word" else data
        if self.kind == "byte" and len(h):
            before = data[np.maximum(start, 1) - 1]
            first, begin = w.first[:-1], offsets[:-1]
            first, begin = first[first < len(h)], begin[first < len(h)]
            before[first[start[first] == begin]] = 0  # a text's first byte has none before it
            prefix = (before == 32).view(np.int8) + 2 * (before == 10).view(np.int8)
            h = textnp.mix(h + prefix.astype(U) * U(0xC2B2AE3D27D4EB4F))
        if odd.any():
            usable = ~np.repeat(odd, np.diff(w.first))
            h, start, end, prefix = h[usable], start[usable], end[usable], prefix[usable]
        slots = self.front[_place(h)].astype(np.int64)
        hit = slots >= 0
        hit[hit] = self.hashes[slots[hit]] == h[hit]
        rest = np.flatnonzero(~hit)
        if len(rest):
            keys, one, inverse = np.unique(h[rest], return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
            if not known.all():
                new = rest[one[~known]]
                self._learn(keys[~known], [low[x:y].tobytes() for x, y in zip(start[new].tolist(), end[new].tolist())], prefix[new])
                at = np.searchsorted(self.keys, keys)
            slots[rest] = self.slots[at][inverse]
        # every unit against what is remembered
        size = end - start
        off = (size != self.text_sizes[slots]) | (prefix != self.prefixes[slots])
        same = np.flatnonzero(~off)
        off[same] = ~textnp.equal_spans(low, start[same], self.texts, self.text_starts[slots[same]], size[same])
        clash = np.zeros(len(odd), bool)
        if off.any():
            clash[w.doc()[~np.repeat(odd, np.diff(w.first))][off]] = True
        return slots, clash

    def encode(self, data: np.ndarray, offsets: np.ndarray, tail: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by ``tail``, and the count of each with its tail."""
        n = len(offsets) - 1
        if len(self.keys) > MEMORY:
            self._forget()
        odd = self._odd(data, offsets)
        w = textnp.words(data, offsets, lower=self.kind == "word", cut_marks=True, quick=True)
        slots, clash = self._slots(data, offsets, w, odd)
        if clash.any():  # a unit with another's hash
            odd |= clash
            slots = slots[~np.repeat(clash, np.where(odd & ~clash, 0, np.diff(w.first)))]
        counts = np.diff(w.first)
        counts[odd] = 0
        self.uses += np.bincount(slots, minlength=len(self.uses))
        sizes = self.sizes[slots]
        total = np.concatenate([[0], np.cumsum(sizes)])
        doc_at = np.concatenate([[0], np.cumsum(counts)])
        lengths = total[doc_at[1:]] - total[doc_at[:-1]]
        whole = {}
        for d in np.flatnonzero(odd):
            whole[d] = np.array(self._whole(data[offsets[d] : offsets[d + 1]].tobytes().decode()), np.uint32)
            lengths[d] = len(whole[d])
        ends = np.cumsum(lengths + 1)
        out = np.full(int(ends[-1]) if n else 0, tail, np.uint32)
        doc_first = ends - lengths - 1
        mine = np.ones(len(out), bool)  # what units give, in order
        mine[ends - 1] = False
        for d, ids in whole.items():
            out[doc_first[d] : doc_first[d] + len(ids)] = ids
            mine[doc_first[d] : doc_first[d] + len(ids)] = False
        out[mine] = self.flat[np.arange(total[-1]) + np.repeat(self.starts[slots] - total[:-1], sizes)]
        return out, lengths + 1


def encoder(path: str, kind: str) -> UnitEncoder:
    """One for each worker process."""
    encoders = remembered("units")
    if (path, kind) not in encoders:
        encoders[path, kind] = UnitEncoder(path, kind)
    return encoders[path, kind]
