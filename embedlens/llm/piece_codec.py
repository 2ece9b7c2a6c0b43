"""SentencePiece BPE by a merge-type prefix table, and back.

For every prefix of a text, BPE's encoding of that prefix ends in one token that is fixed by the prefix alone. The table holds this
last token for each prefix: of the pieces that end there (found by one pass of an Aho-Corasick automaton) it is the one that may
follow the last token of the prefix before it, which a remembered pair-compatibility test decides. Ids are then read backwards. The
work is linear in the text, with no queue of merges.

Texts are cut where no piece has the two characters side by side (before spaces, around newlines, ...): no merge can reach across
such a place. A worker remembers the units between cuts by 64-bit hash and compares their bytes, so a frequent word is encoded once.

Defined cases: null or empty text has no ids and decodes to the empty text. U+2581 in a text counts as a space, as in the library.
Characters without a piece become byte pieces. Every input row gives one row, also where doc_ids repeat or are null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.llm import textnp
from embedlens.llm.shared import over_texts, remembered, tidy

SPACE = "▁"
#: Units that a worker remembers; at this count it starts anew. Only speed depends on it.
MEMORY = 600_000
U = np.uint64


class PieceCodec:
    """Encoder and decoder for a BPE model with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)  # gives the pieces and scores; encodes nothing here
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: list[bytes] = []
        byte_id = {}
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_id[int(piece[1:-1], 16)] = i
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                self.bytes.append(piece.replace(SPACE, " ").encode())
        self.byte_id = [byte_id[b] for b in range(256)]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) == 1 or self.merge(piece) == [piece]:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.together = self._together()
        self._reset()

    def _together(self) -> np.ndarray:
        """Whether two bytes may stand side by side inside a piece; true for all that is not ASCII, but for spaces and newlines."""
        t = np.zeros((256, 256), bool)
        t[128:], t[:, 128:] = True, True
        inner_space = newline = False
        for piece in self.ids:
            text = piece.replace(SPACE, " ")
            newline |= "\n" in text
            for a, b in zip(text, text[1:]):
                inner_space |= b == " " and a != " "
                if a < "\x80" and b < "\x80":
                    t[ord(a), ord(b)] = True
        if not inner_space:
            t[128:, 32] = False
        if not newline:
            t[:, 10], t[10] = False, False
        return t

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: again and again the best-scored, then leftmost, pair. For single pieces and pairs of them only."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def encode_unit(self, unit: str) -> list[int]:
        """``unit`` has U+2581 for spaces."""
        n = len(unit)
        last: list[str] = [""] * (n + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, piece in self.automaton.iter(unit):
            end += 1
            if last[end]:
                continue
            start = end - len(piece)
            if start:
                before = last[start]
                if not before:  # a character without a piece
                    before = last[start] = unit[start - 1]
                known = pairs.get((before, piece))
                if not (compatible(before, piece) if known is None else known):
                    continue
            last[end] = piece
        out, at = [], n
        while at:
            token = last[at] or unit[at - 1]
            found = self.ids.get(token)
            if found is None:
                out.extend(self.byte_id[b] for b in reversed(token.encode()))
            else:
                out.append(found)
            at -= len(token)
        return out[::-1]

    def decode_unit(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])

    def _reset(self) -> None:
        self.keys, self.slots, self.texts, self.decoded, self.raw, self.sizes = np.zeros(0, U), np.zeros(0, np.int64), [], [], [], np.zeros(0, np.int64)

    def _add(self, unit: bytes) -> int:
        """Encodes a unit and remembers it; its place."""
        ids = self.encode_unit(unit.decode().replace(" ", SPACE))
        self.texts.append((",".join(map(str, ids)) + ",").encode())
        self.decoded.append(self.decode_unit(ids))
        self.raw.append(unit)
        self._new.append(len(ids))
        return len(self.raw) - 1

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each unit, and the first unit of each text."""
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = ~self.together[data[:-1], data[1:]]
        cut[offsets] = True
        at = np.flatnonzero(cut) if len(data) else np.zeros(1, np.int64)
        return at[:-1], at[1:], np.searchsorted(at, offsets)

    def digests(self, texts: list[str | None]) -> tuple[list[int], list[str], list[str]]:
        """Of each text: the count of its ids, sha256 of the ids joined by commas, sha256 of the decoded text."""
        if len(self.texts) > MEMORY:
            self._reset()
        raw = [(" " + t.replace(SPACE, " ") if t else "").encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        start, end, first = self.units(data, offsets)
        keys, one, inverse = np.unique(textnp.span_hash(data, start, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        self._new: list[int] = []
        if not known.all():
            slots = np.array([self._add(joined[a:b]) for a, b in zip(start[one[~known]].tolist(), end[one[~known]].tolist())], np.int64)
            place = np.searchsorted(self.keys, keys[~known])
            self.keys, self.slots = np.insert(self.keys, place, keys[~known]), np.insert(self.slots, place, slots)
            at = np.searchsorted(self.keys, keys)
        slots = (self.slots[at] if len(self.keys) else at)[inverse]
        # every unit against the first of its hash here, and that one against what is remembered; a unit with another's hash is added apart
        size, alike = end - start, one[inverse]
        wrong = size != size[alike]
        wrong[~wrong] = ~textnp.equal_spans(data, start[~wrong], data, start[alike[~wrong]], size[~wrong])
        off = np.array([joined[a:b] != self.raw[i] for a, b, i in zip(start[one].tolist(), end[one].tolist(), slots[one].tolist())], bool)
        for i in np.flatnonzero(wrong | off[inverse]).tolist() if len(slots) else ():
            slots[i] = self._add(joined[start[i] : end[i]])
        self.sizes = np.concatenate([self.sizes, np.array(self._new, np.int64)])
        total = np.concatenate([[0], np.cumsum(self.sizes[slots])])
        counts, ids_sha, text_sha = [], [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            which = slots[a:b].tolist()
            counts.append(int(total[b] - total[a]))
            ids_sha.append(hashlib.sha256(b"".join([self.texts[i] for i in which])[:-1]).hexdigest())
            text_sha.append(hashlib.sha256(b"".join([self.decoded[i] for i in which])[1:]).hexdigest())
        return counts, ids_sha, text_sha

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        raw = (" " + text.replace(SPACE, " ")).encode()
        start, end, _ = self.units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return [i for a, b in zip(start.tolist(), end.tolist()) for i in self.encode_unit(raw[a:b].decode().replace(" ", SPACE))]

    def decode(self, ids: list[int]) -> str:
        text = self.decode_unit(ids)
        return (text[1:] if text.startswith(b" ") else text).decode(errors="replace")


def codec(model_file: str) -> PieceCodec:
    """One for each worker process."""
    codecs = remembered("pieces")
    if model_file not in codecs:
        codecs[model_file] = PieceCodec(model_file)
    return codecs[model_file]


def encode(documents: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids array<int>)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model_file)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(over_texts(run, owner="pieces"), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, text) of ``encoded(doc_id, ids)``."""

    def run(batches):
        c = codec(model_file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(tidy(run, "pieces"), "doc_id long, text string")


def round_trip(documents: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, text = codec(model_file).digests(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(over_texts(run, owner="pieces"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
