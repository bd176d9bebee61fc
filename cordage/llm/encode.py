"""Byte-level BPE over whole texts, with one library call for each distinct piece.

The pre-tokenizer of such a vocabulary cuts a text into pieces, and merges never
cross a piece. Pieces repeat far more often than texts, so the pieces are found
for a whole chunk in numpy, and only those that a worker has not met yet go to
the tokenizers library. The ids are those of the library for the whole text. A
vocabulary whose file asks for another pre-tokenizer, or for a normalizer, is
left to the library altogether.
"""

from __future__ import annotations

import json
import os
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from .text import chunks, code_points, span_hashes

_LETTER, _DIGIT, _SPACE, _OTHER = 0, 1, 2, 3
_encoders: dict[str, Encoder] = {}


def _classes() -> np.ndarray:
    """Class of each code point, as the pre-tokenizer's pattern takes it."""
    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    for at in range(0x110000):
        first = unicodedata.category(chr(at))[0]
        if first == "L":
            out[at] = _LETTER
        elif first == "N":
            out[at] = _DIGIT
    for found in regex.finditer(r"\s", "".join(map(chr, range(0x3001)))):
        out[ord(found[0])] = _SPACE
    out[0x1C:0x20] = _OTHER  # separators that only Python counts as space
    return out


def piece_starts(points: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pieces begin.

    A piece is a run of letters, of digits or of other signs, each with one
    blank before it if there is one; a contraction; or white space, of which
    the last character before a sign stands apart from the rest.
    """
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = classes[points]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    first, last = first[:-1], first[1:]
    before, after = np.empty(n, np.uint8), np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    after[-1], after[:-1] = 255, kind[1:]
    before[first] = 255
    after[last] = 255
    space = kind == _SPACE
    blank_before = np.concatenate([[False], points[:-1] == 32]) & ~first
    # a blank opens the piece of the sign after it; other space ends at the sign
    starts = first | ((kind != before) & ~(blank_before & ~space))
    starts |= space & (before == _SPACE) & (after != _SPACE) & (after != 255)
    # contractions: only where a piece would begin with the apostrophe itself
    marks = np.flatnonzero((points == 39) & starts & ~blank_before & (after == _LETTER))
    for mark in marks.tolist():
        end = offsets[np.searchsorted(offsets, mark, "right")]
        tail = points[mark + 1 : min(mark + 3, end)].tolist()
        size = 2 if tail[:1] in ([115], [116], [109], [100]) else 3 if tail in ([114, 101], [118, 101], [108, 108]) else 0
        if size:
            starts[mark + 1] = False
            if mark + size < end:
                starts[mark + size] = True
    return np.flatnonzero(starts)


def cuts_by_bytes(path: str) -> bool:
    """Whether a tokenizer file cuts texts as ``piece_starts`` does: byte-level BPE with the usual pattern, on texts as they are."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    before, model = given.get("pre_tokenizer") or {}, given["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    marks = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    return bool(plain and given.get("normalizer") is None and given.get("truncation") is None and model.get("type", "BPE") == "BPE" and not any(model.get(m) for m in marks))


class Encoder:
    """Token ids of many texts. ``for_path`` keeps one of them per worker and vocabulary."""

    #: Pieces kept; beyond them the memory of pieces starts afresh.
    KEEP = 1 << 20
    #: Pieces that go to the library as one text.
    TOGETHER = 64

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
        self.library = Tokenizer.from_file(path)
        self.plain = cuts_by_bytes(path)
        if not self.plain:
            return
        self.classes = _classes()
        self.added = regex.compile("|".join(regex.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or r"(?!)")
        self.bytes = self.byte_sizes()
        self.clear()

    @staticmethod
    def for_path(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.int32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Keep the ids of ``pieces``, in the order of their ``keys``.

        A piece of a blank and signs stays a piece behind another one, so many
        of these are encoded as one text and cut by the bytes of their tokens.
        """
        loose = np.fromiter((p[0] == " " and len(p) > 1 and not p[1].isspace() for p in pieces), bool, len(pieces))
        order = np.concatenate([np.flatnonzero(loose), np.flatnonzero(~loose)])
        ordered, n = [pieces[i] for i in order.tolist()], int(loose.sum())
        flat, cuts = self._encoded(["".join(ordered[i : min(n, i + self.TOGETHER)]) for i in range(0, n, self.TOGETHER)] + ordered[n:], ordered)
        if cuts is None:  # tokens that do not spell their bytes
            flat, cuts = self._encoded(ordered, ordered, alone=True)
        at, size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        at[order], size[order] = len(self.pool) + cuts[:-1], np.diff(cuts)
        self.pool = np.concatenate([self.pool, flat])
        place = np.searchsorted(self.keys, keys)  # both are in order
        self.keys, self.at, self.size = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.size, place, size)
        self.length = np.insert(self.length, place, np.fromiter(map(len, pieces), np.int64, len(pieces)))

    def _encoded(self, texts: list[str], pieces: list[str], alone: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Ids of ``texts``, which ``pieces`` tile (or are, if ``alone``), and the offset of each piece; None if a token crosses pieces."""
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), np.int32)
        if alone:
            return flat, np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(self.bytes[flat])])
        wanted = np.concatenate([[0], np.cumsum([len(p.encode()) for p in pieces])])
        cuts = np.minimum(np.searchsorted(ends, wanted), len(flat))
        return flat, cuts if (ends[cuts] == wanted).all() else None

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offset of each text with the end."""
        if not self.plain:
            ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), np.int32), np.cumsum([0, *map(len, ids)])
        points, offsets = code_points(texts)
        starts = piece_starts(points, offsets, self.classes)
        ends = np.concatenate([starts[1:], [len(points)]]) if len(starts) else starts
        keys, where, back = np.unique(span_hashes(points, starts, ends), return_index=True, return_inverse=True)
        found = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool) if not len(self.keys) else self.keys[np.minimum(found, len(self.keys) - 1)] == keys
        if not known.all():
            if len(self.keys) + (~known).sum() > self.KEEP:
                self.clear()
                known[:] = False
            whole, new = "".join(texts), np.flatnonzero(~known)
            self._learn(keys[new], [whole[starts[i] : ends[i]] for i in where[new]])
            found = np.searchsorted(self.keys, keys)
        size, at = self.size[found][back], self.at[found][back]
        done = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=done[1:])
        ids = self.pool[np.repeat(at - done[:-1], size) + np.arange(done[-1])]
        cuts = done[np.searchsorted(starts, offsets)]
        other = np.flatnonzero((self.length[found] != (ends - starts)[where])[back])  # two pieces of one hash
        odd = sorted({*(i for i, t in enumerate(texts) if self.added.search(t)), *(np.searchsorted(offsets, starts[other], "right") - 1).tolist()})
        if odd:  # such a text, or one with an added token's own string, for which the library looks before it cuts pieces
            parts = [ids[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
            for i in odd:
                parts[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, dtype=np.int32)
            ids = np.concatenate(parts)
            cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, cuts

    def byte_sizes(self) -> np.ndarray:
        """Bytes that each id stands for. A byte-level vocabulary spells one sign a byte."""
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        out = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, at in vocabulary.items():
            out[at] = len(token.encode()) if token in added else len(token)
        return out


def encode_column(column: pa.Array, path: str, end_id: int | None = None):
    """For each chunk of a column: the first row, the ids, and their offsets; ``end_id`` ends each text."""
    encoder = Encoder.for_path(path)
    for at, texts in chunks(column):
        ids, cuts = encoder(texts)
        if end_id is not None:
            ids = np.insert(ids, cuts[1:], end_id)
            cuts = cuts + np.arange(len(cuts))
        yield at, ids, cuts
