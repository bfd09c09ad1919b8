"""Token ids of whole texts, each distinct white-space piece encoded once per worker.

Both vocabularies split a text at white space, and between a letter and a punctuation mark, before they merge, so the
ids of a text are the ids of its pieces in order. The pieces of a slice of texts are found and made distinct by their hashes in numpy; distinct pieces are looked
up by their bytes, those not seen before go to the tokenizers library joined by spaces, many to a string, and the ids
are cut where a piece begins. Then the ids of all words are gathered at once. Texts whose white space is unusual go to
the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import sized_slices, text_buffers
from .words import mix, words

#: Pieces that a worker remembers; further and very long new pieces are encoded in each slice.
REMEMBERED = 1_000_000
#: Bytes of the longest piece that is remembered.
LONGEST = 256
#: Bytes of texts that are looked up together, and of a text after which it is cut at a space.
SLICE, LONG = 1 << 21, 1 << 22
#: Pieces in one string for the library.
JOINED = 200
#: Fixed value: how byte-level vocabularies write a space.
SPACE_MARK = "Ġ"
#: Marks that begin a piece behind a letter; those of contractions and special tokens are not among them.
MARKS = np.zeros(256, bool)
MARKS[list(b".,;:!?$#%&*()-")] = True
_LEAD = np.uint64(0xA24BAED4963EE407)


def segments(data: np.ndarray, offsets: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, goes_on): texts of more than `long` bytes are cut before single spaces between ASCII words, where no
    piece goes on; goes_on[i]: the segment from bounds[i] continues the text before it."""
    if len(offsets) < 2 or np.diff(offsets).max() <= long:
        return offsets, np.zeros(max(0, len(offsets) - 1), bool)
    bounds, goes_on = [], []
    for low, high in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        bounds.append(low), goes_on.append(False)
        while high - low > long:
            near = data[low : low + long]
            solid = (near > 0x20) & (near < 0x7F)
            cuts = np.flatnonzero((near[1:-1] == 0x20) & solid[:-2] & solid[2:])
            if not len(cuts):
                break
            low += int(cuts[-1]) + 1
            bounds.append(low), goes_on.append(True)
    return np.asarray([*bounds, int(offsets[-1])]), np.asarray(goes_on)


class Encoder:
    """all_ids(column): little-endian unsigned 32-bit ids of the tokenizers library, as bytes, for each text."""

    def __init__(self, path: str, keeps_space: bool, remembered: int = REMEMBERED, long: int = LONG):
        """keeps_space: a byte-level vocabulary, in which a space belongs to the word after it; else white space is dropped."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space, self.remembered, self.long = keeps_space, remembered, long
        self.known: dict[bytes, bytes] = {}  # no ids: white space at an end, so its texts go to the library whole
        if keeps_space:
            self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.begins[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(SPACE_MARK)]] = True

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return next(self.all_ids(pa.array([text], pa.string())))

    def all_ids(self, column: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a string column in order; null is empty."""
        data, offsets = text_buffers(column)
        bounds, goes_on = segments(data, offsets, self.long)
        last, held = np.append(~goes_on[1:], True), []
        for low, high in sized_slices(bounds, SLICE):
            for ids, ends in zip(self._slice(data, bounds[low : high + 1], goes_on[low:high]), last[low:high].tolist(), strict=True):
                if ends and not held:
                    yield ids
                else:
                    held.append(ids)
                    if ends:
                        yield b"".join(held)
                        held = []

    def _slice(self, data: np.ndarray, bounds: np.ndarray, goes_on: np.ndarray) -> Iterator[bytes]:
        hashes, first, begins, ends = words(data, bounds, spans=True, fold=False, marks=MARKS)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
        odd = np.zeros(len(bounds) - 1, bool)
        if self.keeps_space and len(begins):
            before = np.concatenate([bounds[:1], ends[:-1]])
            opens = first[:-1][np.diff(first) > 0]
            before[opens] = bounds[owner[opens]]
            gap, lead = begins - before, data[np.maximum(begins - 1, 0)]
            starts = np.zeros(len(begins), bool)
            starts[opens] = ~goes_on[owner[opens]]
            odd[owner[~np.where(starts, gap == 0, (gap == 0) | (gap == 1) & ((lead == 0x20) | (lead == 0x0A)))]] = True
            upto = bounds[:-1].copy()
            upto[owner[opens]] = ends[np.append(opens[1:], len(ends)) - 1]
            odd = odd | (upto != bounds[1:])
            begins = begins - (gap > 0)
            hashes = mix(hashes + lead * (gap > 0) * _LEAD)
        elif self.keeps_space:
            odd = np.diff(bounds) > 0
        _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        base, raw = int(bounds[0]), data[int(bounds[0]) : int(bounds[-1])].tobytes()
        pieces = [raw[a:b] for a, b in zip((begins[at] - base).tolist(), (ends[at] - base).tolist(), strict=True)]
        found = self._found(pieces)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        if self.keeps_space and not sizes.all():
            odd[owner[(sizes == 0)[inverse]]] = True
        table, counts = np.frombuffer(b"".join(found), "<u4"), sizes[inverse]
        upto = np.concatenate([[0], np.cumsum(counts)])
        shift = (np.cumsum(sizes) - sizes)[inverse] - upto[:-1]
        flat = table[np.arange(upto[-1]) + np.repeat(shift, counts)]
        for i, (low, high) in enumerate(zip(upto[first[:-1]].tolist(), upto[first[1:]].tolist(), strict=True)):
            yield self.whole(raw[int(bounds[i]) - base : int(bounds[i + 1]) - base].decode()) if odd[i] else flat[low:high].tobytes()

    def _found(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces; new ones are remembered while there is room."""
        found = list(map(self.known.get, pieces))
        missing = [i for i, f in enumerate(found) if f is None]
        learnt = self._learn([pieces[i] for i in missing])
        for i in missing:
            found[i] = learnt[pieces[i]]
        if len(self.known) < self.remembered:
            self.known.update((p, ids) for p, ids in learnt.items() if len(p) <= LONGEST)
        return found

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        texts = [p.decode() for p in new]
        if not self.keeps_space:
            return dict(zip(new, self._cut_by_offsets(texts), strict=True))
        # a piece has at most one space or line feed, before its word
        bare = [t[t[0] in " \n" :] for t in texts]
        odd = [w[0].isspace() or w[-1].isspace() for w in bare]
        out = {p: b"" for p, o in zip(new, odd, strict=True) if o}
        spaced = [(p, t) for p, t, o in zip(new, texts, odd, strict=True) if not o and t[0] == " "]
        others = [(p, t) for p, t, o in zip(new, texts, odd, strict=True) if not o and t[0] != " "]
        out.update(zip((p for p, _ in spaced), self._cut_by_marks([t for _, t in spaced]), strict=True))
        out.update(zip((p for p, _ in others), self._one_by_one([t for _, t in others]), strict=True))
        return out

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut_by_marks(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts of a space and a word: each begins with its only token that starts with a space."""
        groups = [texts[i : i + JOINED] for i in range(0, len(texts), JOINED)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(found.ids, "<u4")
            cuts = np.flatnonzero(self.begins[ids])
            yield from _cut(ids, cuts) if len(cuts) == len(group) else self._one_by_one(group)

    def _cut_by_offsets(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of words, which begin where the first token at or behind a word's first character does."""
        groups = [texts[i : i + JOINED] for i in range(0, len(texts), JOINED)]
        for group, found in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            lengths = np.fromiter(map(len, group), np.int64, len(group)) + 1
            begins = np.asarray(found.offsets, np.int64).reshape(-1, 2)[:, 0]
            yield from _cut(np.asarray(found.ids, "<u4"), np.searchsorted(begins, np.cumsum(lengths) - lengths))


def _cut(ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    flat, bounds = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
    return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, keeps_space: bool, remembered: int = REMEMBERED) -> Encoder:
    """This worker's encoder for a vocabulary file. It lives until another one, or release(), is asked for."""
    key = (path, keeps_space, remembered)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, keeps_space, remembered)
    return _encoders[key]


def release() -> None:
    """Give back the pieces that this worker remembers; called by operators that need the memory for other work."""
    _encoders.clear()
