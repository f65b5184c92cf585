"""Tokenizer use inside tasks: pieces between which no token can lie are encoded once and remembered.

A piece is cut where white space begins after something else and, in texts whose other characters are all
letters, also where a run of letters ends. The vocabularies' pre-tokenizers never let a token cross such a
place, so a text's ids are its pieces' ids in order. Pieces that are not remembered are
encoded as one joined text, which costs a third of encoding them one by one, and cut apart by the bytes that
each token stands for. Texts in which that argument could fail (white space beyond ASCII, strings of special
tokens) go to the library whole.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from itertools import chain, filterfalse, repeat

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402
from tokenizers.pre_tokenizers import WhitespaceSplit  # noqa: E402

#: Pieces of one generation of what a worker remembers; two generations bound its memory.
REMEMBER = 200_000
#: Pieces whose ids a worker remembers; about 200 bytes each.
REMEMBERED_IDS = 600_000

# classes of bytes: white space, letters (with all bytes beyond ASCII), others
_SPACE, _LETTER, _OTHER = range(3)
_CLASSES = bytes(
    _SPACE if chr(b) in "\t\n\v\f\r " else _LETTER if b > 127 or chr(b).isalpha() else _OTHER for b in range(256)
)
# what is neither a letter beyond ASCII nor white space that only some libraries know
_PLAIN = bytes(sorted({*range(128)} - {*range(0x1C, 0x20)}))
_ODD_CODES = (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)
_ODD_SPACE = re.compile("[" + "".join(map(chr, _ODD_CODES)) + "]")


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the vocabulary file: the tokenizer's version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class _Remembered(dict):
    """What is known of pieces, in two generations: when the young one is full it becomes the old one, and
    pieces met again are young again."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece: bytes):
        value = self[piece] = self.old[piece]
        return value

    def learn(self, texts: list[list[bytes]]) -> None:
        """Encode the pieces of some texts that are not known yet, together."""
        if len(self) > REMEMBER:
            self.old = dict(self)
            self.clear()
        missing = list(filterfalse(self.old.__contains__, set(filterfalse(self.__contains__, chain.from_iterable(texts)))))
        if missing:
            self.update(zip(missing, self.encode(missing), strict=True))


class WordCounts:
    """Token counts of texts under a tokenizer that drops white space."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Remembered(self._count)

    def _count(self, words: list[bytes]) -> list[int]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [len(e.ids) for e in found]

    def __call__(self, texts: list[bytes]) -> list[int]:
        words = [t.split() for t in texts]
        self.known.learn(words)
        return [sum(map(self.known.__getitem__, w)) for w in words]


def _byte_lengths(tokenizer: Tokenizer) -> np.ndarray:
    """How many bytes of text each id of a byte-level vocabulary stands for: one a character of its name."""
    vocabulary = tokenizer.get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for name, i in vocabulary.items():
        out[i] = len(name)
    return out


def _joined(pieces: list[bytes]) -> list[str]:
    """Pieces as texts of moderate length: the library slows down on long ones."""
    return [b"".join(pieces[i : i + 256]).decode() for i in range(0, len(pieces), 256)]


def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``ids``, joined, and where each run ends."""
    ends = np.cumsum(sizes)
    return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)], ends


def _values(array: pa.Array) -> list[bytes]:
    """Values of a whole binary array without nulls; a tenth of the time of ``to_pylist``."""
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int32 if pa.types.is_binary(array.type) else np.int64, len(array) + 1).tolist()
    held = data.to_pybytes() if data else b""
    return [held[a:b] for a, b in zip(at, at[1:])]


def _pieces(texts: list[bytes], fine: list[bool]) -> tuple[pa.Array, np.ndarray]:
    """Pieces of joined texts, none of them across two texts, and how many pieces each text has.

    A piece starts where white space follows something else; in ``fine`` texts also where something that is
    neither letter nor white space follows a letter (a contraction's apostrophe keeps the letters after it).
    """
    data = b"".join(texts)
    classes = np.frombuffer(data.translate(_CLASSES), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    stops = np.cumsum(sizes)
    starts_here = np.zeros(len(data), bool)
    before, here = classes[:-1], classes[1:]
    np.logical_and(here == _OTHER, before == _LETTER, out=starts_here[1:])
    if not all(fine):
        starts_here &= np.repeat(np.array(fine, bool), sizes)
    starts_here[1:] |= (here == _SPACE) & (before != _SPACE)
    starts_here[(stops - sizes)[sizes > 0]] = True
    starts = np.flatnonzero(starts_here)
    counts = np.diff(np.searchsorted(starts, stops), prepend=0)
    offsets = np.append(starts, len(data))
    kind, width = (pa.binary(), np.int32) if len(data) < 1 << 31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(data)]), counts


class PieceIds:
    """Ids of texts, as packed little-endian unsigned 32-bit integers, under a byte-level tokenizer.

    The different pieces of a batch of texts are looked up once each; the ids of remembered pieces stand joined
    in one array. Beyond ``REMEMBERED_IDS`` pieces the half that was used last stays.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        # takes words of ASCII letters in the vocabulary's own characters, in which the space before a word is a letter:
        # what the byte-level rules make of them, without applying those rules
        self.words = Tokenizer.from_file(path)
        self.words.pre_tokenizer = WhitespaceSplit()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lengths = _byte_lengths(self.tokenizer)
        self.rows: dict[bytes, int] = {}
        self.size, self.start, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, "<u4")
        self.held = self.batch = 0

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4")

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different pieces, joined in some order, and where each piece's ids start and how many they are."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stops = np.cumsum(lengths)
        data = b"".join(pieces)
        space = np.frombuffer(data.translate(_CLASSES), np.uint8) == _SPACE
        # a piece without white space in front may only stand at the start of a text, else its first token changes;
        # white space alone only ends a text, within one it would join the next piece
        free = ~space[stops - lengths] | space[stops - 1]
        codes = np.frombuffer(data, np.uint8)
        no_letters = np.add.reduceat((codes | 32) - np.uint8(97) > 25, stops - lengths, dtype=np.int64)
        word = ~free & (codes[stops - lengths] == 32) & (no_letters == 1)
        order = np.concatenate([np.flatnonzero(x) for x in (free, word, ~free & ~word)])
        apart, words = int(free.sum()), int(word.sum())
        sorted_ = [pieces[i] for i in order.tolist()]
        alone = [self._whole(p) for p in sorted_[:apart]]
        found = self.words.encode_batch_fast([t.replace(" ", " \u0120") for t in _joined(sorted_[apart : apart + words])], add_special_tokens=False)
        found += self.tokenizer.encode_batch_fast(_joined(sorted_[apart + words :]), add_special_tokens=False)
        ids = np.array(list(chain.from_iterable(e.ids for e in found)), "<u4")
        ends = np.cumsum(self.lengths[ids])
        wanted = np.cumsum(lengths[order[apart:]])
        at = np.searchsorted(ends, wanted)
        if not np.array_equal(ends[np.minimum(at, len(ends) - 1)], wanted):
            raise ValueError("a token crosses the place between two pieces")
        sizes = np.zeros(len(pieces), np.int64)
        starts = np.zeros(len(pieces), np.int64)
        sizes[order] = [*map(len, alone), *np.diff(at, prepend=-1).tolist()]
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate([*alone, ids]), starts, sizes

    def _learn(self, pieces: list[bytes]) -> None:
        """Give pieces that are not known yet the next rows."""
        ids, starts, sizes = self._encode(pieces)
        known = len(self.rows)
        self.rows.update(zip(pieces, range(known, known + len(pieces)), strict=True))
        end, total = self.held + len(ids), len(self.rows)
        if total > len(self.size):
            more = np.zeros(2 * len(pieces) + known // 4, np.int64)
            self.start, self.size, self.used = (np.concatenate([a[:known], more]) for a in (self.start, self.size, self.used))
        self.start[known:total] = self.held + starts
        self.size[known:total] = sizes
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.held], np.zeros(self.held // 4 + 2 * len(ids), "<u4")])
        self.ids[self.held : end] = ids
        self.held = end

    def _forget(self) -> None:
        keep = np.sort(np.argsort(-self.used[: len(self.rows)], kind="stable")[: REMEMBERED_IDS // 2])
        sizes = self.size[keep]
        ids, ends = _gather(self.ids, self.start[keep], sizes)
        pieces = list(self.rows)
        self.rows = {pieces[i]: row for row, i in enumerate(keep.tolist())}
        self.ids, self.size, self.used = ids, sizes, self.used[keep]
        self.start, self.held = ends - sizes, len(ids)

    def _fine(self, text: bytes) -> bool | None:
        """Whether pieces of a text also end with runs of letters; None if it has to be encoded whole."""
        if any(s in text for s in self.special):
            return None
        others = text.translate(None, _PLAIN)
        if not others or others.decode().isalpha():
            return True
        return None if _ODD_SPACE.search(others.decode()) else False

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        kinds = [self._fine(t) for t in texts]
        pieces, counts = _pieces([b"" if k is None else t for k, t in zip(kinds, texts, strict=True)], [bool(k) for k in kinds])
        if len(self.rows) > REMEMBERED_IDS:
            self._forget()
        found = pieces.dictionary_encode()
        different = _values(found.dictionary)
        rows = np.fromiter(map(self.rows.get, different, repeat(-1)), np.int64, len(different))
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = np.arange(len(self.rows), len(self.rows) + len(new))
            self._learn([different[i] for i in new.tolist()])
        self.batch += 1
        self.used[rows] = self.batch
        # the ids of the different pieces first: what is gathered again for each piece is then small
        sizes = self.size[rows]
        ids, ends = _gather(self.ids, self.start[rows], sizes)
        places = found.indices.to_numpy()
        ids, ends = _gather(ids, (ends - sizes)[places], sizes[places])
        data = ids.tobytes()
        stops = np.concatenate([[0], ends])[np.cumsum(counts)] * 4
        out, at = [], 0
        for text, kind, stop in zip(texts, kinds, stops.tolist(), strict=True):
            out.append(self._whole(text).tobytes() if kind is None else data[at:stop])
            at = stop
        return out


@functools.cache
def word_counts(path: str) -> WordCounts:
    """One per process, so that tasks that follow one another share what is remembered."""
    return WordCounts(path)


@functools.cache
def piece_ids(path: str) -> PieceIds:
    """One per process."""
    return PieceIds(path)
