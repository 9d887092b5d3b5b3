"""Token ids of whole texts under byte-pair files of the tokenizers library.

Batches of texts are cut into pre-tokens with array operations on their bytes,
each distinct pre-token of a batch is looked up once, and the library's model
encodes those a worker doesn't remember.  Texts in which array operations can't
tell the cuts (special tokens, characters that change under normalisation, code points
that Python's Unicode tables don't know) go to the library whole.  The ids are those of ``Tokenizer.encode``.
"""

from __future__ import annotations

import os
import unicodedata
from unicodedata import is_normalized

import numpy as np

from .common import tidy_worker, worker_memory

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = 0, 1, 2, 3, 4
# White space of Unicode; endings that are pre-tokens of their own after an apostrophe.
WHITE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT_ENDINGS = b"stmd"
LONG_ENDINGS = (b"re", b"ve", b"ll")

_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """Class of every code point; made once per worker.

    Code points that this Python's Unicode tables don't know may be letters in the library's.
    """
    if not _classes:
        kinds = np.frombuffer("".join(map(unicodedata.category, map(chr, range(0x110000)))).encode(), np.uint8).reshape(-1, 2)
        table = np.where(kinds[:, 0] == ord("L"), LETTER, np.where(kinds[:, 0] == ord("N"), NUMBER, OTHER)).astype(np.uint8)
        table[(kinds == (ord("C"), ord("n"))).all(1)] = UNKNOWN
        table[WHITE] = SPACE
        _classes.append(table)
    return _classes[0]


def _byte_letters() -> dict[int, int]:
    """The printable character that byte-level models write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def byte_classes(buffer: np.ndarray) -> np.ndarray:
    """Class of the character that each byte of valid UTF-8 belongs to."""
    table = _class_table()
    classes = np.where(np.arange(256) < 128, table[:256], OTHER).astype(np.uint8)[buffer]
    lead = np.flatnonzero(buffer >= 0xC2)
    if len(lead):
        padded = np.concatenate((buffer, np.zeros(4, np.uint8)))
        b = [padded[lead + k].astype(np.int32) for k in range(4)]
        two, three = b[0] < 0xE0, b[0] < 0xF0
        point = np.where(two, (b[0] & 31) << 6 | b[1] & 63, np.where(three, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63))
        kind = table[point]
        classes[lead] = classes[lead + 1] = kind
        classes[lead[~two] + 2] = kind[~two]
        classes[lead[~three] + 3] = kind[~three]
    return classes


def cut(buffer: np.ndarray, kind: np.ndarray, first: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the pre-tokens in ``buffer``, class of each).

    ``kind``: the class of each byte.  ``first``: one longer than the buffer, true where a text begins and at the end.
    ``spaced``: a blank belongs to the pre-token after it, other white space stands
    alone and digits stay together; otherwise each digit stands alone and white
    space is a pre-token to be dropped.
    """
    n = len(buffer)
    bound = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=bound[1:n])
    if spaced:
        at = np.flatnonzero((kind == SPACE) & ((buffer & 0xC0) != 0x80))
        lead = buffer[at]
        after = at + 1 + (lead >= 0xC2) + (lead >= 0xE0) + (lead >= 0xF0)
        white = np.concatenate((kind == SPACE, [False]))
        inside = white[at - 1] & ~first[at]
        goes_on, ends = white[after] & ~first[after], first[after]
        bound[at] = ~inside | ~(goes_on | ends)
        single = ~goes_on & ~ends
        bound[after[single]] = lead[single] != 32
    else:
        bound[:n] |= (kind == NUMBER) & ((buffer & 0xC0) != 0x80)
    bound |= first
    at = np.flatnonzero((buffer == 39) & bound[:n])
    at = at[~first[at + 1]]
    if len(at):
        padded = np.concatenate((buffer, np.zeros(2, np.uint8)))
        a, b = padded[at + 1], padded[at + 2]
        short = np.isin(a, np.frombuffer(SHORT_ENDINGS, np.uint8))
        long = ~first[at + 2 - (at + 2 > n)] & np.logical_or.reduce([(a == e[0]) & (b == e[1]) for e in LONG_ENDINGS])
        for some, size in ((at[short], 2), (at[long], 3)):
            bound[some + 1] = False
            bound[some + size] = True
    starts = np.flatnonzero(bound[:n])
    return starts, kind[starts]


class TokenIds:
    """Encodes texts with one tokenizer file; remembers pre-tokens in one worker.

    ``spaced``: see ``cut``; files that are not spaced normalise to NFC and lower
    case.  ``specials_as_text``: strings of special tokens in a text are ordinary
    text; by default they get the ids of the special tokens, as in the library.
    """

    #: Pre-tokens remembered per worker (about 200 bytes each); beyond, all are learnt anew.
    LIMIT = 1_000_000

    def __init__(self, path: str, spaced: bool, limit: int = LIMIT, specials_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.specials = [] if specials_as_text else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced, self.limit = spaced, limit
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at = np.zeros((1 << 15, 2), np.int64)  # place and number of the ids of each pre-token

    def _learn(self, units: list[bytes]) -> None:
        tokenize, letters, n = self.model.tokenize, self.letters, len(self.known)
        found = [[t.id for t in tokenize(u.decode("latin-1").translate(letters))] for u in units]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while n + len(units) > len(self.at):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[n : n + len(units), 0] = self.used + np.cumsum(sizes) - sizes
        self.at[n : n + len(units), 1] = sizes
        self.used += len(flat)
        self.known.update(zip(units, range(n, n + len(units))))

    def _by_library(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids, np.uint32)

    def _folded(self, text: bytes) -> bytes | None:
        """The text as its pre-tokens see it; None where only the library can tell."""
        if self.spaced or not text:
            return text
        if text.isascii():
            return text.lower()
        whole = text.decode("utf-8")
        plain = is_normalized("NFC", whole) and "İ" not in whole and "Σ" not in whole
        return whole.lower().encode("utf-8") if plain else None

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each); a null text counts as empty."""
        import pyarrow as pa

        odd: dict[int, np.ndarray] = {}
        parts: list[bytes] = []
        for i, text in enumerate(texts):
            text = text or b""
            special = self.specials and b"<|" in text and any(s in text for s in self.specials)
            part = None if special else self._folded(text)
            if part is None:
                odd[i] = self._by_library(text)
            parts.append(part or b"")

        def joined():
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            buffer = np.frombuffer(b"".join(parts), np.uint8)
            return buffer, np.cumsum(sizes) - sizes, byte_classes(buffer)

        buffer, begin, classes = joined()
        if (unknown := np.flatnonzero(classes == UNKNOWN)).size:
            for i in np.unique(np.searchsorted(begin, unknown, "right") - 1).tolist():
                odd[i], parts[i] = self._by_library(texts[i]), b""
            buffer, begin, classes = joined()
        if len(buffer):
            first = np.zeros(len(buffer) + 1, bool)
            first[begin] = first[-1] = True
            starts, kind = cut(buffer, classes, first, self.spaced)
            offsets = np.append(starts, len(buffer)).astype(np.int32)
            units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)]).dictionary_encode()
            codes, distinct = units.indices.to_numpy(), units.dictionary.to_pylist()
            if len(self.known) > self.limit:
                self._forget()
            found = list(map(self.known.get, distinct))
            if None in found:
                self._learn([u for u, place in zip(distinct, found) if place is None])
                found = map(self.known.__getitem__, distinct)
            place = np.fromiter(found, np.int64, len(distinct))
            source, size = self.at[place, 0][codes], self.at[place, 1][codes]
            if not self.spaced:
                size[kind == SPACE] = 0
            upto = np.concatenate(([0], np.cumsum(size)))
            ids = self.ids[np.repeat(source - upto[:-1], size) + np.arange(upto[-1])]
            counts = np.diff(upto[np.searchsorted(starts, np.append(begin, len(buffer)))])
        else:
            ids, counts = np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if odd:
            pieces = np.split(ids, np.cumsum(counts)[:-1])
            for i, own in odd.items():
                pieces[i], counts[i] = own, len(own)
            ids = np.concatenate(pieces)
        return ids, counts


def token_ids(path: str, spaced: bool, limit: int = TokenIds.LIMIT, specials_as_text: bool = False) -> TokenIds:
    """One per Python worker; workers are reused between tasks."""
    key = path, spaced, limit, specials_as_text
    if key not in worker_memory:
        tidy_worker()
        worker_memory[key] = TokenIds(*key)
    return worker_memory[key]
