"""Token ids of whole texts: distinct pieces are encoded once a worker, texts are put together in numpy.

Texts are cut where no tokenizer of the given kind lets a token or a normalisation cross, so the
ids of a text are those of its pieces one after another. Texts that hold a construct for which
that does not follow from the pre-tokenizer's pattern are encoded whole.
"""

from __future__ import annotations

import gc
import os
import re
from array import array as numbers
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrowtext import plain

#: Pieces, and words without their stops, that a worker remembers; beyond it starts anew.
REMEMBERED, WORDS = 1_000_000, 600_000
#: White space of Unicode, as a class of RE2.
WHITE = r"[\x09-\x0D\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A space within or at the end of a longer run of white space: such a run may not be cut there.
UNSAFE = f"{WHITE} (?:{WHITE}|$)".replace("$", r"\z")

#: Letters below U+0250 beside those of ASCII: their class is the same in every version of Unicode.
HIGH = "\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
#: Pieces of nothing but these, line feeds and ASCII's visible characters are split here as byte-level pre-tokenizers split them.
SIMPLE = re.compile(f" ?[\n!-~{HIGH}]+")
BYTE_LEVEL = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[A-Za-z{HIGH}]+| ?[0-9]+| ?[^\\sA-Za-z0-9{HIGH}]+|\\s+(?!\\S)|\\s+")

Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def gather(pool: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """pool[begin:begin + count] of all spans, one after another."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(begin - ends + count, count) + np.arange(total)]


@contextmanager
def no_cycles() -> Iterator[None]:
    """Python's search for reference cycles stands still: many objects are made here, none in cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Memo:
    """Ids of pieces; encode gives the ids of many pieces and how many each has."""

    def __init__(self, encode: Encode, most: int = REMEMBERED):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.begin, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def spans(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Begin in self.pool and count of each of the distinct pieces."""
        found = list(map(self.at.get, pieces))
        new = [p for p, at in zip(pieces, found) if at is None]
        if new and len(self.at) + len(new) > self.most:
            self.clear()
            new, found = pieces, [None] * len(pieces)
        if not new:
            where = np.array(found, np.int64)
            return self.begin[where], self.count[where]
        ids, count = self.encode(new)
        k, n = len(self.at), len(self.at) + len(new)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(ids), np.int32)])
        if n > len(self.begin):
            self.begin, self.count = (np.concatenate([x[:k], np.zeros(2 * n, np.int64)]) for x in (self.begin, self.count))
        self.pool[self.used : self.used + len(ids)] = ids
        self.count[k:n] = count
        self.begin[k:n] = self.used + np.cumsum(count) - count
        self.used += len(ids)
        self.at.update(zip(new, range(k, n)))
        where = np.array(found, np.float64)  # None: NaN
        fresh = np.isnan(where)
        where[fresh] = np.arange(k, n)
        where = where.astype(np.int64)
        return self.begin[where], self.count[where]


def _spans(memo: Memo, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    coded = pieces.dictionary_encode()
    begin, count = memo.spans(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    where = coded.indices.to_numpy()
    return begin[where], count[where]


class Encoder:
    """encode gives ids of pieces; spaced: pieces keep the one space before them, and the texts' first pieces have none."""

    def __init__(self, encode: Encode, spaced: bool, special: Iterable[str] = ()):
        self.encode, self.spaced, self.special = encode, spaced, tuple(special)
        self.inner = Memo((lambda pieces: encode([" " + p for p in pieces])) if spaced else encode)
        self.first = Memo(encode)

    def whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts have to be encoded as one piece."""
        if not self.spaced:
            return np.zeros(len(texts), bool)
        odd = pc.match_substring_regex(texts, UNSAFE)
        for x in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        return odd.to_numpy(zero_copy_only=False)

    def __call__(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (and the end). Nulls count as empty."""
        with no_cycles():
            return self._encoded(plain(array))

    def _encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = self.whole(texts)
        if odd.any():
            singles, counts = self.encode(pc.filter(texts, pa.array(odd)).to_pylist())
            texts = pc.if_else(pa.array(odd), "", texts)
        lists = pc.split_pattern(texts, " ") if self.spaced else pc.ascii_split_whitespace(texts)
        at, pieces = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
        at = at - at[0] if len(at) else np.zeros(1, np.int64)
        if self.spaced:
            opens = np.zeros(len(pieces), bool)
            opens[at[:-1]] = True
            begin, count = np.zeros((2, len(pieces)), np.int64)
            begin[~opens], count[~opens] = _spans(self.inner, pieces.filter(pa.array(~opens)))
            b, count[opens] = _spans(self.first, pieces.filter(pa.array(opens)))
            begin[opens] = b + self.inner.used
            pool = np.concatenate([self.inner.pool[: self.inner.used], self.first.pool[: self.first.used]])
        else:
            begin, count = _spans(self.inner, pieces)
            pool = self.inner.pool
        ids = gather(pool, begin, count)
        ends = np.concatenate([[0], np.cumsum(count)])[at]
        if odd.any():
            parts, k, done = [], 0, 0
            sizes = np.diff(ends)
            for i in np.flatnonzero(odd):
                parts += [ids[done : ends[i]], singles[k : k + counts[len(parts) // 2]]]
                sizes[i], done = len(parts[-1]), ends[i]
                k += len(parts[-1])
            ids = np.concatenate([*parts, ids[done:]])
            ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, ends


#: Stops that follow a word.
STOPS = ".,;:!?"
#: Letters below this code point have the same class and case in every version of Unicode.
PLAIN_LETTERS = "\u0250"


def byte_letters() -> dict[int, str]:
    """Byte-level tokenizers write each byte as a letter: printable Latin-1 as it is, the others from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


@lru_cache(maxsize=4)
def library_encoder(path: str, spaced: bool) -> Encoder:
    """An Encoder that takes its ids from the tokenizers library, one for each file and worker.

    A word of plain letters, perhaps with a stop after it, is a piece (or two) of both kinds of
    pre-tokenizer: the library's model takes it as it is. For byte-level ones other pieces of plain
    characters are split here as they do. All else goes through the whole library.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    tokenize, letters, folds = library.model.tokenize, byte_letters(), library.normalizer is not None
    known: dict[str, bytes] = {}

    def model_ids(piece: str) -> bytes:
        if piece.isalpha() and piece.isascii():
            named = piece
        elif piece[:1] == " " and piece[1:].isalpha() and piece.isascii():
            named = letters[32] + piece[1:]
        else:
            named = piece.encode().decode("latin1").translate(letters)
        return numbers("i", [t.id for t in tokenize(named)]).tobytes()

    def part_ids(part: str) -> bytes:
        ids = known.get(part)
        if ids is None:
            ids = known[part] = model_ids(part)
        return ids

    special = [x.content for x in library.get_added_tokens_decoder().values()]
    stops = {x: model_ids(x) for x in STOPS}

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(known) > WORDS:
            known.clear()
        parts: list[bytes] = []
        rest: list[int] = []
        for i, piece in enumerate(pieces):
            stop = stops.get(piece[-1:])
            core = piece if stop is None else piece[:-1]
            if folds:
                core = core.lower()
            ids = known.get(core)
            if ids is None:
                word = core[1:] if spaced and core[:1] == " " else core
                if word.isalpha() and (word.isascii() or max(word) < PLAIN_LETTERS):
                    ids = known[core] = model_ids(core)
                elif spaced and SIMPLE.fullmatch(piece) and not any(x in piece for x in special):
                    ids, stop = b"".join(map(part_ids, BYTE_LEVEL.findall(piece))), None
                else:
                    rest.append(i)
                    ids, stop = b"", None
            parts.append(ids if stop is None else ids + stop)
        for k in range(0, len(rest), 2000):
            own = rest[k : k + 2000]
            for i, x in zip(own, library.encode_batch_fast([pieces[i] for i in own], add_special_tokens=False)):
                parts[i] = numbers("i", x.ids).tobytes()
        counts = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        return np.frombuffer(b"".join(parts), np.int32), counts

    return Encoder(encode, spaced, special)
