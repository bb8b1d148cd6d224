"""Token counts and token ids of whole texts, with public tokenizer files.

Both encoders here split a text into *units* that the tokenizer provably never
joins, and remember what each unit gives, because most words occur again and
again. A huge text is encoded in overlapping chunks: every chunk reports where
its units end, two neighbours are spliced at the first end that both report
inside their overlap and that is stable, and an overlap without such a place is
widened until there is one or the chunks are one.

A place ``p`` is stable for the byte-level pre-tokenizer where ``text[p - 1]``
is not white space and ``text[p]`` is: every alternative of its pattern takes
white space only at its start or takes nothing else, so every scan, from
wherever it began, has a boundary there; merges never cross it. Special tokens
hold no white space, so none spans such a place.

Defined results: a null text is an empty one; every row, repeated or with a
null id, gives its own row; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import threading
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of one code point whose case, form and class need no library:
#: printable ASCII, and Latin letters that are already composed.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN = "!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: The contractions that the tokenizers' patterns name.
_SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"

#: Units, and parts of units, that an encoder remembers at most, and their characters: some 90 MB, for as long as tasks follow each other.
MEMORY, PIECES, LONGEST = 600_000, 300_000, 64
CHUNK, OVERLAP = 1 << 16, 256
WORDS_AT_ONCE = 1 << 20  # characters that are split into words together


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(extra)) for b in range(256)]


_STAND_IN = _byte_letters()


def _mapped(piece: str) -> str:
    return piece if piece.isascii() and piece.isalnum() else "".join(map(_STAND_IN.__getitem__, piece.encode()))


_GAP = re.compile(r"\s")


def _has(text: str, any_of: tuple[str, ...]) -> bool:
    return any(x in text for x in any_of)


class _Remembered(dict):
    """A bounded map of short strings that works out what it lacks."""

    def __init__(self, work, most: int):
        super().__init__()
        self.work, self.most = work, most

    def __missing__(self, key):
        value = self.work(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class ByteCounter:
    """Counts the tokens of a byte-level BPE file of the tokenizers library."""

    _unit = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
    #: White space other than space and line feed, and the start of special tokens.
    _odd = ("\t", "\x0b", "\x0c", "\r", *map(chr, range(0x1C, 0x20)), "\x85", "\xa0", "\u1680", "\u180e")
    _odd += (*map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "<|")
    _simple = re.compile(f"[ \\n]?[{_PLAIN}]+(?:\\n[{_PLAIN}]+)*")
    _pre = re.compile(f"{_SUFFIX}| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\n")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = self.library.model
        pieces = _Remembered(lambda p: len(model.tokenize(_mapped(p))), PIECES)
        count = pieces.__getitem__

        def work(unit: str) -> int:
            if self._simple.fullmatch(unit):
                return sum(map(count, self._pre.findall(unit)))
            return len(self.library.encode(unit, add_special_tokens=False).ids)

        self.known = _Remembered(work, MEMORY // 4)
        self.after_space = _Remembered(lambda word: work(" " + word), MEMORY)

    def units(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where units of ``text`` end, and the tokens in each."""
        if _has(text, self._odd):
            ends = [b for _, b in self.library.encode(text, add_special_tokens=False).offsets]
            return np.array(ends, np.int64), np.ones(len(ends), np.int64)
        units = self._unit.findall(text)
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        return ends, np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if len(text) <= chunk:
            if _has(text, self._odd):
                return len(self.library.encode(text, add_special_tokens=False).ids)
            if "  " in text or "\n " in text:
                return sum(map(self.known.__getitem__, self._unit.findall(text)))
            first, *words = text.split(" ")  # every space follows something else: units end before it
            return (self.known[first] if first else 0) + sum(map(self.after_space.__getitem__, words))
        return spliced(self.units, text, chunk, overlap)


def stable(text: str, places: np.ndarray) -> np.ndarray:
    """Of the places, those between a character that isn't white space and one that is."""
    return np.array([p for p in places.tolist() if 0 < p < len(text) and text[p].isspace() and not text[p - 1].isspace()], np.int64)


def spliced(units, text: str, chunk: int, overlap: int) -> int:
    """Tokens of ``text`` from overlapping chunks.

    ``total`` counts what is settled up to ``done``; the current chunk's own
    units settle the text up to the splice with the next chunk.
    """
    total, done, begin, end = 0, 0, 0, min(chunk, len(text))
    ends, n = units(text[begin:end])
    while end < len(text):
        wide, meet = overlap, None
        while meet is None:
            start = end - wide
            if start <= done:  # the overlap is all of this chunk: one longer chunk
                break
            after, m = units(text[start : min(start + chunk + wide, len(text))])
            common = np.intersect1d(ends + begin, after + start)
            common = common[(common > start) & (common < end) & (common > done)]
            places = stable(text, common)
            meet = int(places[0]) if len(places) else None
            wide *= 2
        if meet is None:
            end = min(end + chunk, len(text))
            begin = done
            ends, n = units(text[begin:end])
            continue
        total += int(n[(ends + begin <= meet) & (ends + begin > done)].sum())
        begin, done, ends, n = start, meet, after, m
        end = min(start + chunk + wide // 2, len(text))
    return total + int(n[ends + begin > done].sum())


class WordEncoder:
    """Ids of a lower-casing BPE file with word ends, which drops white space.

    Its normalizer and pre-tokenizer never look across white space, so words
    are the units.
    """

    #: What Python splits at and the tokenizer doesn't, and the start of special tokens.
    _odd = (*map(chr, range(0x1C, 0x20)), "\u180e", "<|")
    _simple = re.compile(f"[{_PLAIN}]+")
    _pre = re.compile(f"{_SUFFIX}|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = self.library.model
        pieces = _Remembered(lambda p: array("I", [t.id for t in model.tokenize(_mapped(p))]).tobytes(), PIECES)

        def work(word: str) -> int:
            if word.isascii() and word.isalpha():  # one piece
                raw = pieces[word.lower()]
            elif self._simple.fullmatch(word):
                raw = b"".join([pieces[p] for p in self._pre.findall(word.lower())])
            else:
                raw = array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()
            if len(word) > LONGEST:
                return self._hold(raw)
            self.starts.append(len(self.ids))
            self.ids.frombytes(raw)
            self.sizes.append(len(raw) >> 2)
            return len(self.starts) - 1

        self.known = _Remembered(work, MEMORY)
        self._forget()

    def _forget(self) -> None:
        """Entry 0 is the closing id, which no word can name."""
        self.known.clear()
        self.ids, self.starts, self.sizes = array("I", [0]), array("q", [0]), array("q", [1])

    def _hold(self, raw: bytes) -> int:
        """The number, negative, of an entry for this call alone."""
        self.own_starts.append(len(self.own_ids))
        self.own_ids.frombytes(raw)
        self.own_sizes.append(len(raw) >> 2)
        return -len(self.own_starts)

    @staticmethod
    def _parts(text: str) -> Iterator[str]:
        """A text cut at white space, so that only some of its words are strings at a time."""
        begin = 0
        while len(text) - begin > WORDS_AT_ONCE:
            gap = _GAP.search(text, begin + WORDS_AT_ONCE)
            end = gap.start() if gap else len(text)
            yield text[begin:end]
            begin = end
        yield text[begin:] if begin else text

    def encode(self, texts: list[str], closing: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, ``closing`` after each, and their numbers."""
        if len(self.starts) > MEMORY:
            self._forget()
        self.own_ids, self.own_starts, self.own_sizes = array("I"), array("q"), array("q")
        self.ids[0] = closing
        find, places, lengths = self.known.__getitem__, [], []
        close = np.zeros(1, np.int64)
        for text in texts:
            if _has(text, self._odd):
                found = [np.array([self._hold(array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes())], np.int64)]
            else:
                found = []
                for part in self._parts(text):
                    words = part.split()
                    found.append(np.fromiter(map(find, words), np.int64, len(words)))
            places += [*found, close]
            lengths.append(sum(map(len, found)) + 1)
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        own = at < 0
        at[own] = -1 - at[own]
        view = lambda x, kind: np.frombuffer(x, kind) if len(x) else np.zeros(1, kind)  # noqa: E731  not a copy
        pick = lambda a, b: np.where(own, view(b, np.int64)[np.where(own, at, 0)], view(a, np.int64)[np.where(own, 0, at)])
        starts, sizes = (pick(self.starts, self.own_starts), pick(self.sizes, self.own_sizes)) if len(at) else (at, at)
        total = np.cumsum(sizes)
        offsets = np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)
        out = np.empty(len(offsets), np.uint32)
        mine = np.repeat(own, sizes)
        out[~mine], out[mine] = view(self.ids, np.uint32)[offsets[~mine]], view(self.own_ids, np.uint32)[offsets[mine]]
        last = np.cumsum(lengths) - 1
        ends = total[last] if len(last) else np.zeros(0, np.int64)
        return out, np.diff(ends, prepend=0)


IDLE = 0.5  # seconds without a task after which a worker gives its encoders up
_encoders: dict = {}
_lock = threading.Lock()
_uses = {"now": 0, "ever": 0}


def _give_up(ever: int) -> None:
    with _lock:
        if not _uses["now"] and _uses["ever"] == ever:
            _encoders.clear()
            gc.collect()  # encoders and what they call hold each other
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)  # what glibc holds back goes to the system


@contextlib.contextmanager
def encoder(kind, path: str):
    """A worker's encoder of a file: the next task finds what it remembers, unless the worker was idle or did other work."""
    with _lock:
        _uses["now"] += 1
        _uses["ever"] += 1
        if (kind, path) not in _encoders:
            _encoders[kind, path] = kind(path)
        held = _encoders[kind, path]
    try:
        yield held
    finally:
        with _lock:
            _uses["now"] -= 1
            timer = threading.Timer(IDLE, _give_up, (_uses["ever"],))
        timer.daemon = True
        timer.start()


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, one row per input row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(ByteCounter, path) as counter:
            for batch in batches:
                n = [counter.count(t) if t else 0 for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    sized = docs.selectExpr("doc_id", "coalesce(cast(octet_length(text) as bigint), 0L) AS n_bytes", "text")
    ids = docs.schema["doc_id"].dataType.simpleString()
    counted = sized.mapInArrow(work, f"doc_id {ids}, n_bytes long, n_tokens long")
    return counted.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {limit} AS over_limit")
