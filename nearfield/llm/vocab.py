"""Encoding by public tokenizers, each distinct stretch of text once.

A text is cut at single spaces between two other characters. The tokenizers used here never let a
token reach across such a place (words take the space before them; no piece has a space behind
another character), so the stretches are encoded on their own and a cache spares the repeated ones.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FOLDER = "/opt/tokenizers"
# Stretches that are kept between texts; beyond, the cache starts anew.
CACHE_STRETCHES = 600_000
# Text bytes that are cut and encoded at a time.
CHUNK_BYTES = 4 << 20

_CUT = re.compile(r"(?<=\S) (?=\S)")
_RARE_SPACE = re.compile(r"[^\S \n]")
# Latin letters that stay single letters in lower case.
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
# A plain word and the marks behind it: the tokenizers never join the two.
_MARKED = re.compile(f"([{_LATIN}]+)([.,;:!?]*)")
# Words that are encoded as one text.
_RUN = 2048


def text_chunks(
    column: pa.Array, limit: int = CHUNK_BYTES
) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of rows with some ``limit`` bytes of text, and their texts as bytes; a null is empty."""
    raw = column.cast(pa.binary())
    for a, b in chunks(pc.fill_null(pc.binary_length(raw), 0).to_pylist(), limit):
        yield a, b, [v or b"" for v in raw.slice(a, b - a).to_pylist()]


def decoded(bodies: list[bytes]) -> list[str]:
    """Bytes that are no UTF-8 are replaced."""
    return [v.decode("utf-8", "replace") for v in bodies]


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of neighbours that together hold ``limit``, one more at most."""
    begin = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= limit:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


@dataclass
class Rows:
    """Rows of ids of different lengths: all ids, and the edges of the rows."""

    ids: np.ndarray
    bounds: np.ndarray

    @staticmethod
    def of(rows: list[list[int]]) -> Rows:
        bounds = np.cumsum([0, *map(len, rows)])
        return Rows(np.fromiter(chain.from_iterable(rows), np.int32, bounds[-1]), bounds)

    def plus(self, more: Rows) -> Rows:
        return Rows(
            np.concatenate([self.ids, more.ids]),
            np.concatenate([self.bounds, more.bounds[1:] + self.bounds[-1]]),
        )

    def take(self, places: np.ndarray) -> Rows:
        sizes = self.bounds[places + 1] - self.bounds[places]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(bounds[-1]) + np.repeat(self.bounds[places] - bounds[:-1], sizes)
        return Rows(self.ids[at], bounds)

    def joined(self, counts: np.ndarray) -> Rows:
        """Runs of ``counts`` neighbouring rows as one row each."""
        return Rows(self.ids, self.bounds[np.concatenate([[0], np.cumsum(counts)])])


NO_ROWS = Rows(np.zeros(0, np.int32), np.zeros(1, np.int64))


def at_single_spaces(text: str) -> list[str]:
    """Cut a text at spaces with no white space beside them."""
    if (
        "  " in text
        or " \n" in text
        or "\n " in text
        or text.startswith(" ")
        or text.endswith(" ")
        or _RARE_SPACE.search(text)
    ):
        return _CUT.split(text)
    return text.split(" ")


def at_spaces(text: str) -> list[str]:
    """Cut a text at every space and line feed, for tokenizers that drop white space."""
    return text.replace("\n", " ").split(" ")


class Stretches:
    """Encoder of texts by one or more tokenizers.

    ``encode`` takes new stretches and returns them in an order of its own, with one ``Rows`` per
    tokenizer and a flag per stretch.
    """

    def __init__(self, encode, tokenizers: int, cut: Callable[[str], list[str]], most: int | None = None):
        """The cache starts anew when it holds more than ``most`` stretches."""
        self.encode, self.tokenizers, self.cut = encode, tokenizers, cut
        self.most = CACHE_STRETCHES if most is None else most
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.rows = [NO_ROWS] * self.tokenizers
        self.flags = np.zeros(0, bool)

    def _learn(self, new: list[str]) -> None:
        ordered, rows, flags = self.encode(new)
        self.places.update(zip(ordered, range(len(self.places), len(self.places) + len(new)), strict=True))
        self.rows = [old.plus(more) for old, more in zip(self.rows, rows, strict=True)]
        self.flags = np.concatenate([self.flags, flags])

    def texts(self, texts: list[str]) -> tuple[list[Rows], np.ndarray]:
        """Ids of each text by each tokenizer, and whether all stretches of a text are flagged."""
        if len(self.places) > self.most:
            self.forget()
        cut = [self.cut(text) if text else [] for text in texts]
        counts = np.array([len(own) for own in cut], np.int64)
        flat = list(chain.from_iterable(cut))
        new = set(flat).difference(self.places)
        if new:
            self._learn(list(new))
        places = np.fromiter(map(self.places.__getitem__, flat), np.int64, len(flat))
        flagged = np.concatenate([[0], np.cumsum(self.flags[places])])
        upto = np.concatenate([[0], np.cumsum(counts)])
        return [r.take(places).joined(counts) for r in self.rows], np.diff(flagged[upto]) == counts


_loaded: dict[object, object] = {}


def json_tokenizer(path: str):
    """A tokenizer file of the ``tokenizers`` library, loaded once per worker, on one thread."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
        # Strings of special tokens inside a text are plain text.
        _loaded[path].encode_special_tokens = True
    return _loaded[path]


def piece_model(path: str):
    """A model file of the ``sentencepiece`` library, loaded once per worker."""
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def in_runs(
    words: list[str],
    one: Callable[[str], list[int]],
    each: Callable[[list[str]], list[list[int]]],
    marks: np.ndarray,
    closing: bool = False,
) -> Rows:
    """Ids of words, many encoded as one text and told apart by the ids that open (close) a word.

    A run that does not fall into as many parts as it has words is encoded word by word.
    """
    out = [NO_ROWS]
    for a in range(0, len(words), _RUN):
        run = words[a : a + _RUN]
        ids = np.array(one(" ".join(run)), np.int32)
        places = np.flatnonzero(marks[ids])
        bounds = np.concatenate([[0], places + 1] if closing else [places, [len(ids)]])
        if len(bounds) == len(run) + 1 and bounds[0] == 0 and bounds[-1] == len(ids):
            out.append(Rows(ids, bounds))
        else:
            out.append(Rows.of(each(run)))
    edges = np.cumsum([r.bounds[-1] for r in out])
    return Rows(
        np.concatenate([r.ids for r in out]),
        np.concatenate([out[0].bounds, *[r.bounds[1:] + e for r, e in zip(out[1:], edges, strict=False)]]),
    )


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable characters stand for themselves; the other bytes take the characters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


def byte_entries(path: str, close: bytes = b"") -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary, with ``close`` for the end of a word."""
    if (path, close) not in _loaded:
        symbols = byte_symbols()
        names = json_tokenizer(path).get_vocab(with_added_tokens=False)
        out = [b""] * (max(names.values()) + 1)
        for name, number in names.items():
            body = name.removesuffix("</w>")
            own = bytes(symbols[c] for c in body) if all(c in symbols for c in body) else body.encode()
            out[number] = own + close if body != name else own
        _loaded[path, close] = out
    return _loaded[path, close]


def pair_encoder(entries: list[bytes], pattern: str):
    """Byte-pair encoder of pieces cut by a pattern; ids are in the order of the merges."""
    import tiktoken

    ranks = {entry: number for number, entry in enumerate(entries) if entry}
    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def by_words(
    new: list[str],
    plain: Callable[[list[str]], Rows],
    marks: Callable[[list[str]], Rows],
    odd: Callable[[list[str]], Rows],
    lower: Callable[[list[str]], list[str]] = list,
) -> tuple[list[str], Rows]:
    """Stretches in a new order and their ids: plain words with the marks behind them, then the rest.

    ``plain`` and ``marks`` get each word and each string of marks once.
    """
    known: list[str] = []
    words: list[str] = []
    tails: list[str] = []
    rest: list[str] = []
    for s in new:
        if found := _MARKED.fullmatch(s):
            known.append(s)
            words.append(found[1])
            tails.append(found[2])
        else:
            rest.append(s)
    words = lower(words)
    distinct, kinds = list(set(words)), list(set(tails))
    place = {s: i for i, s in enumerate(distinct)}
    kind = {s: i for i, s in enumerate(kinds, len(distinct))}
    places = np.empty(2 * len(words), np.int64)
    places[::2] = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    places[1::2] = np.fromiter(map(kind.__getitem__, tails), np.int64, len(tails))
    rows = plain(distinct).plus(marks(kinds)).take(places).joined(np.full(len(words), 2))
    return [*known, *rest], rows.plus(odd(rest))


def forget() -> None:
    """Drop the tokenizers and vocabularies that the worker has loaded."""
    _loaded.clear()


class _Words:
    """Encodes distinct stretches by a tokenizer that ends each word with an id of its own kind.

    Plain words go through a byte-pair encoder, a space standing for the end of a word: no word
    holds one. Whatever else there is (digits, signs, other scripts) goes through the tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = json_tokenizer(path)
        entries = byte_entries(path, b" ")
        self.pairs = pair_encoder(entries, "[^ ]+ ")
        self.closes = np.array([len(e) > 1 and e.endswith(b" ") for e in entries])

    def _lower(self, words: list[str]) -> list[str]:
        found = [s.lower() if s.isascii() else None for s in words]
        rest = [s for s, done in zip(words, found, strict=True) if done is None]
        made = iter(self.tokenizer.normalizer.normalize_str(" ".join(rest)).split(" "))
        return [next(made) if done is None else done for done in found]

    def _each(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _plain(self, words: list[str]) -> Rows:
        one = self.pairs.encode_ordinary
        return in_runs(words, lambda text: one(f"{text} "), self._each, self.closes, closing=True)

    def __call__(self, new: list[str]) -> tuple[list[str], list[Rows], np.ndarray]:
        odd = lambda words: Rows.of(self._each(words))
        new, rows = by_words(new, self._plain, odd, odd, self._lower)
        return new, [rows], np.ones(len(new), bool)


def word_stretches(path: str) -> Stretches:
    """Encoder of a word tokenizer, which drops white space; kept by the worker."""
    if (path, "stretches") not in _loaded:
        _loaded[path, "stretches"] = Stretches(_Words(path), 1, at_spaces)
    return _loaded[path, "stretches"]
