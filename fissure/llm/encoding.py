"""Whole-text encoding with the tokenizers library, word by word where that is exact."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fissure.llm.shared import kept_in_process

#: Bytes of remembered pieces and ids, of runs of letters and of other pieces; they bound a worker's memory, not its input.
LETTER_BYTES, OTHER_BYTES = 16_000_000, 4_000_000
BATCH_WORDS = 4096
MARKS = [*",.;:!?"]
#: Runs of the letters below U+0100, and a mark behind one.
LETTERS, MARK = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$", f"[{''.join(MARKS)}]$"


#: The characters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the others follow from 256 up.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARACTERS = {b: chr(b) for b in _SELF} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SELF)))}


def _listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def _ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of flat, one behind the other."""
    if not len(sizes):
        return flat[:0]
    ends = np.cumsum(sizes)
    at = np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at]


def _before(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


@dataclass
class Known:
    """Distinct pieces with their ids, those of a piece behind those of the one before it."""

    pieces: pa.Array
    flat: np.ndarray
    sizes: np.ndarray

    def find(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece; -1 where it isn't known."""
        return pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy(zero_copy_only=False).copy()

    def taken(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[at]
        return _ragged(self.flat, _before(self.sizes)[at], sizes), sizes

    def bytes(self) -> int:
        return self.pieces.nbytes + self.flat.nbytes + self.sizes.nbytes


NONE_KNOWN = Known(pa.array([], pa.large_string()), np.empty(0, "<u4"), np.empty(0, np.int64))


class Memo:
    """Ids by piece, in two generations of bounded size: what the younger one hasn't met for its length is forgotten."""

    def __init__(self, most: int):
        self.most = most // 2
        self.young = self.old = NONE_KNOWN

    def ids(self, pieces: pa.Array, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and where those of each of some distinct pieces start, and how many they are; make gives those that aren't remembered."""
        at = self.young.find(pieces)
        rest = pieces.filter(pa.array(at < 0))
        if len(rest):
            before = self.old.find(rest)
            new = rest.filter(pa.array(before < 0))
            made = [make(_listed(new.slice(i, BATCH_WORDS))) for i in range(0, len(new), BATCH_WORDS)]
            parts = [(self.young.flat, self.young.sizes), self.old.taken(before[before >= 0]), *made]
            fresh = np.empty(len(rest), at.dtype)
            fresh[before >= 0] = np.arange((before >= 0).sum())
            fresh[before < 0] = np.arange((before >= 0).sum(), len(rest))
            at[at < 0] = fresh + len(self.young.pieces)
            words = pa.concat_arrays([self.young.pieces, rest.filter(pa.array(before >= 0)), new])
            self.young = Known(words, *(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
        held = self.young
        if held.bytes() > self.most:
            self.old, self.young = held, NONE_KNOWN
        return held.flat, _before(held.sizes)[at], held.sizes[at]


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, given as bytes.

    The supported tokenizers (byte-level BPE and BPE with word ends) split a text before they merge, and never across
    a space that something other than white space follows, nor between a letter and a mark. So ids of a text are
    the ids of its space-separated pieces in a row, ids of a piece of letters and a mark those of both,
    and each distinct run of letters is encoded once. Texts with further white space
    behind a space, or with a special token written out, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.separator = special[-1]
        self.separator_id = self.tokenizer.token_to_id(self.separator)
        #: Whether a piece's ids depend on the space in front of it, and whether case is dropped.
        self.keeps_space = self._plain(" a") != self._plain("a")
        self.folds = self._plain("Ab") == self._plain("ab")
        #: Ids the vocabulary can give, and whether runs of letters may go to the model directly.
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.direct = True
        probe = ["a", "hello", "straße", "thorough", "éèê"]
        self.direct = all(map(np.array_equal, self._running(probe), self._separate(probe, " " if self.keeps_space else "")))
        self.whole = re.compile("|".join([r" (?=\s)", *map(re.escape, special)] if self.keeps_space else map(re.escape, special)))
        #: ids of the marks, and how many each has; those of no mark come last.
        marks = [*map(self._ids, MARKS), np.empty(0, "<u4")]
        self.mark_ids, self.mark_sizes = np.concatenate(marks), np.array(list(map(len, marks)))
        self.letters, self.others = Memo(LETTER_BYTES), Memo(OTHER_BYTES)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _plain(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _separate(self, words: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """ids of any pieces, encoded together with a special token between them, and how many each has."""
        ids = self._ids(lead + (self.separator + lead).join(words))
        cuts = np.flatnonzero(ids == self.separator_id)
        return np.delete(ids, cuts), np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1

    def _running(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of runs of letters: each is one unit before merging, so the model's merges alone are needed."""
        if not self.direct:
            return self._separate(stems, " " if self.keeps_space else "")
        merge, lead = self.tokenizer.model.tokenize, _BYTE_CHARACTERS[32] if self.keeps_space else ""
        plain = [lead + (s if s.isascii() else "".join(map(_BYTE_CHARACTERS.__getitem__, s.encode()))) for s in stems]
        ids = [[t.id for t in merge(s)] for s in plain]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum())), sizes

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of distinct pieces that a space goes before, and how many each has."""
        lead = " " if self.keeps_space else ""
        stems = pc.replace_substring_regex(words, MARK, "")
        simple = pc.match_substring_regex(stems, LETTERS)
        some, runs = words.filter(simple), stems.filter(simple)
        coded = (pc.utf8_lower(runs) if self.folds else runs).dictionary_encode()
        flat, starts, sizes = self.letters.ids(coded.dictionary, self._running)
        odd, odd_starts, odd_sizes = self.others.ids(words.filter(pc.invert(simple)), lambda new: self._separate(new, lead))
        codes = coded.indices.to_numpy(zero_copy_only=False)
        mark = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(some, -1), value_set=pa.array(MARKS, pa.large_string())), len(MARKS)).to_numpy(zero_copy_only=False)
        is_simple = simple.to_numpy(zero_copy_only=False)
        # Two stretches for each piece: its run of letters, or all of it, and its mark.
        at, n = np.zeros((2, len(words), 2), np.int64)
        at[is_simple, 0], n[is_simple, 0] = starts[codes], sizes[codes]
        at[is_simple, 1], n[is_simple, 1] = (_before(self.mark_sizes) + len(flat))[mark], self.mark_sizes[mark]
        at[~is_simple, 0], n[~is_simple, 0] = odd_starts + len(flat) + len(self.mark_ids), odd_sizes
        return _ragged(np.concatenate([flat, self.mark_ids, odd]), at.ravel(), n.ravel()), n.sum(1)

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """ids of texts that may be cut at every space."""
        if not texts:
            return []
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        at = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        known, sizes = self._of_words(coded.dictionary)
        if self.keeps_space:  # no space goes before a text's first piece
            first, place = np.unique(codes[at[:-1]], return_inverse=True)
            words = _listed(coded.dictionary.take(pa.array(first)))
            heads = [self._separate(words[i : i + BATCH_WORDS], "") for i in range(0, len(words), BATCH_WORDS)]
            codes = codes.copy()
            codes[at[:-1]] = len(sizes) + place
            known, sizes = np.concatenate([known, *[h[0] for h in heads]]), np.concatenate([sizes, *[h[1] for h in heads]])
        lengths = sizes[codes]
        raw = _ragged(known, _before(sizes)[codes], lengths).tobytes()
        ends = (4 * np.concatenate([[0], np.cumsum(lengths)])[at]).tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; None is empty."""
        odd = [t is None or bool(self.whole.search(t)) for t in texts]
        plain = iter(self._pieces([t for t, o in zip(texts, odd, strict=True) if not o]))
        return [next(plain) if not o else b"" if t is None else self._plain(t) for t, o in zip(texts, odd, strict=True)]


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    return kept_in_process(f"encoder {path}", lambda: Encoder(path))


def text_chunks(texts: pa.Array, budget: int = 1 << 21) -> Iterator[tuple[int, int, list[str | None]]]:
    """Texts in ranges of about `budget` bytes, so that work space stays bounded whatever a batch holds."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        ahead = int(upto[start - 1]) if start else 0
        end = min(int(np.searchsorted(upto, ahead + budget)) + 1, len(texts))
        yield start, end, texts.slice(start, end - start).to_pylist()
        start = end
