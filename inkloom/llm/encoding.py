"""Byte-level BPE ids of whole texts by the tokenizers library, with caches in front of it."""

from __future__ import annotations

import itertools
import os
import re
from collections import defaultdict

import numpy as np
import pyarrow.compute as pc

#: Pre-tokens that a worker's cache holds at most; then it starts anew.
CACHE = 1_000_000
# Texts of these characters alone are split here; for them the two classes below are all letters and numbers.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ſ]*")
_LETTER, _NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
# Fixed value: the split pattern that the vocabulary file names, for plain texts.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\\s{_LETTER}{_NUMBER}]+|\\s+(?!\\S)|\\s+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Cache:
    """Strings numbered as they are first seen, with their ids in one flat array."""

    def __init__(self):
        self.place: dict[str, int] = defaultdict(itertools.count().__next__)
        self.flat = np.empty(1 << 16, np.int32)
        self.ends = np.zeros(1, np.int32)

    def numbers(self, strings) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, strings), np.int32)

    def unknown(self) -> list[str]:
        # from the end, so that a batch does not walk over all that is known
        return list(itertools.islice(reversed(self.place), len(self.place) - len(self.ends) + 1))[::-1]

    def learn(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        begin = int(self.ends[-1])
        if begin + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:begin], np.empty(begin + len(ids), np.int32)])
        self.flat[begin : begin + len(ids)] = ids
        self.ends = np.concatenate([self.ends, begin + np.cumsum(sizes, dtype=np.int32)])

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the numbered strings, one after another."""
        begins = self.ends[numbers]
        sizes = self.ends[numbers + 1] - begins
        ends = np.cumsum(sizes, dtype=np.int32)
        if not len(ends):
            return np.empty(0, np.int32)
        return self.flat[np.arange(ends[-1], dtype=np.int32) + np.repeat(begins - ends + sizes, sizes)]


class Encoder:
    """encode(texts) gives the ids of whole texts, equal to those of encode_batch(), each with an end id after them.

    A byte-level BPE encodes each pre-token by itself, so that the library is
    asked once for each distinct pre-token. Pre-tokens of a space and letters
    are sent to it joined: they split again at their spaces, and the byte
    lengths of tokens, which add up to the text, tell where each ends. Texts
    with characters outside a plain range, or with a special token's string, go
    to the library whole.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token: its string has a character for each
        self.width[np.fromiter(vocab.values(), np.int64)] = np.fromiter(map(len, vocab), np.int64)
        self.end_id = end_id
        self._forget()

    def _forget(self) -> None:
        self.words = Cache()
        # no pre-token is empty: the empty string stands for the end id
        self.words.numbers([""])
        self.words.learn(np.ones(1, np.int64), np.array([self.end_id], np.int32))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return sizes, np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum()))

    def _learn(self) -> None:
        words = self.words.unknown()
        joined = [w[:1] == " " and w[1:].isalpha() for w in words]
        spaced = [w for w, j in zip(words, joined) if j]
        _, ids = self._whole(["".join(spaced[at : at + 4000]) for at in range(0, len(spaced), 4000)])
        ends = np.cumsum(np.fromiter((len(w.encode()) for w in spaced), np.int64, len(spaced)))
        places = np.searchsorted(np.cumsum(self.width[ids]), ends, "right")
        sizes = np.zeros(len(words), np.int64)
        joined = np.array(joined, bool)
        sizes[joined] = np.diff(places, prepend=0)
        sizes[~joined], others = self._whole([w for w, j in zip(words, joined) if not j])
        flat = np.empty(int(sizes.sum()), np.int32)
        mine = np.repeat(joined, sizes)
        flat[mine], flat[~mine] = ids, others
        self.words.learn(sizes, flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids): how many ids each text has with its end, and all ids one after another."""
        plain = [_PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        if len(self.words.place) > CACHE:
            self._forget()
        words = [[*_SPLIT.findall(t), ""] if p else () for t, p in zip(texts, plain)]
        numbers = self.words.numbers(itertools.chain.from_iterable(words))
        self._learn()
        ids = self.words.gather(numbers)
        lengths = np.concatenate([[0], np.cumsum(self.words.ends[numbers + 1] - self.words.ends[numbers], dtype=np.int64)])
        sizes = np.diff(lengths[np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])])
        if all(plain):
            return sizes, ids
        plain = np.array(plain)
        odd_sizes, odd = self._whole([t for t, p in zip(texts, plain) if not p])
        sizes[~plain] = odd_sizes + 1
        odd = np.insert(odd, np.cumsum(odd_sizes), self.end_id)
        mine, flat = np.repeat(plain, sizes), np.empty(int(sizes.sum()), np.int32)
        flat[mine], flat[~mine] = ids, odd
        return sizes, flat


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """The worker's encoder for a vocabulary file and end id; workers are used again, so its cache stays warm."""
    key = path, end_id
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, end_id)
    return _ENCODERS[key]


def small_batches(batch, column: str = "text", most_bytes: int = 2_000_000):
    """(slice of an Arrow batch, its texts) in runs of about most_bytes, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + most_bytes, "right")) - 1)
        part = batch.slice(begin, end - begin)
        yield part, part.column(column).to_pylist()
        begin = end
