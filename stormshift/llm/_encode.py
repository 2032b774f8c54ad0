"""Token ids by the tokenizers library, each distinct word about once a worker."""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np

#: Marks that end a chunk; after a letter they are a pre-token of their own, so the ids of both parts follow each other. Not those of 's and <|...|>.
_MARKS = b'!"#$%&()*+,-./:;=?@[\\]^_`{}~'
#: Bytes of each of the two generations of known chunks.
CACHE_BYTES = 72_000_000
#: Words that the library takes in one call.
_AT_ONCE = 1000


def _parts(chunk: bytes) -> tuple[bytes, bytes]:
    """A chunk's word and the marks after it, whose ids follow each other; a chunk that can't be parted is a word."""
    word = chunk.rstrip(_MARKS)
    if word.isalpha():  # ASCII letters: case does not matter to this vocabulary
        return word.lower(), chunk[len(word) :]
    # the last letter as the vocabulary sees it: a capital I with a dot becomes two characters, of which the second is no letter
    if word.decode("utf-8", "replace")[-1:].lower()[-1:].isalpha():
        return word, chunk[len(word) :]
    return chunk, b""


def _plain(word: bytes) -> bool:
    """Letters alone, in lower case, too: one pre-token."""
    return word.isalpha() or (b"\xc4\xb0" not in word and word.decode("utf-8", "replace").isalpha())


class _Chunks(dict):
    """Chunk -> little-endian ids; one that is not there is encoded.

    several: ids of many words of letters, None if they can't be told apart.

    Entries live in two generations of `limit` bytes each: when the younger is full it becomes the older, and what is met
    again returns to the younger. So memory is bounded by bytes, and frequent chunks stay.
    """

    def __init__(self, encode, several, limit: int):
        super().__init__()
        self.encode, self.several, self.limit, self.older, self.size = encode, several, limit, {}, 0

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            word, marks = _parts(chunk)
            if word == chunk:
                ids = self.encode(chunk)
            else:
                ids = self[word] + self[marks] if marks else self[word]
        self._put(chunk, ids)
        return ids

    def _put(self, chunk: bytes, ids: bytes) -> None:
        if self.size > self.limit:
            self.older, self.size = dict(self), 0
            self.clear()
        self[chunk] = ids
        self.size += len(chunk) + len(ids) + 200  # with what Python takes for an entry

    def learn(self, chunks: set[bytes]) -> None:
        """The words of chunks that are not in the younger generation, many in one call: a call takes longer than a word."""
        older = self.older
        words = {_parts(c)[0] for c in chunks if c not in older}
        words = [w for w in words if w not in self and w not in older and _plain(w)]
        for start in range(0, len(words), _AT_ONCE):
            some = words[start : start + _AT_ONCE]
            for word, ids in zip(some, self.several(some) or ()):
                self._put(word, ids)


class Encoder:
    """ids(text as UTF-8) -> little-endian ids.

    by_chunk: for vocabularies that drop white space and fold case, where ids of a text are the ids of its chunks between
    ASCII white space, one after another. Otherwise whole texts go to the library.
    """

    def __init__(self, path: str, by_chunk: bool = False, limit: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 65_536 else "<u4")
        self.chunks = _Chunks(self._library, self._words, limit) if by_chunk else None
        self.suffix = getattr(self.library.model, "end_of_word_suffix", None) if by_chunk else None
        if self.suffix:
            self.ends = np.zeros(self.library.get_vocab_size(), bool)
            self.ends[[i for token, i in self.library.get_vocab().items() if token.endswith(self.suffix)]] = True

    def _library(self, text: bytes) -> bytes:
        return array(self.dtype.char, self.library.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids).tobytes()

    def _words(self, words: list[bytes]) -> list[bytes] | None:
        """Ids of each of words, one pre-token each, by one call; the ids that end a word tell them apart."""
        if not self.suffix or len(words) < 2:
            return None
        ids = self._library(b" ".join(words))
        at = (np.flatnonzero(self.ends[np.frombuffer(ids, self.dtype)]) + 1) * self.dtype.itemsize
        if len(at) != len(words):  # a word of several pre-tokens: each on its own
            return None
        return [ids[a:b] for a, b in zip([0, *at.tolist()], at.tolist())]

    def ids(self, text: bytes) -> bytes:
        if self.chunks is None:
            return self._library(text)
        chunks, known = text.split(), self.chunks
        ids = list(map(known.get, chunks))  # most are there, and looked up once
        if None in ids:
            known.learn({c for c, x in zip(chunks, ids) if x is None})
            ids = [known[c] if x is None else x for c, x in zip(chunks, ids)]
        return b"".join(ids)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, by_chunk: bool, limit: int = CACHE_BYTES) -> Encoder:
    """The worker's own encoder; it lives as long as the Python worker."""
    key = (path, by_chunk, limit)
    if key not in _encoders:
        _encoders[key] = Encoder(path, by_chunk, limit)
    return _encoders[key]


def release() -> None:
    """Frees the encoders of this worker; steps that need much memory and no tokenizer call it."""
    _encoders.clear()


def crc32(ids: np.ndarray, crc: int = 0) -> int:
    """Of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes(), crc)
