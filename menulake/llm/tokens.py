"""Whole-text encoding with a public tokenizer file, fast for corpora whose words repeat."""

from __future__ import annotations

import functools
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from menulake.llm.common import LOWER, as_bytes

#: Different words that one Python worker remembers, words encoded in one call, and bytes of text
#: that are looked at together.
CACHE_WORDS, CALL_WORDS, CHUNK_BYTES = 800_000, 1000, 1 << 20
#: A special token between words that are encoded together.
MARK = "<|endoftext|>"
#: A-Z lowered, line feeds as spaces.
_PLAIN = bytes(32 if b == 10 else b for b in LOWER)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for
    itself, the others in order from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """The ids of tokenizer.encode(text, add_special_tokens=False) as little-endian unsigned 32-bit
    integers.

    The tokenizer must be like `word_bpe_49k.json`: white space is dropped and no token crosses it,
    letters are lowered, letters and other signs are encoded apart, and each such pre-token alone,
    over bytes. So a text's ids are those of its words, split at spaces and line feeds. Words that
    were met lately aren't encoded again. Others are, by the library: a word of lower-case letters
    only is one pre-token and goes to the model at once, as it does before a comma or full stop
    that ends the word; the rest pass through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.mark = self.tokenizer.token_to_id(MARK)
        self.letters = byte_letters()
        self.cache: dict[bytes, bytes] = {}
        self.stops = {ord(c): self._ids(c).tobytes() for c in ",."}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _one_pretoken(self, word: bytes) -> str | None:
        """A word as the model takes it, if it is all letters that no normal form changes."""
        if word.isalpha():  # of bytes: ASCII letters, here lowered
            return word.decode()
        text = word.decode()
        if text.isalpha() and text.lower() == text and unicodedata.is_normalized("NFC", text):
            return word.decode("latin-1").translate(self.letters)
        return None

    def _learn(self, words: Iterable[bytes]) -> None:
        rest, cache, stops, tokenize = [], self.cache, self.stops, self.model.tokenize
        for w in words:
            stop = stops.get(w[-1], b"") if w else b""
            text = self._one_pretoken(w[:-1] if stop else w)
            if text is None:
                rest.append(w)
            else:
                cache[w] = array("I", [t.id for t in tokenize(text)]).tobytes() + stop
        odd = [w for w in rest if b"<|" in w]  # may hold a special token's own string
        for w in odd:
            cache[w] = self._ids(w.decode()).tobytes()
        rest = [w for w in rest if b"<|" not in w]
        for at in range(0, len(rest), CALL_WORDS):
            part = rest[at : at + CALL_WORDS]
            ids = self._ids(MARK.join([w.decode() for w in part]))
            cuts = np.flatnonzero(ids == self.mark)
            data = ids.tobytes()
            begins, ends = [0, *((cuts + 1) * 4).tolist()], [*(cuts * 4).tolist(), len(data)]
            cache.update(zip(part, [data[b:e] for b, e in zip(begins, ends, strict=True)], strict=True))

    @staticmethod
    def words(text: bytes | None) -> list[bytes]:
        """A text's words, A-Z lowered but for those that may hold a special token: the library looks
        for its string before it lowers letters."""
        if not text:
            return []
        words = text.translate(_PLAIN).split(b" ")
        if b"<|" in text:
            raw = text.replace(b"\n", b" ").split(b" ")
            words = [r if b"<|" in r else w for r, w in zip(raw, words, strict=True)]
        return words

    def encode_many(self, texts: Iterable[bytes | None]) -> list[bytes]:
        split = list(map(self.words, texts))
        seen = set().union(*split)
        new = seen.difference(self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = seen
        self._learn(new)
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in split]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def encoded(batches: Iterable[pa.RecordBatch], text_at: int, path: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, their ids) in pieces of about CHUNK_BYTES of text. Null texts are empty."""
    enc = encoder(path)
    for b in batches:
        texts = as_bytes(b.column(text_at))
        begin, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t or b"")
            if held >= CHUNK_BYTES or i + 1 == len(texts):
                yield b.slice(begin, i + 1 - begin), enc.encode_many(texts[begin : i + 1])
                begin, held = i + 1, 0
    enc.cache.clear()  # workers live on, and other operators need the memory


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
