"""Token ids of whole texts by a public tokenizer, at the speed of a word cache.

A tokenizer of the word kind drops white space and never merges across it, so
the ids of a text are the ids of its blank-separated words, one after another.
It also lower-cases, so texts are lower-cased before they are cut into words
wherever that can't change what the tokenizer sees.  A worker remembers the ids
of the words it has met; only a new word reaches the tokenizers library.  The
memory is bounded.
Nothing is approximated - ``tests/llm/test_tokens_packing.py`` holds the ids
against whole-text encoding by the library, for words of all of Unicode.
"""

from __future__ import annotations

import numpy as np

from .common import worker_memory

#: Words in each of the two halves of a worker's memory.
CACHE_WORDS = 600_000
#: A plain word is letters up to this one, each with one lower case, and then marks that can't join
#: a letter.  Every other word is left to the library whole.
_LAST, _TWO_LOWER, _MARKS = "\u017f", "\u0130", b"!\"#$%&()*+,-./:;=?@[]^`{}~"
#: Lower case of A-Z, and the least first byte of UTF-8 from U+0300 on: a mark may join the small letter before it
#: and not the capital one.
_LOWER, _JOINING = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"), 0xCC


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes of Latin-1 stand for themselves, the others for the code
    points from 256 on, in order.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class WordEncoder(dict):
    """Maps a word, in UTF-8, to the little-endian 16-bit ids of its pieces, as bytes.

    New words go into this dictionary; when it is full it becomes the older
    half of the memory, from which words that are met again come back.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if size > 1 << 16:
            raise ValueError("ids of this tokenizer need more than 16 bits")
        self.tokenize = self.tokenizer.model.tokenize
        self.id_bytes = [i.to_bytes(2, "little") for i in range(size)]
        self.letters = dict(zip(range(256), _byte_letters(), strict=True))
        # these are found in a text as it stands, before it is lower-cased
        self.added = [t.content.encode().translate(_LOWER) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks: dict[bytes, bytes] = {}  # runs of punctuation
        self.words = CACHE_WORDS
        self.older: dict[bytes, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.id_bytes[t.id] for t in self.tokenize(spelled)])

    def _marks(self, run: bytes) -> bytes:
        if run not in self.marks:
            if len(self.marks) >= self.words:
                self.marks.clear()
            self.marks[run] = self._piece(run.decode())
        return self.marks[run]

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            stem, plain = word.rstrip(_MARKS), None
            if stem.isalpha():  # letters of ASCII only
                plain = stem.lower()
            elif (letters := stem.decode()).isalpha() and max(letters) <= _LAST and _TWO_LOWER not in letters:
                plain = letters.lower().encode()
            if plain is None:
                ids = b"".join([self.id_bytes[i] for i in self.tokenizer.encode(word.decode(), add_special_tokens=False).ids])
            else:  # most new words are known ones with a capital or a mark
                ids = None if plain == word else self.get(plain) or self.older.get(plain)
                if ids is None:
                    ids = self._piece(plain.decode())
                    self.remember(plain, ids)
                if len(stem) < len(word):
                    ids += self._marks(word[len(stem) :])
        self.remember(word, ids)
        return ids

    def remember(self, word: bytes, ids: bytes) -> None:
        if len(self) >= self.words:
            self.older = dict(self)
            self.clear()
        self[word] = ids

    def encode(self, text: str | None) -> bytes:
        """All ids of a text as little-endian 16-bit integers (null: none)."""
        if not text:
            return b""
        raw = text.encode()
        if raw.isascii() or np.frombuffer(raw, np.uint8).max() < _JOINING:
            lower = raw.translate(_LOWER)
            if not any(token in lower for token in self.added):
                raw = lower
        return b"".join(map(self.__getitem__, raw.split()))  # bytes are split at blanks of ASCII only


def encoder(path: str, words: int | None = None) -> WordEncoder:
    """The encoder of this worker process for a vocabulary file, and how many words it holds from now on."""
    held = worker_memory("tokens")
    if path not in held:
        held[path] = WordEncoder(path)
    held[path].words = words or CACHE_WORDS
    return held[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
