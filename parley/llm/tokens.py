"""Token ids of whole texts, with a cache of word encodings.

Tokenizers of which white space only separates words (the file's normaliser and splitter drop it) give a
text the ids of its words one after another.  So texts are cut at blanks and line ends, and each distinct
word is encoded once for each worker.  A word of letters and closing marks, by far the most common form,
goes to the merge model directly: lower-cased, its UTF-8 bytes written in the byte alphabet, letters and
marks apart.  Any other word (marks of special tokens too) goes through the whole
tokenizer, and so does any text if white space means something to the tokenizer.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable

_MOST = 300_000
_PLAIN = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")


def _byte_alphabet() -> dict[int, str]:
    """Byte to character: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ALPHABET = _byte_alphabet()


class _Words(dict):
    """Ids of words as bytes; a word that is missing is encoded."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__({"": b""})
        self._encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self._encode(word)
        return ids


class WordEncoder:
    """Encodes texts word by word; ``ids`` are little-endian unsigned 32-bit."""

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self.size = self._tokenizer.get_vocab_size()
        # Whether white space only separates words for this tokenizer; if not, texts are encoded whole.
        one, words = (self._tokenizer.encode(t, add_special_tokens=False).ids for t in ("ab cd\nef", "ab"))
        self._by_word = one == words + [i for w in ("cd", "ef") for i in self._tokenizer.encode(w, add_special_tokens=False).ids]
        self._known = _Words(self._word)
        self._marks = _Words(self._part)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """The encoder of this worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes, as ``encode(text, add_special_tokens=False)`` gives them; null counts as empty."""
        if not self._by_word:
            return [array("I", self._tokenizer.encode(t or "", add_special_tokens=False).ids).tobytes() for t in texts]
        out = []
        for text in texts:
            for cache in (self._known, self._marks):
                if len(cache) > _MOST:
                    cache.clear()
                    cache[""] = b""
            out.append(b"".join(map(self._known.__getitem__, text.replace("\n", " ").split(" "))) if text else b"")
        return out

    def _word(self, word: str) -> bytes:
        letters, marks = word, ""
        if not (word.isascii() and word.isalpha()):
            plain = _PLAIN.fullmatch(word)
            if not plain or not (word.isascii() or self._lowers_by_character(plain[1])):
                return array("I", self._tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
            letters, marks = plain[1], plain[2]
        low = letters.lower()
        return self._part(low) if low == word else self._known[low] + self._marks[marks]

    @staticmethod
    def _lowers_by_character(letters: str) -> bool:
        """Whether lower() and normalisation change nothing that depends on neighbours, and all are letters."""
        return letters.isalpha() and unicodedata.is_normalized("NFC", letters) and "\u03a3" not in letters and "\u0130" not in letters

    def _part(self, part: str) -> bytes:
        """Ids of a run of letters or of marks, already lower-cased."""
        written = part if part.isascii() else "".join(map(_ALPHABET.__getitem__, part.encode()))
        return array("I", [t.id for t in self._model.tokenize(written)]).tobytes()


def default_path() -> str:
    """Where the environment keeps the word BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
