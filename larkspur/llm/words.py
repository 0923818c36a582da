"""Pre-tokens of the word-end BPE vocabulary, exactly as the tokenizers library cuts them.

Texts of characters below U+0300 (without U+0130) take a regular expression: there NFC changes nothing, lower-casing is
one character at a time in either library, and the classes below come from the Unicode categories.  Any other text goes
through the library's own normaliser and pre-tokeniser.
"""

from __future__ import annotations

import re
import unicodedata

import public_tokenizers
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import kept

VOCABULARY = "word_bpe_49k.json"
_LOW = [chr(c) for c in range(0x300)]
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"


def _class(chars: list[str]) -> str:
    return "".join(re.escape(c) for c in chars)


_LETTER = _class([c for c in _LOW if unicodedata.category(c)[0] == "L"])
_NUMBER = _class([c for c in _LOW if unicodedata.category(c)[0] == "N"])
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_class(list(_SPACE))}{_LETTER}{_NUMBER}]+")
#: Words of a lower-case text below U+0300.
PLAIN = _WORDS.findall
_ODD = re.compile("[^\x00-˿]|İ")


def default_path() -> str:
    return public_tokenizers.path(VOCABULARY)


class WordTokenizer:
    """Splits texts into pre-tokens and encodes one pre-token at a time; concatenated, that is the library's encoding."""

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        # the model alone, for words that are already normalised and cut
        self.one = Tokenizer(self.whole.model)
        self.one.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")")
        self.pieces = [self.whole.id_to_token(i) or "" for i in range(self.whole.get_vocab_size(with_added_tokens=True))]

    def _split(self, text: str) -> list[str]:
        if _ODD.search(text) is None:
            return _WORDS.findall(text.lower())
        normal = self.whole.normalizer.normalize_str(text)
        out = []
        # offsets refer to the normalised string; the library's pieces are byte-level, so the offsets are what is used
        for _, (start, end) in self.whole.pre_tokenizer.pre_tokenize_str(normal):
            out.append(normal[start:end])
        return out

    def words(self, text: str | None) -> list[str]:
        """Pre-tokens of ``text`` in order; special strings stand for themselves."""
        if not text:
            return []
        if "<|" in text and self.cut.search(text):
            out: list[str] = []
            for part in self.cut.split(text):
                if part in self.special:
                    out.append(part)
                elif part:
                    out += self._split(part)
            return out
        return self._split(text)

    def encode(self, words: list[str]) -> list[list[int]]:
        encoded = [e.ids for e in self.one.encode_batch(words, add_special_tokens=False)]
        for i, word in enumerate(words):
            if word in self.special:
                encoded[i] = [self.special[word]]
        return encoded

    def length(self, word: str) -> int:
        """Tokens of one pre-token."""
        return 1 if word in self.special else len(self.one.encode(word, add_special_tokens=False))


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process."""
    return kept(("tokenizer", path), lambda: WordTokenizer(path))
