"""Pre-tokenisation and merge rules of a public word-end BPE vocabulary.

The vocabulary file stays outside the repository; its place is a parameter. `WordSplitter`
reproduces the file's normaliser and splitter (NFC, white space to one blank, lower case per
code point, then contractions, letter runs, single digits and symbol runs), so that the ids of
a text are the concatenated ids of its words. The Unicode tables of this interpreter and of the
tokenizers library differ in places; outside blocks where they are known to agree, nothing is
guessed: such a text is split by the library itself.
"""

from __future__ import annotations

import json
import re
import unicodedata

import regex

SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\p{Z}\p{L}\p{N}]+")
#: Code points beyond the blocks on which both Unicode tables agree.
UNSURE = re.compile("[^\\x00-\u0557\u0591-\u05c7\u0600-\u06ff\u0900-\u097f\u0e01-\u0e3a\u2000-\u206f\u20a0-\u20bf\u2190-\u23ff\u2500-\u27bf\u3040-\u3096\u30a0-\u30ff\u4e00-\u9fef\uac00-\ud7a3\uff01-\uff5e\U0001f300-\U0001f64f]")
#: Latin text without odd separators and number forms, for which the built-in engine's classes are the splitter's.
NOT_PLAIN = re.compile("[^\\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")
PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def default_vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte value: visible Latin-1 stays itself, the rest is shifted past 255 in order."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, shifted = {b: chr(b) for b in visible}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + shifted)
            shifted += 1
    return [out[b] for b in range(256)]


class WordSplitter:
    """words(text): the vocabulary's words of a text in order, special tokens as they stand in it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._mark = min((s[:2] for s in self.special), default=None)
        self._library = None

    def _plain(self, text: str) -> list[str]:
        if not NOT_PLAIN.search(text):
            return PLAIN_SPLIT.findall(unicodedata.normalize("NFC", text).lower())
        if UNSURE.search(text):
            return self._by_library(text)
        return SPLIT.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _by_library(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._bytes = {c: b for b, c in enumerate(byte_alphabet())}
        parts = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(self._bytes[c] for c in word).decode("utf-8", "surrogateescape") for word, _ in parts]

    def words(self, text: str) -> list[str]:
        if self._mark is None or self._mark not in text:
            return self._plain(text)
        out: list[str] = []
        for part in self._special.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self._plain(part)
        return out


class Memo(dict):
    """key -> make(key), remembered for at most `most` keys: when it is full, it starts anew."""

    def __init__(self, make, most: int = 800_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class LibraryWords:
    """Ids of single words, merged exactly by the tokenizers library's own model without its per-text overhead; tokens of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self._model, self._alphabet = whole.model, byte_alphabet()
        self.splitter = WordSplitter(path)
        self.token = {i: t for t, i in whole.get_vocab(with_added_tokens=True).items()}

    def ids(self, word: str) -> list[int]:
        if word in self.splitter.special:
            return [self.splitter.special[word]]
        return [t.id for t in self._model.tokenize("".join(self._alphabet[b] for b in word.encode("utf-8", "surrogateescape")))]
