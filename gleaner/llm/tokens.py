"""Token ids of texts by a public tokenizer, with caches for words and pieces.

A file of the ``tokenizers`` library gives the vocabulary, the pre-tokenizer and the merges. Most pieces of a
corpus come again and again, so a worker keeps the ids of pieces it has met. A text of Latin letters and the usual signs
is split into pieces as the file's pattern would split it; new ones go to the file's own model. Any other text is cut into
words, whose ids are kept, too: a word of a simple form (runs of letters, punctuation, single newlines) is split in the same way,
everything else goes to the whole tokenizer. All caches are bounded.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import threading
import time
from array import array
from codecs import charmap_decode
from collections.abc import Callable, Iterator

import numpy as np

from . import common
from .common import pieces

#: Entries in the young half of each cache; a full one becomes the old half, from which what is met again comes back.
CACHE = 250_000
#: Seconds without work after which the caches are emptied.
IDLE = 4.0

_SIMPLE = re.compile(r"[^\W\d_]+|[^\w\s]+|\n")
_AWKWARD = re.compile(r"[\d_']|\n\n|^\n|[^\S\n]")
_LOOSE_SPACE = re.compile(r" \s")
_BREAKS = re.compile(r"[ \t\r\n]+")
_LOADED: dict[str, "Encoder"] = {}

#: Letters up to U+017F. Texts without an odd character have no other letters, no numbers but 0-9, only these four blanks, and
#: are in normal form C; lower case is by character.
_LETTERS, _BLANKS = "A-Za-zªµºÀ-ÖØ-öø-\u017f", " \t\r\n"
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0²³¹¼-¾\u0180-\u200f\u2028-\u202f\u205f-\U0010ffff]")
_GAP = re.compile(f"(?<=[^{_BLANKS}]) (?=[^{_BLANKS}])")
_SHORT = "'(?:[stmd]|re|ve|ll)"
#: For texts without odd characters, the patterns of the two families.
_SPACED = re.compile(f"{_SHORT}| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_LETTERS}0-9{_BLANKS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+")
_FOLDED = re.compile(f"{_SHORT}|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9{_BLANKS}]+")
_FOLDED_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_FOLDED_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def _visible() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


_ALPHABET = "".join(_visible()[b] for b in range(256))


class Pieces(dict):
    """The young half of a cache: pieces to their ids as bytes. What isn't there comes from the old half or the model."""

    def __init__(self, tokenize: Callable, coded: list[bytes], old: dict[str, bytes]):
        self.tokenize, self.coded, self.old = tokenize, coded, old

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            coded = self.coded
            found = b"".join([coded[t.id] for t in self.tokenize(charmap_decode(piece.encode(), "strict", _ALPHABET)[0])])
        self[piece] = found
        return found


def _chunks(text: str) -> Iterator[str]:
    """A text in parts of about PIECE characters, cut before single spaces."""
    at = 0
    while len(text) - at > common.PIECE:
        gap = _GAP.search(text, at + common.PIECE)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:] if at else text


class Encoder:
    """Ids of whole texts as numpy arrays, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Strings of special tokens in a text are ordinary text. Null counts as empty.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = self.whole.get_vocab_size()
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        before = json.dumps(spec.get("pre_tokenizer"))
        # Two families can be cut into words beforehand; any other file takes the whole tokenizer for whole texts.
        self.spaced = spec.get("normalizer") is None and '"ByteLevel"' in before and '"use_regex": true' in before and '"add_prefix_space": false' in before
        self.folded = '"Replace"' in json.dumps(spec.get("normalizer")) and '"Removed"' in before
        exact = self.folded and spec["normalizer"].get("normalizers") == _FOLDED_NORMALIZER and json.dumps(_FOLDED_SPLIT) in before
        self.split = _SPACED.findall if self.spaced else _FOLDED.findall if exact else None
        self.coded = [self._pack([i]) for i in range(self.size)]
        self.words: dict[str, bytes]
        self.old_words: dict[str, bytes]
        self.pieces: Pieces
        self.forget()
        self.used = time.monotonic()

    def forget(self) -> None:
        self.words, self.old_words, self.pieces = {}, {}, Pieces(self.model.tokenize, self.coded, {})

    def _pack(self, ids: list[int]) -> bytes:
        return array("H" if self.kind.itemsize == 2 else "I", ids).tobytes()

    def _slow(self, text: str) -> bytes:
        return self._pack(self.whole.encode(text, add_special_tokens=False).ids)

    def _turn(self) -> None:
        """A full cache of pieces becomes the old half."""
        if len(self.pieces) >= CACHE:
            self.pieces.old = {}
            self.pieces = Pieces(self.model.tokenize, self.coded, self.pieces)

    def _word(self, word: str) -> bytes:
        """Ids of a word: with a space before it if words carry their space, else without."""
        body, last = (word, "") if word.isalpha() else (word[:-1], word[-1:])
        if body.isalpha() and (not last or last in ".,!"):
            if self.spaced:
                body = " " + body
            else:
                body = body.lower() if body.isascii() else self.whole.normalizer.normalize_str(body)
            if self.spaced or body.isalpha():
                found = self.pieces[body]
                return found + self.pieces[last] if last else found
        if self.folded:
            if _AWKWARD.search(word) or "\n" in word:
                return self._slow(word)
            word = word.lower() if word.isascii() else self.whole.normalizer.normalize_str(word)
        elif _AWKWARD.search(word) or not word:
            return self._slow(" " + word)
        parts = _SIMPLE.findall(word)
        if not word.isascii() and ("".join(parts) != word or any(p[0].isalnum() and not p.isalpha() for p in parts)):
            return self._slow(word if self.folded else " " + word)
        if self.spaced:
            parts[0] = " " + parts[0]
        return b"".join(map(self.pieces.__getitem__, parts))

    def ids(self, text: str | None) -> np.ndarray:
        self.used = time.monotonic()
        if not text:
            return np.empty(0, self.kind)
        if self.split and not _ODD.search(text):
            parts = []
            for part in _chunks(text.lower() if self.folded else text):
                self._turn()
                parts += map(self.pieces.__getitem__, self.split(part))
            return np.frombuffer(b"".join(parts), self.kind)
        if self.spaced and not _LOOSE_SPACE.search(text):
            parts = []
            for piece in pieces(text, " "):
                words = piece.split(" ")
                if not parts:  # the first word has no space before it
                    parts.append(self._slow(words[0]) if words[0] else b"")
                    del words[0]
                parts.append(self._words(words))
            return np.frombuffer(b"".join(parts), self.kind)
        if self.folded:
            return np.frombuffer(b"".join(self._words([w for w in _BREAKS.split(piece) if w]) for piece in pieces(text, " ")), self.kind)
        return np.frombuffer(self._slow(text), self.kind)

    def _words(self, words: list[str]) -> bytes:
        self._turn()
        if len(self.words) >= CACHE:
            self.old_words, self.words = self.words, {}
        out = list(map(self.words.get, words))
        if None in out:
            for i, found in enumerate(out):
                if found is None:
                    word = words[i]
                    found = self.words.get(word)
                    if found is None:
                        found = self.words[word] = self.old_words.get(word) or self._word(word)
                    out[i] = found
        return b"".join(out)


def _trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    import ctypes

    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _watch(coder: Encoder) -> None:
    """Workers outlive the steps that encode: give the caches' memory back when nothing has been encoded for a while."""
    while True:
        time.sleep(IDLE)
        if (coder.words or coder.pieces) and time.monotonic() - coder.used > IDLE:
            coder.forget()
            _trim()


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
        threading.Thread(target=_watch, args=(_LOADED[path],), daemon=True).start()
    return _LOADED[path]


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
