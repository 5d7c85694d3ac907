"""Token ids of whole texts by the tokenizers library, with a bounded memory of words.

The vocabulary splits at white space before anything else, so a text's ids are the ids of its
words in turn; each word is encoded once and kept. Two generations bound the memory: when the young
one is full it becomes the old one, and words in use move over.
"""

from __future__ import annotations

import re
from array import array

from . import shared

KEEP_WORDS = 350_000

#: A run of Latin letters that lower-casing maps one to one, then ASCII marks other than the apostrophe:
#: the vocabulary's own split parts exactly these two.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\\[-`{-~]*)")

#: The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up in turn.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: chr(b) if b in set(_SHOWN) else chr(256 + sum(x not in set(_SHOWN) for x in range(b))) for b in range(256)}


class _Memory(dict):
    """A dictionary that makes what it lacks, and forgets what was not used in the last ``keep`` new keys."""

    def __init__(self, make, keep: int):
        super().__init__()
        self.make, self.keep, self.old = make, keep, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.keep:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """``ids(text)`` equals ``encode(text, add_special_tokens=False).ids`` as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, keep: int = KEEP_WORDS):  # about 150 bytes a word
        shared.os_threads_off()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts, self.words = _Memory(self._part, keep), _Memory(self._word, keep)

    def _part(self, part: str) -> bytes:
        """A run that the vocabulary does not split: straight to its merges."""
        return array("I", [t.id for t in self.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(_ALPHABET))]).tobytes()

    def _word(self, word: bytes) -> bytes:
        s = word.decode("utf-8", "replace")
        if (m := _PLAIN.fullmatch(s)) and "<|" not in s:
            letters, marks = m.groups()
            return (self.parts[letters.lower()] if letters else b"") + (self.parts[marks] if marks else b"")
        return array("I", self.tokenizer.encode(s, add_special_tokens=False).ids).tobytes()

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split()))


def encoded(enc: WordEncoder | ByteEncoder, column):
    """The id bytes of each row of an Arrow string column, in row order."""
    data, offsets = shared.text_buffer(column)
    for a, b in shared.row_groups(offsets):
        texts = (data[offsets[k] : offsets[k + 1]].tobytes() for k in range(a, b))
        yield from enc.many(list(texts)) if isinstance(enc, ByteEncoder) else map(enc.ids, texts)


#: The same letters and marks in UTF-8.
_LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_MARKS = b"".join(bytes([c]) for c in range(33, 127) if chr(c) not in "'" and not chr(c).isalnum())

#: A space between two printable ASCII characters: a byte-level vocabulary splits right before it, whatever stands around.
_GAP = re.compile(rb"(?<=[!-~]) (?=[!-~])")
#: Where a text has one of these, its white space is not single spaces and single line ends between words.
_LOOSE = (b"  ", b" \n", b"\n ", b"\n\n")
_CONTROLS = bytes([9, 11, 12, 13, 28, 29, 30, 31])
_WIDE_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class ByteEncoder:
    """The same for a byte-level vocabulary, which keeps white space: a word takes the space before it along.

    So a tidy text is cut before each single space and each single line end, and every piece is encoded once; other texts are
    cut only where a space stands between two printable ASCII characters. A text that may hold a special token is encoded whole.
    A new piece is taken apart into letters and marks, which are encoded once each.
    """

    LONG = 64

    def __init__(self, path: str, keep: int = KEEP_WORDS):
        shared.os_threads_off()
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.model = self.tokenizer.model
        self.line_end = self._whole(b"\n")
        #: Ids by piece: as it follows a space, or after its own first character where that is a line end or (begin of a text) a return.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        self.pieces = _Memory(self._whole, keep)

    def _whole(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def _learn(self, pieces: set[bytes]) -> None:
        if len(self.young) + len(pieces) > self.keep:
            self.old, self.young = self.young, {}
        young, old, fresh = self.young, self.old, []
        for piece in pieces:
            known = old.get(piece)
            if known is None:
                fresh.append(piece)
            else:
                young[piece] = known
        if len(self.parts) > self.keep:
            self.parts.clear()
        parts, part, line_end = self.parts, self._part, self.line_end
        for piece in fresh:
            lead = piece[:1]
            body = piece[1:] if lead == b"\n" or lead == b"\r" else b" " + piece
            word = body.rstrip(_MARKS)
            letters = word[1:] if word[:1] == b" " else word
            if letters.isalpha() or _LATIN.fullmatch(letters):
                ids = parts.get(word) or part(word)
                if len(word) < len(body):
                    marks = body[len(word) :]
                    ids += parts.get(marks) or part(marks)
            elif not letters and len(body) > len(word):
                ids = parts.get(body) or part(body)
            else:
                ids = self._whole(body)
            young[piece] = line_end + ids if lead == b"\n" else ids

    def _part(self, part: bytes) -> bytes:
        """Letters or marks, which the vocabulary does not split: straight to their merges."""
        if part.isascii():
            shown = part.decode() if part[0] != 32 else _ALPHABET[32] + part[1:].decode()
        else:
            shown = part.decode("latin-1").translate(_ALPHABET)
        self.parts[part] = ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids

    def _tidy(self, text: bytes) -> list[bytes] | None:
        """The pieces of a text whose white space is single spaces and single line ends between words."""
        loose = not text or text[:1] in (b" ", b"\n") or text[-1:] in (b" ", b"\n") or b"<|" in text or any(x in text for x in _LOOSE) or len(text.translate(None, _CONTROLS)) < len(text)
        if loose or (not text.isascii() and _WIDE_SPACE.search(text)):
            return None
        return (b"\r" + text.replace(b"\n", b" \n")).split(b" ")

    def many(self, texts: list[bytes]) -> list[bytes]:
        """``ids`` of each text."""
        cut = [self._tidy(text) for text in texts]
        new: set[bytes] = set()
        for pieces in cut:
            if pieces:
                new.update(pieces)
        self._learn(new.difference(self.young))
        if len(self.young) < len(new):
            self._learn(new.difference(self.young))  # pieces that were known before the memory turned
        known = self.young.__getitem__
        return [b"".join(map(known, pieces)) if pieces else self._loose(text) for text, pieces in zip(texts, cut, strict=True)]

    def _loose(self, text: bytes) -> bytes:
        if b"<|" in text:
            return self._whole(text)
        first, *rest = _GAP.split(text)
        return b"".join(self.pieces[x] if len(x) <= self.LONG else self._whole(x) for x in (first, *(b" " + x for x in rest)))

    def ids(self, text: bytes) -> bytes:
        return self.many([text])[0]


_ENCODERS: dict[tuple[type, str], WordEncoder | ByteEncoder] = {}


def encoder(path: str, kind: type = WordEncoder) -> WordEncoder | ByteEncoder:
    """One encoder for each worker process and vocabulary."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
