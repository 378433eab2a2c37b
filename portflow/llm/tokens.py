"""Byte-level BPE ids of whole texts by the tokenizers library, fast on repeated words.

The library splits a text by a fixed pattern and merges each piece by itself, so a piece's ids do not depend on its
surroundings. A worker remembers the ids of the pieces it met last (two generations of ``MEMO``) and has the library's
merge model encode only the others. A text that holds the content of an added token (such as
``<|endoftext|>``, which the library takes out before it splits) goes to the library's own ``encode`` as a whole.
"""

from __future__ import annotations

import re
from array import array

MEMO = 400_000  # some 200 MB

# The split pattern of the tokenizer's pre-tokenizer (letters, digits, other signs, white space).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same pattern for texts of ASCII and Latin letters only, for the faster standard module; words and numbers, which no
# other alternative can start, are tried first.
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
_PLAIN = rf""" ?[{_LATIN}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+"""
_OTHER = re.compile(rf"[^\x09-\x0d\x20-\x7e{_LATIN}¿¡«»–—‘’“”…]")
# The byte-level alphabet: printable bytes stand for themselves, the others, in order, for characters from 256 on.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _KEPT)}
_SPACE_CHAR = chr(_BYTE_CHARS[32])


class _Memo(dict):
    """Ids (little-endian unsigned 32-bit, as bytes) of pieces; encodes what it lacks. Two generations of ``most`` pieces:
    when one is full it becomes the older one, and the pieces that are met again move on from there."""

    def __init__(self, merge, most: int):
        super().__init__()
        self.merge, self.most, self.older = merge, most, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            plain = piece.isascii() and piece.isprintable()  # of these only the space has another character
            shown = piece.replace(" ", _SPACE_CHAR) if plain else piece.encode().decode("latin-1").translate(_BYTE_CHARS)
            out = array("I", [t.id for t in self.merge(shown)]).tobytes()
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = out
        return out


class WordMemoEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids (as bytes). A null text is empty."""

    def __init__(self, path: str, memo: int = MEMO):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.get = _Memo(self.tok.model.tokenize, memo).__getitem__
        self.any = regex.compile(PATTERN).findall
        self.plain = re.compile(_PLAIN).findall

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if any(a in text for a in self.added):
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.get, (self.any if _OTHER.search(text) else self.plain)(text)))


_encoders: dict[str, WordMemoEncoder] = {}


def encoder(path: str, memo: int = MEMO) -> WordMemoEncoder:
    """One encoder a worker process and vocabulary file; ``memo``: pieces of a generation, if it has to be made."""
    if path not in _encoders:
        _encoders[path] = WordMemoEncoder(path, memo)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
