"""Token ids of whole texts, exactly as the ``tokenizers`` library gives them.

The library spends nearly all its time on words it has met before. The encoders here cut texts
into the same pre-tokens with a compiled pattern and ask the library once for each distinct
pre-token. That is exact where cutting is known to agree: for texts in ``ALPHABET`` without the
strings of special tokens. Any other text goes to the library whole.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from itertools import chain

import numpy as np

#: Characters for which the pattern's letter, digit and space classes agree with the library's,
#: and which its normalizer leaves alone but for simple lower-casing. Tests go through all of them.
ALPHABET = [
    chr(c)
    for c in chain([9, 10, 13], range(0x20, 0x7F), range(0xA0, 0x130), range(0x131, 0x149), range(0x14A, 0x180), range(0x2010, 0x2028), range(0x2030, 0x205F), range(0x20A0, 0x20C0))
]


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in ALPHABET if unicodedata.category(c)[0] == kind)


_LETTER, _DIGIT = _class("L"), _class("N")
_FOREIGN = re.compile(f"[^{''.join(re.escape(c) for c in ALPHABET)}]|<\\|")
_WORD_PIECES = re.compile(f"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_DIGIT}]|[^\\s{_LETTER}{_DIGIT}]+")
_BYTE_PIECES = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\\s{_LETTER}{_DIGIT}]+|\\s+(?!\\S)|\\s+"
)
#: Distinct pre-tokens kept by a Python worker; beyond it, further ones are encoded each time.
MEMO = 500_000


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level vocabularies: visible Latin-1 characters for
    themselves, the other bytes in order for the characters from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Memo(dict):
    """Piece to little-endian unsigned 32-bit ids, by the library's model alone: a piece needs no more cutting."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model = tokenizer.model

    def __missing__(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(_LETTERS)
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])
        if len(self) < MEMO:
            self[piece] = ids
        return ids


class Encoder:
    """``ids(text)``: the text's ids, as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = _Memo(self.tokenizer)
        self.lower = False
        self.pieces = None
        if self._cuts_like("word"):
            self.lower, self.pieces = True, _WORD_PIECES
        elif self._cuts_like("byte"):
            self.pieces = _BYTE_PIECES

    def _cuts_like(self, kind: str) -> bool:
        """Does the tokenizer's own set-up equal the one the pattern was written for?"""
        normal, pre = str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer)
        if kind == "word":
            return (
                normal == r'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])'
                and r"""Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True""" in pre
                and "use_regex=False" in pre
            )
        return normal == "None" and pre == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.pieces is None or _FOREIGN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        found = self.pieces.findall(text.lower() if self.lower else text)
        return b"".join(map(self.memo.__getitem__, found))

    def count(self, text: str | None) -> int:
        return len(self.ids(text)) // 4


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path)
