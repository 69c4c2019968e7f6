"""Encoding with the tokenizers library, word by word with a bounded memory of words.

The vocabularies meant here (lower-cased BPE that drops white space) never join characters across white space, so a
text's ids are those of its space-separated words in a row. A word met before costs one look-up.
"""

from __future__ import annotations

import re
import struct
import unicodedata

_KINDS: dict[tuple[str, int], WordIds] = {}
_WORD = re.compile(r"([^\W\d_]+)([.,!?;:%&$*#|+=/()-]*)")


def _byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE: itself if printable, else the next free code point from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SHOWN = _byte_characters()


class WordIds(dict):
    """word (bytes, A-Z lower-cased) -> its ids as little-endian unsigned 32-bit integers; keeps ``most`` words."""

    def __init__(self, path: str, most: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode(errors="replace")
        m = _WORD.fullmatch(text)
        if m and text == text.lower() and m[1].isalpha() and unicodedata.is_normalized("NFC", text):
            # one run of letters, then maybe one of signs: what the pre-tokenizer would cut, without its bookkeeping
            ids = [t.id for part in m.groups() if part for t in self.model.tokenize(part.encode().decode("latin-1").translate(_SHOWN))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self.most:
            self[word] = found
        return found


def encoder(path: str, most_words: int = 600_000):
    """text -> bytes of its ids. One memory of words for each Python worker, kept from task to task."""
    known = _KINDS.get((path, most_words)) or _KINDS.setdefault((path, most_words), WordIds(path, most_words))
    at = known.__getitem__
    return lambda text: b"".join(map(at, (text or "").encode(errors="replace").lower().split()))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
