"""Token ids of whole texts, fast for prose.

The vocabulary's pre-tokenizer never joins characters across white space, so a
text's ids are its words' ids in a row, and words repeat. Words of plain
letters, digits and punctuation go straight to the BPE model; all others go
through the whole tokenizer. Vocabulary files whose normalizer or split pattern is another
one are used as they are, on whole texts.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

#: Bounds of the per-process caches, in entries.
MAX_WORDS, MAX_PIECES = 400_000, 300_000
# The split pattern of word_bpe_49k.json, restricted to the characters of _PLAIN.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        parts = json.loads(self.whole.to_str())
        first = (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_word = (parts["normalizer"] or {}).get("normalizers") == _NORMALIZERS and first[0].get("pattern") == {"Regex": _SPLIT} and [p["type"] for p in first] == ["Split", "ByteLevel"]
        self.letters = _byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = packed([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))])
            if len(self.pieces) >= MAX_PIECES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode()
        if _PLAIN(word) and "<|" not in word:
            pieces = _PIECE.findall(word.lower())
            ids = self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self._piece, pieces))
        else:
            ids = packed(self.whole.encode(word, add_special_tokens=False).ids)
        if len(raw) <= 64:
            if len(self.words) >= MAX_WORDS:
                self.words.clear()
            self.words[raw] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids, each as a little-endian unsigned 32-bit number."""
        if not self.by_word:
            return packed(self.whole.encode(text, add_special_tokens=False).ids)
        known, miss = self.words.get, self._word
        return b"".join([known(raw) or miss(raw) for raw in text.encode().split()])  # parts at ASCII white space only


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def ids_with_end(text: str | None, path: str, end: int) -> bytes:
    return tokenizer(path).encode(text or "") + packed([end])
