"""Token ids of whole texts from a word-level BPE file, through the tokenizers library.

The vocabulary drops white space, so the ids of a text are the ids of its words one
after the other. Words repeat, so each Python worker remembers the ids of words it has
met; every other word goes through the library. That rests on how the file cuts words: with
a file of another normaliser or pattern every whole text goes through the library.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np

from quarry.llm.common import local_file

#: The parts of a file under which words can be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: How the vocabulary's own pattern reads on words of printable Latin-1
#: characters, which Unicode's NFC form leaves as they are.
LETTERS, NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
LATIN_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}\x20\x09-\x0D]+")
NOT_LATIN = re.compile(r"[^\x20\x09-\x0D!-~\xa1-\xff]|<\|")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


SYMBOLS = byte_symbols()
#: Entries that a worker keeps of pieces and of other words; beyond them it encodes anew.
PIECES_KEPT, WORDS_KEPT = 500_000, 50_000


class WordEncoder(dict):
    """piece (lower-case Latin-1 text) -> its ids as little-endian 16-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        path = local_file(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec["added_tokens"])
        self.by_words = special and spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER and spec["post_processor"] is None and self.tokenizer.get_vocab_size() <= 1 << 16
        self.model = self.tokenizer.model
        self.words: dict[bytes, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join([SYMBOLS[b] for b in piece.encode("utf-8")])
        found = [t.id for t in self.model.tokenize(shown)]
        ids = struct.pack(f"<{len(found)}H", *found)
        if len(self) < PIECES_KEPT:
            self[piece] = ids
        return ids

    def other_word(self, word: bytes) -> bytes:
        """Ids of a word that may hold any character or a special token's string."""
        ids = self.words.get(word)
        if ids is None:
            text = word.decode("utf-8")
            if NOT_LATIN.search(text):
                found = self.tokenizer.encode(text, add_special_tokens=False).ids
                ids = struct.pack(f"<{len(found)}H", *found)
            else:
                ids = b"".join(map(self.__getitem__, LATIN_PIECES.findall(text.lower())))
            if len(self.words) < WORDS_KEPT:
                self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if not self.by_words:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if NOT_LATIN.search(text):
            parts = map(self.other_word, text.encode("utf-8").split())
        else:
            parts = map(self.__getitem__, LATIN_PIECES.findall(text.lower()))
        return np.frombuffer(b"".join(parts), "<u2")


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder a worker, built on first use."""
    return WordEncoder(path)
