"""Token counts by rank-synchronous merging of ragged arrays (operator 6).

Texts are cut into pre-tokens. Those a worker has not met are merged together: their
symbols lie in one flat array, sequence after sequence; each round every sequence finds
its lowest-rank pair and replaces all its occurrences at once, until no pair of any
sequence has a rank. What counts is how many symbols are left.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarry.llm.common import id_and_text, local_file, ship_file
from quarry.llm.word_tokens import byte_symbols

NO_RANK = np.int64(1 << 40)
#: Pre-tokens that a worker keeps, and characters of text whose new pre-tokens are merged together.
PIECES_KEPT, CHUNK_CHARS = 500_000, 4_000_000

#: The part of a file that says it is byte-level.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: The byte-level pre-token pattern, for any text and for Latin-1 alone.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
ANY_TEXT = regex.compile(rf"{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\p{{White_Space}}\p{{L}}\p{{N}}]+|\p{{White_Space}}+(?!\P{{White_Space}})|\p{{White_Space}}+")
L, N, S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\x09-\x0D\x20\x85\xa0"
LATIN_TEXT = re.compile(rf"{CONTRACTIONS}| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+")
BEYOND_LATIN = re.compile(r"[^\x00-\xff]")


class PieceCounter:
    """Number of symbols of each pre-token under one byte-level vocabulary."""

    def __init__(self, path: str):
        with open(local_file(path), encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"] != PRE_TOKENIZER or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("the vocabulary is not a plain byte-level one")
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.byte_ids = np.array([vocab[x] for x in byte_symbols()], np.int64)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)

    def merge(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty piece."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = lengths.copy()
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        while len(symbols) > 1:
            rank = self.rank(symbols[:-1], symbols[1:])
            rank[owner[:-1] != owner[1:]] = NO_RANK
            starts = np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0]
            least = np.minimum.reduceat(np.r_[rank, NO_RANK], starts)
            live = least < NO_RANK
            if not live.any():
                break
            sizes = np.diff(np.r_[starts, len(symbols)])
            keep, target = np.repeat(live, sizes), np.repeat(least, sizes)
            hit = np.r_[rank == target[:-1], False] & keep
            # of overlapping hits (a a a) every other one counts, from the left
            run_start = hit & ~np.r_[False, hit[:-1]]
            place = np.arange(len(hit))
            hit &= (place - np.maximum.accumulate(np.where(run_start, place, 0))) % 2 == 0
            symbols[hit] = self.made[target[hit]]
            keep[1:] &= ~hit[:-1]
            counts -= np.bincount(owner[hit], minlength=len(counts))
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def pieces(self, text: str) -> list[str]:
        return (ANY_TEXT if BEYOND_LATIN.search(text) else LATIN_TEXT).findall(text)

    def count(self, texts: list[str]) -> list[int]:
        """Numbers of tokens of a bounded number of texts."""
        cut, extra = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            extra.append(len(parts) - 1)
            cut.append([piece for part in parts for piece in self.pieces(part)])
        new = list(set().union(*cut).difference(self.known))
        if new:
            self.known.update(zip(new, self.merge([x.encode("utf-8") for x in new]).tolist()))
        out = [sum(map(self.known.__getitem__, own)) + e for own, e in zip(cut, extra)]
        if len(self.known) > PIECES_KEPT:
            for piece in new:
                del self.known[piece]
        return out


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


COUNTED = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
COUNTED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text; one row per row of ``docs``, nothing is shuffled.

    A null text is empty: no bytes, no tokens. Null ids and repeated rows pass through. An empty
    table gives no rows; other columns are not read. A text is held whole with its pieces.
    """

    ship_file(docs.sparkSession, tokenizer_path)

    def chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc_id)
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= CHUNK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(tokenizer_path)
        for batch in batches:
            for ids, texts in chunks(batch):
                n = counter.count(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=COUNTED_ARROW)

    return id_and_text(docs, id_col, text_col).mapInArrow(count, COUNTED)
