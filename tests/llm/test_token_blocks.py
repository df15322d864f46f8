import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm.token_blocks import decode_segment, encode_segment, token_blocks
from quarry.llm.word_tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " \t\n", "a\x1cb c\x85d\xa0e <|endoftext|>x", "Don't I'LL 12.5%!'s", "É́ İstanbul ΣΑΣ ́x \x00y\x7f", "ﬁne ①②x２ Ⅷ'S a'rE x<|ENDoftext|>", "¿qué? ß×÷ a\xadb ÑÑ'S 日本語 😀!!"]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
@pytest.mark.parametrize("high", [1, 2, 300, 49408, 2**32 - 1])
def test_segment_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint32)
    assert (decode_segment(encode_segment(ids)) == ids).all()


def test_word_encoder_equals_library():
    library, own = Tokenizer.from_file(PATH), WordEncoder(PATH)
    for text in [*ODD, *(a + b for a in ODD for b in ODD)]:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_another_file_goes_through_the_library(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["normalizer"]["normalizers"].pop()  # upper case stays
    spec["truncation"] = {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}
    path = str(tmp_path / "other.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    library, own = Tokenizer.from_file(path), WordEncoder(path)
    library.no_truncation()
    for text in [*ODD, "Upper CASE words Stay as They are"]:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert not own.by_words and WordEncoder(PATH).by_words


def test_against_library(spark):
    texts = [*ODD, None, "word " * 30_000, "same", "same"]
    rows = [(None if i == 3 else i * 7 % 11, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = sorted(map(tuple, token_blocks(docs, PATH).collect()), key=lambda r: r[1])
    library, want, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert token_blocks(docs.limit(0), PATH).count() == 0
