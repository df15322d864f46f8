import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm.token_counts import PieceCounter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " \t\n", "a\x1cb c\x85d\xa0e <|endoftext|>x", "Don't I'LL 12.5%!'s", "É́ İstanbul ΣΑΣ \x00y\x7f", "ﬁne ①②x２ Ⅷ  \n\n x   ", "aaaaaaaaaaa aaaaaaa!!!!!!!  x ​ \x1c", "日本語 😀!!   ½²"]


def test_counts_equal_library():
    library = Tokenizer.from_file(PATH)
    texts = [*ODD, *(a + b for a in ODD for b in ODD), "x" * 5000, "thequickbrown" * 300]
    assert PieceCounter(PATH).count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_documents(spark):
    library = Tokenizer.from_file(PATH)
    texts = [*ODD, None, "word " * 60_000, "same", "same"]
    rows = [(None if i == 2 else i % 9, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long")
    got = sorted(map(tuple, token_counts(docs, PATH).collect()), key=str)
    count = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert got == sorted(((i, len((t or "").encode()), n, n > 1024) for (i, t, _), n in zip(rows, count)), key=str)
    assert token_counts(docs.limit(0), PATH).count() == 0


def test_another_file_is_refused():
    with pytest.raises(ValueError):
        PieceCounter(public_tokenizers.path("word_bpe_49k.json"))
