import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidepool.llm import wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def _same(rows, texts):
    library = Tokenizer.from_file(PATH)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids, ascii((texts[r.doc_id] or "")[:80])
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("chars", [1, 100_000, 1 << 24])
def test_whole_table_against_the_library(real, chars):
    rows = wordbpe.encode_and_decode(real, PATH, block_chars=chars).collect()
    assert len(rows) == real.count()
    _same(rows, {r.doc_id: r.text for r in real.collect()})


def test_odd_texts(docs):
    texts = [
        None, "", " ", "x² ½ ⅷ a\x1cb", "Σίσυφος ΑΣ", "é é <|endoftext|> İstanbul ﷺ ٣٤ नमस्ते 日本語 一二 _a_b '' don't ''s I'LL x y", "a\x85b\u200bc\ufeff\u00a0d\u3000e",
        "<|STARTOFTEXT|> <|startoftext|>x<|endoftext|><|endoftext|>", "word " * 5000, "q" * 3000, "🙂👩‍👩‍👧", "same text", "same text",
    ]
    for chars in (1, 1 << 24):
        rows = wordbpe.encode_and_decode(docs([*enumerate(texts), (12, "same text")]), PATH, block_chars=chars).collect()
        assert len(rows) == len(texts) + 1
        _same(rows, dict(enumerate(texts)))


def test_all_code_points(docs):
    """Also those that only one side's Unicode tables know; surrogates aren't text."""
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b{chr(c)}" for c in points[i : i + 256]) for i in range(0, len(points), 256)]
    rows = wordbpe.encode_and_decode(docs(list(enumerate(texts))), PATH).collect()
    assert len(rows) == len(texts)
    _same(rows, dict(enumerate(texts)))


def test_repeated_ids_and_clashing_names(spark):
    rows = [(1, "rare one", 5, "k"), (1, "rare two words", 6, "k"), (1, "rare two words", 7, "k"), (None, "x rare", 8, "k"), (None, "y rarer", 9, "k"), (2, None, 1, "k")]
    table = spark.createDataFrame(rows, "doc_id long, text string, at int, key string")
    library = Tokenizer.from_file(PATH)
    for chars in (1, 1 << 24):
        got = sorted((str(r.doc_id), r.ids, r.decoded) for r in wordbpe.encode_and_decode(table, PATH, block_chars=chars).collect())
        ids = [(str(d), library.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in rows]
        assert got == sorted((d, i, library.decode(i, skip_special_tokens=False)) for d, i in ids)


def test_empty_and_null_ids(docs):
    assert wordbpe.encode_and_decode(docs([]), PATH).collect() == []
    assert [r.doc_id for r in wordbpe.encode_and_decode(docs([(None, "a b")]), PATH).collect()] == [None]
