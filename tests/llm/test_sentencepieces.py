import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from tidepool.llm import sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def _same(rows, texts):
    library = SentencePieceProcessor(model_file=PATH)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "")
        assert r.ids == ids, ascii((texts[r.doc_id] or "")[:80])
        assert r.decoded == library.decode(ids)


@pytest.mark.parametrize("chars", [1, 100_000, 1 << 24])
def test_whole_table_against_the_library(real, chars):
    rows = sentencepieces.encode_and_decode(real, PATH, block_chars=chars).collect()
    assert len(rows) == real.count()
    _same(rows, {r.doc_id: r.text for r in real.collect()})


def test_odd_texts(docs):
    texts = [
        None, "", " ", "  ", "a", " a", "a ", "  a  b  ", "a\tb\n c", "▁a▁▁b ▁", "é é ﬁ 　x", "<s> </s><unk><0x0A>", "\x00a", "a​b",
        " " * 40, "x" * 20_000, "word " * 20_000, "日本語 日本語", "🙂👩‍👩‍👧 \U0001f9ff", "same text", "same text", "\n" * 50, "1234567 89",
    ]
    for chars in (1, 1 << 24):
        rows = sentencepieces.encode_and_decode(docs([*enumerate(texts), (19, "same text")]), PATH, block_chars=chars).collect()
        assert len(rows) == len(texts) + 1
        _same(rows, dict(enumerate(texts)))


def test_all_code_points(docs):
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b{chr(c)}" for c in points[i : i + 256]) for i in range(0, len(points), 256)]
    _same(sentencepieces.encode_and_decode(docs(list(enumerate(texts))), PATH).collect(), dict(enumerate(texts)))


def test_repeated_ids_clashing_names_and_empty_tables(spark, docs):
    rows = [(1, "rare one", 5, "k"), (1, "rare two words", 6, "k"), (1, "rare two words", 7, "k"), (None, "x rare", 8, "k"), (2, None, 1, "k")]
    table = spark.createDataFrame(rows, "doc_id long, text string, block int, word string")
    library = SentencePieceProcessor(model_file=PATH)
    got = sorted((str(r.doc_id), r.ids, r.decoded) for r in sentencepieces.encode_and_decode(table, PATH).collect())
    assert got == sorted((str(d), library.encode(t or ""), t or "") for d, t, *_ in rows)
    assert sentencepieces.encode_and_decode(docs([]), PATH).collect() == []
    assert [tuple(r) for r in sentencepieces.encode_and_decode(docs([(None, None)]), PATH).collect()] == [(None, [], "")]


def test_refuses_models_whose_pieces_cross_markers(monkeypatch):
    class Crossing:
        is_byte = is_control = is_unknown = lambda self, i: False

        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "of▁the"

    monkeypatch.setattr(sentencepieces, "_model", lambda path: Crossing())
    with pytest.raises(ValueError, match="crosses from one chunk"):
        sentencepieces.check("other")
