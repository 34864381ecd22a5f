"""SentencePiece encoding and decoding by distinct chunks."""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from tidepool.llm import wordblocks

#: The sign that stands for a space in pieces.
MARKER = "▁"
#: Spaces, and after them letters, a digit or signs. A marked text starts with a space.
CHUNK = re.compile(r" *(?:[A-Za-z\xaa\xb5\xba\xc0-\u1fff\u2070-\U0010ffff]+|[0-9]|[^ A-Za-z0-9\xaa\xb5\xba\xc0-\u1fff\u2070-\U0010ffff]+)| +")


@functools.cache
def _model(path: str) -> SentencePieceProcessor:
    return SentencePieceProcessor(model_file=path)


def check(path: str) -> None:
    """Refuses models whose chunks depend on each other: pieces that are more than one chunk, no marker before the text, or texts that are changed before."""
    model = _model(path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    crossing = next((p for p in pieces if len(CHUNK.findall(p.replace(MARKER, " "))) != 1), None)
    if crossing is not None:
        raise ValueError(f"the piece {crossing!r} crosses from one chunk to another, so chunks can't be segmented by themselves")
    probe = "  ﬁ  Å é\t"
    if model.decode(model.encode(probe)) != probe or not model.id_to_piece(model.encode("a")[0]).startswith(MARKER):
        raise ValueError("the model changes texts before it segments them, or sets no marker before them")


def split_chunks(text: str | None) -> list[str]:
    """Chunks of a whole text, with the space that is set before it and for markers in it; none of an empty text."""
    return CHUNK.findall(" " + text.replace(MARKER, " ")) if text else []


def encode_chunks(path: str, chunks: list[str]) -> pa.Array:
    """Ids of distinct chunks.

    The library sets a marker before what it is given. So a chunk that starts with a space goes without it; of a lone space nothing is left; any
    other one goes after a line break, which no piece holds, and whose ids are taken off.
    """
    model = _model(path)
    alone, lead = model.piece_to_id(MARKER), len(model.encode("\n"))
    starts = [c[0] == " " for c in chunks]
    ids = model.encode([c[1:] if s else "\n" + c for c, s in zip(chunks, starts, strict=True)], num_threads=1)
    return pa.array([(x or [alone]) if s else x[lead:] for x, s in zip(ids, starts, strict=True)], pa.list_(pa.int32()))


def decode_chunks(path: str, ids: pa.Array) -> pa.Array:
    """Texts of chunks' ids, which are decoded after those of a line break, as the library takes a marker off a text's start."""
    model = _model(path)
    lead = model.encode("\n")
    return pc.utf8_slice_codeunits(pa.array(model.decode([lead + x for x in ids.to_pylist()], num_threads=1), pa.string()), 1)


def encode_and_decode(docs: DataFrame, path: str, block_chars: int = wordblocks.BLOCK_CHARS) -> DataFrame:
    """``doc_id, ids, decoded`` of every row of ``docs`` (``doc_id, text``; other columns are ignored): ids as the library gives them without begin and end, and the text they decode to.

    No piece of the model crosses from what precedes a marker to it, nor between letters, digits and other signs (``check`` refuses other models), so what lies between such places
    is segmented alike wherever it stands: every distinct chunk is segmented once, its ids are decoded once for each block, and both are joined back by position (see
    ``wordblocks``). A null text is an empty one, without ids; repeated rows and ids are repeated; an empty table stays empty.
    """
    check(path)
    coder = wordblocks.Coder(docs, split_chunks, block_chars)
    rows = wordblocks.encoded(coder, functools.partial(encode_chunks, path))
    return wordblocks.joined_back(coder, rows, functools.partial(decode_chunks, path), "").selectExpr("doc_id", "ids", "substring(decoded, 2) as decoded")
