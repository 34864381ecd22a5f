"""Word-level BPE by distinct words, and decoding by a join with the table of pieces."""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from tidepool.llm import wordblocks

#: The word pattern of this kind of tokenizer, and Unicode's white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")

#: The same for ASCII, and for texts without characters that Python's own classes see otherwise: numbers that aren't
#: decimal digits, and separators that Unicode doesn't count as white space.
ASCII_WORD = re.compile(r"[a-z]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^a-z0-9\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\W\d_]+|\d|'(?:[stmd]|re|ve|ll)|(?:[^\w\s]|_)+")
ODD = regex.compile(r"[\p{Nl}\p{No}\x1c-\x1f]")


@functools.cache
def _special(path: str) -> tuple[dict[str, int], "re.Pattern | None"]:
    """Special tokens with their ids, and what finds them."""
    with open(path, encoding="utf-8") as file:
        added = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
    return added, re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None


@functools.cache
def _tokenizer(path: str) -> Tokenizer:
    """The tokenizer with special tokens as ordinary text."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    return tokenizer


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``id, piece``: the vocabulary, special tokens included; the table that ids are decoded with."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    ids = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
    return spark.createDataFrame(sorted((i, p) for p, i in ids.items()), "id int, piece string")


def _unknown(text: str) -> bool:
    """Whether there are code points that Python's Unicode tables don't know, but the library's may; texts without any are told by a scan in C, mostly."""
    return not text.replace("\n", " ").isprintable() and any(unicodedata.category(c) == "Cn" for c in set(text))


def _as_the_library(path: str, text: str) -> list[str]:
    """Words by the file's own normalizer and splitter."""
    tokenizer = _tokenizer(path)
    plain = tokenizer.normalizer.normalize_str(text)
    return [plain[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(plain)]


def split_words(path: str, text: str | None) -> list[str]:
    """Words of a whole text as the tokenizer splits it; a special token is a word of its own, marked by a leading space."""
    found = _special(path)[1]
    out: list[str] = []
    for i, part in enumerate(found.split(text or "") if found else [text or ""]):
        if i % 2:
            out.append(" " + part)
        elif part.isascii():
            out += ASCII_WORD.findall(part.lower())
        elif _unknown(part):
            out += _as_the_library(path, part)
        else:
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            out += (WORD if ODD.search(part) else PLAIN_WORD).findall(part)
    return out


def _word_ids(path: str, words: list[str]) -> list[list[int]]:
    tokenizer, added = _tokenizer(path), _special(path)[0]
    plain = tokenizer.encode_batch_fast([w for w in words if w[0] != " "], add_special_tokens=False)
    ids = iter([e.ids for e in plain])
    return [[added[w[1:]]] if w[0] == " " else next(ids) for w in words]


def encode_words(path: str, words: list[str]) -> pa.Array:
    """Ids of distinct words."""
    return pa.array(_word_ids(path, words), pa.list_(pa.int32()))


def decode_words(table: Broadcast, ids: pa.Array) -> pa.Array:
    """Texts of words' ids, which are joined with the table of pieces; pieces are set apart by spaces."""
    flat = ids.flatten()
    found = pa.table({"at": np.arange(len(flat)), "id": flat}).join(table.value, "id", join_type="inner", use_threads=False).sort_by("at")
    if found.num_rows != len(flat):
        raise ValueError("some ids have no piece")
    offsets = pa.array(np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, found.column("piece").combine_chunks()), " ")


def encode_and_decode(docs: DataFrame, tokenizer: str, block_chars: int = wordblocks.BLOCK_CHARS) -> DataFrame:
    """``doc_id, ids, decoded``: ids as the library gives them, and the text that they decode to.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A null text is an empty one, without ids; repeated rows and ids are repeated;
    an empty table stays empty. Every distinct word is encoded once; in each block, its words' ids are joined with the table of pieces, which goes to all tasks, as its size is the
    vocabulary's; and both are joined back by position (see ``wordblocks``).
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(pieces(spark, tokenizer).toArrow())
    coder = wordblocks.Coder(docs, functools.partial(split_words, tokenizer), block_chars)
    rows = wordblocks.encoded(coder, functools.partial(encode_words, tokenizer))
    return wordblocks.joined_back(coder, rows, functools.partial(decode_words, table), " ")
