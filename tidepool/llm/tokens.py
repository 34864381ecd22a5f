"""Byte-level BPE vocabularies, read from a tokenizer's JSON file inside tasks."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import tiktoken

#: The split pattern and the byte alphabet of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode's white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Runs of white space from this length on are cut out before the pattern is applied, which would backtrack over all of them.
LONG_RUN = 10_000
_LONG = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")

PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes: printable ones for themselves, the others counted up from 256."""
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.cache
def encoder(path: str, split: str = SPLIT) -> tiktoken.Encoding:
    """The tokenizer in ``path`` as a tiktoken encoding: same ids, several times faster; ``split``: its pattern.

    It holds for byte-level BPE files whose ids are in order of their merges, which is checked.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, alphabet = spec["model"], byte_alphabet()
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    merged = [model["vocab"]["".join(x if isinstance(x, list) else x.split(" "))] for x in model["merges"]]
    if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or merged != sorted(merged):
        raise ValueError(f"{path} isn't a byte-level BPE with ids in order of its merges")
    ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding(path, pat_str=split, mergeable_ranks=ranks, special_tokens=special)


def encode(path: str, text: str | None, end_id: int | None) -> np.ndarray:
    """Ids of a whole text (None: as empty) as the file's own library gives them, then ``end_id``.

    Before other characters, the pattern takes a run of white space without its last one, which begins the next match; before
    a special token or at the end it takes all of it. Long runs are cut out by this rule and encoded as the single pieces they are.
    """
    own, text, ids, at = encoder(path), text or "", [], 0
    for run in _LONG.finditer(text):
        first, last = run.span()
        if last < len(text) and not text.startswith(tuple(own.special_tokens_set), last):
            last -= 1
        ids += own.encode(text[at:first], allowed_special="all")
        ids += encoder(path, "(?s:.+)").encode_ordinary(text[first:last])
        at = last
    ids += own.encode(text[at:], allowed_special="all")
    return np.array(ids if end_id is None else [*ids, end_id], dtype="<u4")
