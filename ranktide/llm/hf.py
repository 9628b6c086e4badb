"""Ids by the tokenizers library, each distinct piece once."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np

from ranktide.llm.common import kept
from ranktide.llm.pieces import PieceEncoder, WordTable


def byte_letters() -> list[str]:
    """Byte-level BPE writes each byte as one letter: printable ones as themselves, the rest from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


def plain_added_tokens(file: dict) -> dict[str, int]:
    """The added tokens' strings and ids of a tokenizer's file, read as JSON. The library cuts these out of a text first;
    files whose tokens or texts it treats in another way besides are refused."""
    before = file["pre_tokenizer"]
    if file["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
        raise ValueError("only byte-level files with the usual pattern and without a normalizer are read")
    for token in file["added_tokens"]:
        if any(token[k] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"an added token that takes its surroundings: {token}")
    return {token["content"]: token["id"] for token in file["added_tokens"]}


def table(path: str) -> WordTable:
    """One table a Python worker and file; it outlives the task, as the worker does."""
    return kept(("hf", path), lambda: _make(path))


def _make(path: str) -> WordTable:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        added = plain_added_tokens(json.load(f))
    tokenize = Tokenizer.from_file(path).model.tokenize
    letters = dict(enumerate(byte_letters()))
    space = letters[32]

    def encode(piece: str) -> list[int]:
        if piece.isascii() and piece[1:].isalpha():
            piece = space + piece[1:] if piece[0] == " " else piece
        else:
            piece = piece.encode().decode("latin-1").translate(letters)
        return [t.id for t in tokenize(piece)]

    return WordTable(PieceEncoder(encode, special=added))


def encode_texts(path: str, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The ids of each text as ``encode(text, add_special_tokens=False)`` gives them (null: none).

    The strings of the file's added tokens are these tokens wherever they stand,
    as in the library unless told otherwise. The model is the library's own; its
    pre-tokenizer's pattern is applied in ``pieces``.
    """
    return table(path).encode_texts("" if t is None else t for t in texts)
