"""Chunked encoding against the tokenizers library on texts whose cuts are easy to get wrong."""

import itertools
import random

import pytest

from edgewise.llm import bpe, chunks, queries

PARTS = ["a", "Word", "einü", "É", "ß", "ı", "İ", "́", "日本", "Ⅷ", "42", "'", "'s", "'LL", ".", "?!", "%%%", "|", "<|endoftext|>", "<|", "_", "–", "\n", "\r\n", "\t", "  ", " ", "　", "\x00", "😀", "ǅ", "Σ"]


def texts() -> list[str]:
    draw = random.Random(7)
    mixed = ["".join(draw.choice(PARTS) + draw.choice(["", "", " ", "\n"]) for _ in range(draw.randint(0, 12))) for _ in range(1500)]
    return [*mixed, *map("".join, itertools.product(PARTS, PARTS))]


@pytest.mark.parametrize("name", ["byte_level", "word_level", "segment_tree"])
def test_chunked_ids_equal_the_library(name: str) -> None:
    path = queries.WORD_LEVEL if name == "word_level" else queries.BYTE_LEVEL
    encoder = {"byte_level": chunks.byte_level_cache, "word_level": chunks.word_level_cache, "segment_tree": bpe.byte_bpe}[name](path)
    library, given = chunks.library(path), texts()
    for text, ids in zip(given, encoder.encode(given), strict=True):
        assert ids == chunks.packed(library.encode(text, add_special_tokens=False).ids), text
