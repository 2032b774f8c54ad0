"""Chunks and words of the tokenizers against whole texts."""

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from stormshift.llm._encode import Encoder  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "İ...", "aİ.", "İstanbul, İİ! İ", "ΣΣ. ß? Ǆ!", "it's, 's. x'", "a&&& b### c--- d_ e= f\\ g~~", "ab<|endoftext|>. <|endoftext|>c, d<|endoftext|", "e< f> g|", "é. á, ö; ́.",
    "12, 1a. a1.", "…. «a». 　 a　b.", "\U0001f600. 日本語。 日本, क्षि.", "a\x1cb c\x1f.",
]


def test_chunks_of_odd_texts_add_up():
    """A capital I with a dot is a letter and a mark in lower case: marks after it belong to its second pre-token."""
    whole = Encoder(PATH)
    for text in (*ODD, " ".join(ODD), " ".join(ODD[::-1])):
        assert Encoder(PATH, True).ids(text.encode()) == whole.ids(text.encode()), text


def test_new_words_of_a_text_take_one_call():
    e, whole, calls = Encoder(PATH, True), Encoder(PATH), []
    library = e._library
    e._library = lambda text: calls.append(text) or library(text)
    text = " ".join(f"{a}{b}né" for a in "abcdefgh" for b in "ijklmnop").encode()
    assert e.ids(text) == whole.ids(text) and len(calls) == 1
    assert e.ids(text) == whole.ids(text) and len(calls) == 1


def test_both_generations_are_bounded_and_right():
    e, whole = Encoder(PATH, True, limit=2000), Encoder(PATH)
    for text in (" ".join(f"{a}{b}{c}," for c in "xyz") for a in "abcdef" for b in "ghijkl"):
        assert e.ids(text.encode()) == whole.ids(text.encode())
    assert len(e.chunks) < 12 and len(e.chunks.older) < 12
