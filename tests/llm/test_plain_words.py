"""A word is encoded once, whatever marks close it, and all IDs are the library's."""

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from pairwave.llm import tokens

PATH = P.path("word_bpe_49k.json")


def test_a_word_is_encoded_once_with_all_marks(monkeypatch):
    made, seen = tokens.Encoder(PATH), []
    real = made._ids
    monkeypatch.setattr(made, "_ids", lambda texts: seen.extend(texts) or real(texts))
    made.encode(["qwertzuio. qwertzuio, qwertzuio!! Qwertzuio", "qwertzuio?"])
    assert " ".join(seen).count("qwertzuio") == 1


@pytest.mark.parametrize("most", [400_000, 3])
def test_ids_of_words_with_marks_are_the_library_s(monkeypatch, most):
    monkeypatch.setattr(tokens, "MOST_PIECES", most)
    library, made = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    words = ["don't", "it's.", "'s", "a's!", "word.'s", "word...", "!?;:", "...word", "x.,y", "é.", "école,", "ÉCOLE,", "ß!", "µ.", "ª,", "÷!", "é.", "İ.", "12.", "3rd.", "½!", "a\x01.", "\x01", "<|endoftext|>.", "中文。", "中文.", "z" * 3000 + "!", "ÿ:", "ſ.", "ﬁ,", "a​.", "�.", ""]
    texts = [*words, " ".join(words), " ".join(reversed(words)), "Word. " * 50 + "word", None]
    for _ in range(2):
        assert [x.tolist() for x in made.encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
