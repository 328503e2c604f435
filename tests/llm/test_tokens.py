import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from caseloom.llm.tokens import PrefixCounter, longest_prefix, prefix_counts, tokens_at

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", "  a  b ", "a\tb\nc\n", "<s>x</s>", "▁x▁", "\x00", "é́梦😀", "a" * 600, "❤" * 300, "10000", "the,,, of!!!"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_every_prefix(library):
    chance, counter = random.Random(3), PrefixCounter(MODEL)
    letters = "abcthe  \n\té▁<s>/019.,ß梦😀"
    texts = ODD + ["".join(chance.choice(letters) for _ in range(chance.randint(1, 50))) for _ in range(150)]
    for text, counts in zip(texts, counter.texts(texts)):
        assert list(counts) == [len(library.encode(text[: k + 1])) for k in range(len(text))]


def test_columns(frame, library):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (1, None), (1, "a"), (1, "a")]
    got = prefix_counts(frame(rows), MODEL, ["doc_id"])
    assert sorted(map(str, got.select("doc_id", "n_tokens").collect())) == sorted(
        f"Row(doc_id={k}, n_tokens={len(library.encode(t or ''))})" for k, t in rows
    )
    text = "The thinning of the herd\nand more."
    asked = prefix_counts(frame([(1, text)]), MODEL, ["doc_id"]).select(
        tokens_at("prefix_tokens", 7), tokens_at("prefix_tokens", 0), tokens_at("prefix_tokens", 999),
        longest_prefix("prefix_tokens", 5), longest_prefix("prefix_tokens", 0),
    ).first()
    fitting = [k for k in range(len(text) + 1) if len(library.encode(text[:k])) <= 5]
    assert tuple(asked) == (len(library.encode(text[:7])), 0, len(library.encode(text)), max(fitting), 0)
    assert prefix_counts(frame([]), MODEL, ["doc_id"]).count() == 0


def test_sums_of_long_texts(frame, library):
    text = "Thinner herds of nine " * 5000
    got = prefix_counts(frame([(1, text)]), MODEL, ["doc_id"]).select(F.size("prefix_tokens"), "n_tokens").first()
    assert tuple(got) == (len(text), len(library.encode(text)))
