import os
import random

import pytest

from axisframe.llm.tokenizer import VOCABULARY, EditablePiece, EditableText, PrefixBPE, encode_corpus, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
TEXTS = ["", " ", "the the  the", "It's they're 'r", "naïve ſtraße 漢字 \U0001f600\n\n x", "a" * 300, "<|endoftext|>", "12 345  \t\r\n", "Thequickbrownfox" * 8, "�\x00~"]


@pytest.fixture(scope="module")
def vocabulary():
    return PrefixBPE.from_file()


def test_like_the_library(vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    library.encode_special_tokens = True
    for text in TEXTS:
        assert vocabulary.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_round_trip(vocabulary):
    for text in TEXTS:
        assert b"".join(vocabulary.token[t] for t in vocabulary.encode(text)).decode() == text


def test_edits(vocabulary):
    draw = random.Random(5)
    for _ in range(150):
        text = "".join(draw.choice(["the", " ", "'", "re", "é", "\n", "12", "tion", " un", "漢"]) for _ in range(draw.randrange(40)))
        i = draw.randrange(len(text) + 1)
        j, new = min(len(text), i + draw.randrange(4)), draw.choice(["", "'", " the", "  ", "é1"])
        whole = EditableText(vocabulary, text)
        whole.replace(i, j, new)
        assert whole.ids == vocabulary.encode(text[:i] + new + text[j:])
        whole.append("'re x")
        assert whole.ids == vocabulary.encode(whole.text)
        raw = text.encode()
        i, j = min(i, len(raw)), min(j, len(raw))
        piece = EditablePiece(vocabulary, raw)
        piece.replace(i, j, new.encode())
        assert list(piece.ids) == vocabulary.merge(raw[:i] + new.encode() + raw[j:])
        piece.append(b"tion")
        assert list(piece.ids) == vocabulary.merge(piece.raw)


def test_edit_is_local(vocabulary):
    piece = EditablePiece(vocabulary, b"internationalisation" * 60)
    assert piece.replace(5, 6, b"x") < 3 * vocabulary.longest


def test_operator(spark, vocabulary):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(90, None, 1), (91, "word " * 60_000, 2), (None, "a", 3), (0, "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = [(r.doc_id, r.ids) for r in encode_corpus(df, "doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted([(i, vocabulary.encode(t)) for i, t, _ in rows], key=str)
    counts = {r.doc_id: r.n_tokens for r in token_counts(df, "doc_id", "text").collect()}
    assert counts[90] == 0 and counts[91] == len(vocabulary.encode("word " * 60_000))
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0
