"""Piece encoding against the sentencepiece library, the plain merge and round trips."""

import hashlib
import random
from array import array

import pytest
import sentencepiece

from flowspark.llm import piece_bpe
from flowspark.llm.queries import vocabulary

TRICKY = [None, "", " ", "  ", "   a  b ", "\n\n a\r\n);\r", "▁", "▁▁a ▁b", "<s> </s> <0x0A> <unk>", "\0a\0", "é中文字𐍈😀", " " * 100,
          "a" * 1000, "\t \t", "ﬁ", " x▁　", "1234 12.5%", "retokenization of misunderstandings, 3rd ed."]


@pytest.fixture(scope="module")
def path():
    return vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(path):
    return sentencepiece.SentencePieceProcessor(model_file=path)


@pytest.fixture(scope="module")
def model(path):
    return piece_bpe.PieceModel(piece_bpe.file_content(path))


def test_ids_are_those_of_the_library(model, library):
    rng = random.Random(1)
    letters = " ▁abcdetinsr \n\r\t.,;)({}*/'\"01éàüñß中😀<>x"
    names = list(model.ids)
    texts = [t for t in TRICKY if t]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    texts += ["".join(rng.choice(names) for _ in range(rng.randrange(1, 12))).replace("▁", " ") for _ in range(2000)]
    for text in texts:
        assert array("I", model.encode(text)).tolist() == library.encode(text), text


def test_backtracking_gives_what_merging_gives(model):
    rng = random.Random(2)
    for _ in range(1000):
        text = "".join(rng.choice("▁theraind") for _ in range(rng.randrange(1, 40)))
        assert model.backtrack(text) == model.merge(text), text


def test_failed_positions_are_not_tried_again(model):
    text = "t" * 20000 + "he" * 20000  # over several blocks of matches, without a place to cut
    pieces = model.backtrack(text)
    assert "".join(pieces) == text
    assert all(model.compatible[pair] for pair in zip(pieces, pieces[1:]))


def test_bounded_tables_start_anew(model):
    made = []
    table = piece_bpe.Bounded(lambda c: made.append(c) or c.upper(), 6)
    assert [table[c] for c in "abcadeafgab"] == list("ABCADEAFGAB") and len(table) + len(table.before) <= 6
    assert "".join(made) == "abcdefgb"  # what is asked for again and again is not made again


def test_query_columns_and_round_trip(spark, docs, path, library):
    rows = list(enumerate(TRICKY)) + [(3, "a b"), (3, "a b"), (None, "no id")]
    table = docs(rows)
    got = sorted(tuple(r) for r in piece_bpe.digests(table, path).collect() if r["doc_id"] is not None)
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(w for w in want if w[0] is not None)
    coded = piece_bpe.encode(table, path)
    back = {(r["doc_id"], r["text"]) for r in piece_bpe.decode(coded, path).collect()}
    assert back == {(i, library.decode(library.encode(t or ""))) for i, t in rows}


def test_empty_table_and_other_models(spark, docs, path):
    assert piece_bpe.digests(docs([]), path).count() == 0
    with pytest.raises(Exception):
        piece_bpe.PieceModel(b"no model")


def test_a_very_long_text(spark, docs, path, library):
    text = "word and another " * 300_000
    got = piece_bpe.digests(docs([(1, text)]), path).first()
    ids = library.encode(text, add_bos=True, add_eos=True)
    assert got["n_tokens"] == len(ids)
    assert got["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
