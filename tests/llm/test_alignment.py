"""Alignment of two tokenizers against the libraries and plain counting."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from flowspark.llm import token_alignment
from flowspark.llm.queries import vocabulary

TRICKY = [None, "", " ", "   ", "a  b", "a   b ", "\n\n a\r\n);\r", "x ▁ y", "<s> it's <|endoftext|> we'll <0x0A>", "\0a", "é中文字𐍈😀 ñandú,",
          "don't,can't'll (foo)bar! 12.5% a1b2 ½²3", "éa b  c　d", "\t\t tab\x85x\x1cy \x1c z", "a.b,c;d" * 50, "§", "word " * 3000]


@pytest.fixture(scope="module")
def paths():
    return vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens(paths):
    """(A ids, A bytes, B ids, B bytes) of a text from the libraries; bytes from offsets and pieces."""
    first = Tokenizer.from_file(paths[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    value = {c: b for c, b in token_alignment._byte_of_entry().items()}

    def run(text):
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        a_bytes = [bytes(value[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(second.id_to_piece(i)[1:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        return a, a_bytes, b, b_bytes

    return run


def _by_hand(rows, tokens):
    found, counts = [], Counter()
    for doc, text in rows:
        a, a_bytes, b, b_bytes = tokens(text) if text else ([], [], [], [])
        whole = bool(text) and b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode()
        groups, links = [], []
        if whole:
            a_end = [sum(map(len, a_bytes[:i + 1])) for i in range(len(a))]
            b_end = [sum(map(len, b_bytes[:i + 1])) for i in range(len(b))]
            links = [(a[i], b[b_end.index(e)]) for i, e in enumerate(a_end) if e in set(b_end)]
            start = 0
            for end in sorted(set(a_end) & set(b_end)):
                groups.append(([t for t, e in zip(a, a_end) if start < e <= end], [t for t, e in zip(b, b_end) if start < e <= end]))
                start = end
        else:
            a = b = []
        counts.update(links)
        found.append((doc, a, b, groups, links))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for doc, a, b, groups, links in found:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc, len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


def _rows():
    rng = random.Random(3)
    rows = list(enumerate(TRICKY)) + [(3, "again a b"), (3, "again a b"), (None, "no id"), (None, "no id")]
    letters = " abcdeths ,.'-!\n\t01é中😀sdm"
    return rows + [(100 + k, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 120)))) for k in range(300)]


@pytest.mark.parametrize("head_pairs", [0, 40, 500_000])
def test_counts_and_digests_by_hand(spark, docs, paths, tokens, head_pairs):
    rows = _rows()
    got = [tuple(r) for r in token_alignment.digests(docs(rows), *paths, head_pairs=head_pairs).collect()]
    assert sorted(got, key=repr) == sorted(_by_hand(rows, tokens), key=repr)


def test_groups_hold_all_tokens(spark, docs, paths, tokens):
    rows = [(i, t) for i, t in _rows() if i is not None][:60]
    got = token_alignment.groups(docs(rows), *paths).collect()
    for row in got:
        a, b = [i for g in row["groups"] for i in g["a"]], [i for g in row["groups"] for i in g["b"]]
        texts = [t for i, t in rows if i == row["doc_id"] and t and "▁" not in t]
        assert (a, b) == ([], []) if not texts else (a, b) in [(x[0], x[2]) for x in map(tokens, texts)]


def test_groups_and_links_of_two_lists():
    assert token_alignment.cut_groups([2, 3, 7, 9], [1, 3, 9]) == [(0, 2, 0, 2), (2, 4, 2, 3)]


def test_parts_are_cut_where_both_tokenizers_end_a_token(paths, tokens):
    aligner = token_alignment.Aligner(*map(token_alignment.file_content, paths))
    rng = random.Random(8)
    letters = "ab \n\t.,'s!é²1½\xa0　 ΩЖ中\r\x1c\x85"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 40)))
        said = aligner.of(aligner.learn([text])[0])[0]
        a, _, b, _ = tokens(text)
        assert [int(i) for g in said.split(";") for i in g.split("|")[0].split(",")] == a, repr(text)
        assert [int(i) for g in said.split(";") for i in g.split("|")[1].split(",")] == b, repr(text)


def test_empty_table(spark, docs, paths):
    assert token_alignment.digests(docs([]), *paths).count() == 0


def test_parts_of_one_token_are_not_cut(paths, monkeypatch):
    """A part that is one token on either side is one group, as cutting it gives."""
    aligner = token_alignment.Aligner(*(open(p, "rb").read() for p in paths))
    parts = sorted({p for text in TRICKY if text for p in aligner.cut(text)})
    first = aligner.bytes_model.encode_batch_fast(parts, add_special_tokens=False)
    seen = [(p, a.ids, b) for p, a, b in zip(parts, first, aligner.piece_model.encode(parts))]
    single = [x for x in seen if len(x[1]) == 1 or len(x[2]) == 1]
    assert len(single) > 10
    cut, calls = token_alignment.cut_groups, []
    monkeypatch.setattr(token_alignment, "cut_groups", lambda *ends: calls.append(ends) or cut(*ends))
    for part, a, b in single:
        said, pairs, n_a, n_b = aligner.align(part, a, b)
        if pairs is not None:
            assert said == f"{','.join(map(str, a))}|{','.join(map(str, b))}" and (n_a, n_b) == (len(a), len(b))
            assert list(memoryview(pairs).cast("q")) == [a[-1] << token_alignment._SHIFT | b[-1]]
    assert not calls
