"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking.

A sequence of pieces is the encoding of its text exactly if every two neighbours are what merging their
joint text gives again. Encoding therefore takes the longest piece that the Aho-Corasick automaton of all
pieces found at a position, goes on to the next shorter piece that begins there while the new piece and
the one before it are not compatible, and steps back a piece where none is left. A bit field remembers
positions from which the end was not reached, so no position is tried twice. Two pieces are compatible
if merging again, best score and leftmost first, gives the two pieces; pairs are kept in a bounded table.

Texts are cut first between characters that no pieces connect and before spaces, as no merge can reach
over such a place; ids of recurring parts come from a bounded table in every worker. Characters
without a piece become their UTF-8 bytes. Decoding joins ids with the table of pieces.

Supported models: merge type, identity normalisation, a space put before the text, spaces kept, byte
pieces for unknown characters; others raise ValueError.

Defined cases: a null or empty text has the begin and end ids only; strings that look like control
pieces or byte pieces are ordinary text; the character U+2581 is encoded as a space, and decoded as one;
rows that repeat an id or a text get a result each; further columns are ignored; an empty table gives no
rows. Texts are taken whole; matches are looked up block by block, so a text without any place to cut
needs a few bytes a character.
"""

import hashlib
import re
from array import array

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from flowspark.llm.keys import columns_of
from flowspark.llm.words import slices

SPACE = "▁"
#: Characters that are looked through for matches at once.
_BLOCK = 4096
#: Entries of the tables that a worker keeps: parts of texts, pairs of pieces.
_PARTS, _PAIRS = 400_000, 400_000


class Bounded(dict):
    """A table that computes missing entries. A full one starts anew and takes over what it is asked for again."""

    def __init__(self, make, limit):
        super().__init__()
        self.make, self.limit, self.before = make, limit // 2, {}

    def room(self, n=1):
        if len(self) + n > self.limit:
            self.before = dict(self)
            self.clear()

    def __missing__(self, key):
        self.room()
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class PieceModel:
    """Pieces, scores and byte ids of a model file's content, and the encoder over them."""

    def __init__(self, content):
        known = sentencepiece.SentencePieceProcessor(model_proto=content)
        size = known.vocab_size()
        if known.normalize(" a  ﬁ\t") != f"{SPACE}{SPACE}a{SPACE}{SPACE}ﬁ\t":
            raise ValueError("the model normalises texts, or does not put a space before them")
        names = [known.id_to_piece(i) for i in range(size)]
        special = [known.is_control(i) or known.is_unknown(i) for i in range(size)]
        if any(known.is_unused(i) for i in range(size)):
            raise ValueError("unused pieces are not supported")
        self.bytes = {int(names[i][1:-1], 16): i for i in range(size) if known.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")
        self.begin, self.end = known.bos_id(), known.eos_id()
        self.ids = {names[i]: i for i in range(size) if not special[i] and not known.is_byte(i)}
        self.scores = {p: known.get_score(i) for p, i in self.ids.items()}
        #: Bytes that every id stands for, spaces as spaces; control pieces stand for nothing.
        self.piece_bytes = [b"" if special[i] else names[i].replace(SPACE, " ").encode() for i in range(size)]
        for value, i in self.bytes.items():
            self.piece_bytes[i] = bytes([value])
        self.longest = max(map(len, self.ids))
        self.touching = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(b[1] == SPACE and b[0] != SPACE for b in self.touching):
            raise ValueError("a piece goes on after a space")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        #: The next shorter piece with the same beginning; a single character is the last resort.
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in self.ids), None) for p in self.ids}
        self.compatible = Bounded(lambda pair: tuple(self.merge("".join(pair))) == pair, _PAIRS)
        self.whole = Bounded(lambda piece: self.merge(piece) == [piece], _PAIRS)
        self.parts = Bounded(lambda part: self._as_ids(self.backtrack(part)), _PARTS)
        groups = "|".join(f"[{''.join(map(re.escape, g))}]+" for g in self._groups())
        self._part = re.compile(f"{SPACE}*(?:{groups}|[^{SPACE}])|{SPACE}+")

    def _groups(self):
        """Characters that pieces connect, directly or through others: no merge joins two groups.

        Spaces are left out; as none follows another character in a piece, they open a part.
        """
        group = {}
        for first, second in self.touching:
            if first == SPACE:
                continue
            one, two = group.setdefault(first, {first}), group.setdefault(second, {second})
            if one is not two:
                one, two = (one, two) if len(one) >= len(two) else (two, one)
                one |= two
                group.update(dict.fromkeys(two, one))
        return sorted({id(g): sorted(g) for g in group.values()}.values(), key=len, reverse=True)

    def merge(self, text):
        """Merge characters as the model does: the neighbours with the best score first, the leftmost of equals."""
        symbols, scores = list(text), self.scores
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _matches(self, text, start):
        """Length of the longest piece at each position of one block; 1 where none begins."""
        stop = min(len(text), start + _BLOCK)
        found = [1] * (stop - start)
        for last, n in self.automaton.iter(text, start, min(len(text), stop + self.longest - 1)):
            first = last - n + 1 - start
            if first < len(found) and n > found[first]:
                found[first] = n
        return found

    def _by_block(self, text):
        """_matches at any position, a few blocks of a long text at a time."""
        blocks = {}

        def longest(position):
            number = position // _BLOCK
            if number not in blocks:
                if len(blocks) > 3:
                    blocks.clear()
                blocks[number] = self._matches(text, number * _BLOCK)
            return blocks[number][position - number * _BLOCK]

        return longest

    def backtrack(self, text):
        """The pieces of a text; a character without a piece stands for itself."""
        size, pieces, at = len(text), [], 0
        failed = bytearray((size >> 3) + 1)
        longest = self._matches(text, 0).__getitem__ if size <= _BLOCK else self._by_block(text)
        piece = text[:longest(0)] if size else None
        while at < size:
            while piece is not None:
                after = at + len(piece)
                if not failed[after >> 3] >> (after & 7) & 1 and (
                        self.compatible[pieces[-1], piece] if pieces else self.whole[piece]):
                    break
                piece = self.shorter.get(piece)
            if piece is not None:
                pieces.append(piece)
                at += len(piece)
                piece = text[at:at + longest(at)] if at < size else None
                continue
            # nothing fits behind this position
            failed[at >> 3] |= 1 << (at & 7)
            piece = pieces.pop()
            at -= len(piece)
            piece = self.shorter.get(piece)
        return pieces

    def _as_ids(self, pieces):
        ids = array("I")
        for p in pieces:
            if p in self.ids:
                ids.append(self.ids[p])
            else:
                ids.extend(self.bytes[b] for b in p.encode())
        return ids.tobytes()

    def cut(self, text):
        """The parts of a text with marked spaces that no merge joins."""
        return self._part.findall(text)

    def encode(self, text):
        """Ids of a text as little-endian numbers of four bytes, begin and end ids left out."""
        return self.encode_marked(SPACE + text.replace(" ", SPACE)) if text else b""

    def encode_marked(self, text):
        """Ids of a text in which spaces are marked already, the one put before it included."""
        return b"".join(map(self.parts.__getitem__, self.cut(text)))

    def decode(self, ids):
        """The bytes of the text that ids stand for; the space put before the text is taken off again."""
        joined = b"".join(map(self.piece_bytes.__getitem__, ids))
        return joined[1:] if joined[:1] == b" " else joined


_models = {}


def model_of(content):
    """One model for each file content and worker process."""
    key = hashlib.sha256(content).digest()
    if key not in _models:
        _models[key] = PieceModel(content)
    return _models[key]


def file_content(path):
    """A model or vocabulary file as bytes, read once on the driver and sent to the tasks."""
    with open(path, "rb") as file:
        return file.read()


def _mapped(table, column, keep, make, kinds, names):
    plain = columns_of(table, *keep, column)
    types = dict(plain.dtypes)

    def run(batches):
        for batch in slices(batches):
            columns = make(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *columns], names=[*keep, *names])

    return plain.mapInArrow(run, ", ".join([*(f"`{n}` {types[n]}" for n in keep), *kinds]))


def _ids_of(model, text):
    return array("I", [model.begin]).tobytes() + model.encode(text or "") + array("I", [model.end]).tobytes()


def encode(docs, path, keep=("doc_id",)):
    """The kept columns with ids: an array of token ids per row, begin and end ids included."""
    content = file_content(path)

    def ids(column):
        model = model_of(content)
        rows = [array("I", _ids_of(model, t)) for t in column.to_pylist()]
        return [pa.array([r.tolist() for r in rows], pa.list_(pa.int32()))]

    return _mapped(docs, "text", keep, ids, ["ids array<int>"], ["ids"])


def decode(coded, path, keep=("doc_id",)):
    """The kept columns with text, by joining every id with its piece; null ids count as none."""
    content = file_content(path)

    def texts(column):
        model = model_of(content)
        return [pa.array([model.decode(ids or []).decode("utf-8", "replace") for ids in column.to_pylist()], pa.string())]

    return _mapped(coded, "ids", keep, texts, ["text string"], ["text"])


def digests(docs, path):
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    content = file_content(path)

    def digest(column):
        model, counts, ids_hash, text_hash = model_of(content), [], [], []
        for scalar in column:
            ids = _ids_of(model, scalar.as_py())
            counts.append(len(ids) // 4)
            ids_hash.append(hashlib.sha256(ids).hexdigest())
            text_hash.append(hashlib.sha256(model.decode(array("I", ids))).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]

    return _mapped(docs, "text", ("doc_id",), digest, ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"],
                   ["n_tokens", "ids_sha256", "decoded_sha256"])
