"""BPE encoding and decoding over a table of distinct words.

Encoding splits every text into the tokenizer's words, counts them, and encodes each distinct word
once. Ids go back by position in two ways that together cover every word: words at least as frequent
as a cut, at most `head_words` of them, travel to the tasks as one dictionary of bounded size; every
other word stays in the table, and its ids are joined to (text, gap) rows and put into the gaps that
the dictionary left. Decoding joins ids with the id-to-piece table, which the tokenizer's file bounds,
and joins pieces by the file's rule.

Texts of plain characters are split over whole Arrow buffers, by the file's own word pattern put as
character classes; any other text goes through the tokenizer's own normaliser and splitter.

Special tokens that stand in a text are ids of their own, as the library has it by default.

Defined cases: a null text is the empty text, without ids; rows with equal texts or ids get the same
result each; other columns are ignored; an empty table gives no rows. Texts are taken whole.
"""

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowspark.llm.keys import bounded_batches, columns_of, text_key
from flowspark.llm.words import hash_words, slices, text_buffers
from flowspark.session import materialise

#: Words in the dictionary that every task holds.
HEAD_WORDS = 500_000
#: Different words that a task counts before it hands them on, and rows it splits at once.
_HELD_WORDS = 500_000
_ROWS = 512
#: The word pattern that the fast splitter stands for, and the characters it is meant for: printable
#: ASCII, tab, line feed, carriage return, and the letters from U+00C0 to U+024F but for U+0130, whose
#: lower case is one character and which no normal form changes. Fixed values.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = r"\A[\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ɏ]*\z"
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_class = np.full(256, _OTHER, dtype=np.uint8)
_class[[9, 10, 13, 32]] = _SPACE
_class[48:58] = _DIGIT
_class[65:91] = _class[97:123] = _LETTER
_class[128:] = _LETTER


class Splitter:
    """Cuts texts into the words and special tokens of one tokenizer file."""

    def __init__(self, path):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        #: Ids take two bytes where the vocabulary allows it.
        self.id_type = "<u2" if size <= 1 << 16 else "<u4"
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.fast = self._has_known_pattern()
        if self.tokenizer.decoder is None:
            self.pieces = pa.array([self.tokenizer.id_to_token(i) for i in range(size)])
            numbers = pa.array([str(i) for i in range(size)])
            #: Each entry with the space that divides it from the next one.
            self.spaced = [pc.binary_join_element_wise(table, "", " ").cast(pa.large_string()) for table in (numbers, self.pieces)]

    def _has_known_pattern(self):
        shape = json.loads(self.tokenizer.to_str())
        steps = [s["type"] for s in (shape.get("normalizer") or {}).get("normalizers", [])]
        cuts = (shape.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (steps == ["NFC", "Replace", "Lowercase"] and len(cuts) == 2 and cuts[0]["type"] == "Split"
                and cuts[0]["pattern"].get("Regex") == _PATTERN and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"])

    def words(self, text):
        """The words of a text without special tokens, as they stand after normalisation."""
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def parts(self, text):
        """Words and special tokens in order, the latter as ints."""
        if not any(s in text for s in self.special):
            return self.words(text)
        out = []
        for part in self._cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(self.words(part))
        return out

    def split(self, column):
        return Parts(self, column)

    def encode_words(self, words):
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


class Parts:
    """The words of a column of texts: bytes, start and end of every word, first word of every text.

    special holds the id of a special token, -1 for a word.
    """

    def __init__(self, splitter, column):
        column = column.fill_null("")
        plain = pc.match_substring_regex(column, _PLAIN) if splitter.fast else pa.array([False] * len(column))
        if splitter.special:
            marked = pc.match_substring_regex(column, "|".join(map(re.escape, splitter.special)))
            plain = pc.and_not(plain, marked)
        lower = pc.utf8_lower(pc.if_else(plain, column, ""))
        offsets, self.data = text_buffers(lower)
        self.starts, self.ends = _plain_bounds(offsets, self.data)
        self.first = np.searchsorted(self.starts, offsets)
        self.special = np.full(len(self.starts), -1, dtype=np.int64)
        for row in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)):
            self._insert(int(row), splitter.parts(column[int(row)].as_py()))

    def _insert(self, row, parts):
        """Put the parts of a text that was split apart from the others in their place."""
        words = [p.encode() if type(p) is str else b"" for p in parts]
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) + len(self.data)
        at = self.first[row]
        self.data = np.concatenate([self.data, np.frombuffer(b"".join(words), dtype=np.uint8)])
        self.starts = np.insert(self.starts, at, ends - [len(w) for w in words])
        self.ends = np.insert(self.ends, at, ends)
        self.special = np.insert(self.special, at, [-1 if type(p) is str else p for p in parts])
        self.first[row + 1:] += len(parts)

    def hashes(self):
        order = np.argsort(self.starts, kind="stable")  # hashing goes through the bytes in order
        out = np.empty(len(order), dtype=np.uint64)
        out[order] = hash_words(self.data, self.starts[order], self.ends[order], fold=False)
        return out

    def strings(self, at):
        """The words at these places."""
        lengths = (self.ends - self.starts)[at]
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        data = self.data[_ragged(self.starts[at], lengths)]
        return pa.LargeStringArray.from_buffers(
            len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _ragged(starts, lengths):
    """start, start + 1, ... for every start, as many as its length."""
    before = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _plain_bounds(offsets, data):
    """Word bounds of lower-cased plain texts."""
    kind = _class[data]
    begins = np.ones(len(data), dtype=bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] = True
    # an apostrophe that begins a word takes a following s, t, m, d, re, ve or ll with it
    quote = np.flatnonzero((data == 39) & begins)
    if len(quote):
        text_end = offsets[np.searchsorted(offsets, quote, "right")]
        byte = lambda k: np.where(quote + k < text_end, data[np.minimum(quote + k, len(data) - 1)], 0)
        one, two = byte(1), byte(2)
        short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        for taken, size in ((short, 2), (long, 3)):
            begins[quote[taken] + 1] = False
            after = quote[taken] + size
            after = after[after < text_end[taken]]
            begins[after] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))[:len(starts)]
    words = kind[starts] != _SPACE
    return starts[words], ends[words]


_splitters = {}


def splitter(path):
    """One splitter for each file and worker process."""
    if path not in _splitters:
        _splitters[path] = Splitter(path)
    return _splitters[path]


def _merged(held):
    """The distinct (word, count) of several lists of hashes, counts and words."""
    hashes, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    words = pa.concat_arrays([h[2] for h in held])
    _, at, group = np.unique(hashes, return_index=True, return_inverse=True)
    return hashes[at], np.bincount(group, weights=counts, minlength=len(at)).astype(np.int64), words.take(pa.array(at))


def word_table(docs, path):
    """(word, n, ids) for every distinct word of all texts; ids are little-endian numbers of id_type."""

    def count(batches):
        cut, held = splitter(path), []

        def rows():
            _, counts, words = _merged(held)
            held.clear()
            return pa.RecordBatch.from_arrays([words, pa.array(counts)], names=["word", "n"])

        for batch in slices(batches, _ROWS):
            parts = cut.split(batch.column(0))
            real = np.flatnonzero(parts.special < 0)
            hashes, at, counts = np.unique(parts.hashes()[real], return_index=True, return_counts=True)
            held.append((hashes, counts, parts.strings(real[at])))
            if sum(len(h[0]) for h in held) > _HELD_WORDS:
                held = [_merged(held)]
                if len(held[0][0]) > _HELD_WORDS // 2:
                    yield rows()
        if held:
            yield rows()

    def encode(batches):
        cut = splitter(path)
        for batch in slices(batches, 4096):
            ids = [np.array(i, dtype=cut.id_type).tobytes() for i in cut.encode_words(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["word", "n", "ids"])

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialise(counted.mapInArrow(encode, "word string, n long, ids binary"), "words")


def head_cut(words, head_words):
    """The least count that leaves at most head_words words at or above it; None if there is none.

    Counts are grouped by their leading bits, so the groups number a few hundred at any size.
    """
    step = F.expr("shiftleft(shiftright(n, greatest(0, length(bin(n)) - 5)), greatest(0, length(bin(n)) - 5))")
    groups = words.groupBy(step.alias("least")).agg(F.count(F.lit(1)).alias("words")).collect()
    total, cut = 0, None
    for row in sorted(groups, key=lambda r: -r["least"]):
        if total + row["words"] > head_words:
            break
        total, cut = total + row["words"], row["least"]
    return cut


class Head:
    """The dictionary: 64-bit hashes of words in order with their rank by count, and ids by rank."""

    def __init__(self, table, id_type):
        order = np.argsort(-table["n"].to_numpy(), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        words, ids = (table[c].combine_chunks() if len(table) else pa.array([], table[c].type) for c in ("word", "ids"))
        offsets, data = text_buffers(words)
        hashes = hash_words(data, offsets[:-1], offsets[1:], fold=False)
        self.ranks = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.ranks]
        self.flat = np.frombuffer(b"".join(ids.to_pylist()), dtype=id_type)
        lengths = pc.binary_length(ids).to_numpy(zero_copy_only=False) // np.dtype(id_type).itemsize
        self.ends = np.cumsum(lengths, dtype=np.int64)
        self.lengths = lengths.astype(np.int32)

    def find(self, hashes):
        """Rank of every hash, -1 where it is not in the dictionary."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ranks[at], -1)


def _head(words, cut):
    """The words with n >= cut, at most head_words of them."""
    return words.where(F.lit(False) if cut is None else F.col("n") >= F.lit(cut)).toArrow()


def _codes(parts, head):
    """A number for every word: 0 for a gap, odd ones for special tokens, even ones for ranks."""
    rank = head.find(parts.hashes())
    return np.where(parts.special >= 0, 2 * parts.special + 1, 2 * rank + 2).astype("<u4")


def _ids(codes, head, fill, id_type):
    """The ids that the codes of a text stand for, gaps filled with the given entries (gap, ids) in order."""
    gaps, special = np.flatnonzero(codes == 0), codes % 2 == 1
    if len(gaps) != len(fill):
        raise ValueError(f"{len(gaps)} gaps and {len(fill)} words for them")
    more = [np.frombuffer(f, dtype=id_type, offset=4) for f in fill]
    rank = np.maximum(codes.astype(np.int64) // 2 - 1, 0)
    rank[special] = 0
    lengths = head.lengths[rank].astype(np.int64) if len(head.lengths) else np.zeros(len(codes), dtype=np.int64)
    starts = head.ends[rank] - lengths if len(head.ends) else np.zeros(len(codes), dtype=np.int64)
    lengths[special], lengths[gaps] = 1, [len(m) for m in more]
    if not len(head.flat):
        out = np.zeros(int(lengths.sum()), dtype=id_type)
    else:
        # what stands in the place of gaps and special tokens is written over
        out = head.flat.take(_ragged(starts, lengths), mode="clip")
    if len(gaps) or special.any():
        places = np.cumsum(lengths) - lengths
        out[places[special]] = codes[special] // 2
        out[_ragged(places[gaps], lengths[gaps])] = np.frombuffer(b"".join(m.tobytes() for m in more), dtype=id_type)
    return out.tobytes()


def encode(docs, path, head_words=HEAD_WORDS, keep=("doc_id",)):
    """The kept columns with ids: a binary of little-endian token ids per row, two bytes each where the
    vocabulary has at most 65,536 ids and four bytes otherwise.
    """
    return _encode(docs, path, head_words, keep, lambda batches: batches, "ids binary")


def _encode(docs, path, head_words, keep, finish, columns):
    """The kept columns and what finish makes of the batches of (kept columns, ids), in the same task.

    A second Arrow function behind the first would hold a second Python process for every task.
    """
    bounded_batches(docs.sparkSession)
    plain = columns_of(docs, *keep, "text")
    words = word_table(plain, path)
    cut_at = head_cut(words, head_words)
    id_type = splitter(path).id_type
    sent = docs.sparkSession.sparkContext.broadcast(Head(_head(words, cut_at), id_type))
    tail = words.where(F.lit(True) if cut_at is None else F.col("n") < F.lit(cut_at)).select("word", "ids")

    def rare(batches):
        """(text_id, gap, word) for the words outside the dictionary, gaps counted within the text."""
        head, cut = sent.value, splitter(path)
        for batch in slices(batches, _ROWS):
            parts = cut.split(batch.column(1))
            gaps = np.flatnonzero((head.find(parts.hashes()) < 0) & (parts.special < 0))
            text = np.searchsorted(parts.first, gaps, "right") - 1
            number = np.arange(len(gaps)) - np.searchsorted(gaps, parts.first[text])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text)), pa.array(number.astype(np.int32)), parts.strings(gaps)],
                names=["text_id", "gap", "word"])

    keyed = plain.select(text_key(F.col("text")).alias("text_id"), "text")
    holes = keyed.mapInArrow(rare, "text_id binary, gap int, word string")
    # four bytes of the gap's number, highest first, and the ids; the set leaves one of what copies of a text repeat
    entry = F.concat(F.unhex(F.lpad(F.hex("gap"), 8, "0")), F.col("ids"))
    filled = holes.join(tail, "word").select("text_id", entry.alias("entry")).groupBy("text_id").agg(
        F.sort_array(F.collect_set("entry")).alias("fill"))

    names = [*keep, "text_id", "text"]
    kinds = dict(plain.dtypes)

    def known(batches):
        """The packed codes of every text, which take less room than its ids."""
        head, cut, pack = sent.value, splitter(path), zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, _ROWS):
            parts = cut.split(batch.column(len(keep) + 1))
            codes = _codes(parts, head)
            # the bytes of one significance together: the upper ones are mostly zero
            packed = [pack.compress(codes[a:b].view(np.uint8).reshape(-1, 4).T.tobytes()) for a, b in zip(parts.first[:-1], parts.first[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep) + 1)), pa.array(packed, pa.binary())], names=[*names[:-1], "codes"])

    kept = [f"`{n}` {kinds[n]}" for n in keep]
    coded = plain.select(*keep, text_key(F.col("text")).alias("text_id"), "text").mapInArrow(
        known, ", ".join([*kept, "text_id binary", "codes binary"]))
    joined = coded.join(filled, "text_id", "left").select(*keep, "codes", "fill")

    def fill(batches):
        head, unpack = sent.value, zstandard.ZstdDecompressor()
        for batch in slices(batches):
            out = []
            for packed, parts in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()):
                codes = np.frombuffer(unpack.decompress(packed), dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
                out.append(_ids(codes, head, parts or [], id_type))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(out, pa.binary())], names=[*keep, "ids"])

    return joined.mapInArrow(lambda batches: finish(fill(batches)), ", ".join([*kept, columns]))


def _joined(table, column, id_type):
    """For every row of ids the entries of a table at these ids with spaces between."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // np.dtype(id_type).itemsize
    ids = np.frombuffer(b"".join(column.to_pylist()), dtype=id_type)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    rows = pa.LargeListArray.from_arrays(pa.array(offsets), table.take(pa.array(ids)))
    return pc.binary_join(rows, " ")


def _digests(spaced, ids, sizes):
    """For texts of these sizes, whose ids follow each other, the SHA-256 of their entries with spaces between."""
    offsets, data = text_buffers(spaced.take(ids))
    ends = offsets[np.concatenate(([0], np.cumsum(sizes)))].tolist()
    data = memoryview(data)
    return pa.array([hashlib.sha256(data[a:max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1], ends[1:])], pa.string())


def _pieces(path):
    cut = splitter(path)
    if cut.tokenizer.decoder is not None:
        raise ValueError("decode is defined for files without a decoder, whose pieces are joined by spaces")
    return cut.pieces


def decode(coded, path, keep=("doc_id",)):
    """The kept columns with text: the pieces of the ids, joined as the library's decode joins them."""
    plain = columns_of(coded, *keep, "ids")
    kinds = dict(plain.dtypes)

    def pieces(batches):
        for batch in slices(batches):
            texts = _joined(_pieces(path), batch.column(len(keep)).fill_null(b""), splitter(path).id_type)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), texts.cast(pa.string())], names=[*keep, "text"])

    return plain.mapInArrow(pieces, ", ".join([*(f"`{n}` {kinds[n]}" for n in keep), "text string"]))


def digests(docs, path, head_words=HEAD_WORDS):
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    _pieces(path)

    def digest(batches):
        cut = splitter(path)
        size = np.dtype(cut.id_type).itemsize
        for batch in slices(batches, 128):
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) // size
            ids = pa.array(np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=cut.id_type))
            hashed = [_digests(spaced, ids, sizes) for spaced in cut.spaced]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), *hashed], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encode(docs, path, head_words, ("doc_id",), digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")
