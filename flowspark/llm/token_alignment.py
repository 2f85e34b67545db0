"""Alignment of the tokens of two tokenizers over the bytes of a text.

A is a byte-level BPE over a space and the text, B a merge-type piece model over the text, which puts the
space there itself. The cumulative byte ends of both id lists go into dictionaries from end to index; the
ends that both have, by set intersection and in order, cut the lists into groups, and links are expanded
group by group: the occurrences of A and B whose byte ranges end together, which are the last ones of a
group's two slices.

A text is cut first where both tokenizers certainly end a token: before white space, and between a letter
and ASCII punctuation, unless a piece of B connects the two. Parts are aligned once and kept in a bounded
table in every worker; a text's lists are those of its parts in order.

How often an id pair is linked is counted over all documents. Pairs with the highest counts, at most
`head_pairs` of them, go to the tasks as sorted arrays; links with any other pair are joined with the
table of pairs, so no count is left out at any size.

Defined cases: null and empty texts, and texts whose joined token bytes differ from the space and the
text (U+2581 in the text, which B takes for a space), have no tokens: counts are 0 and the digest is ''.
Strings of special tokens are plain text. Rows that repeat an id are rows of their own; further columns
are ignored; an empty table gives no rows. Texts are taken whole.
"""

import hashlib
import os
import re
import sys
import zlib
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from flowspark.llm.bpe import head_cut
from flowspark.llm.keys import columns_of
from flowspark.llm.piece_bpe import Bounded, file_content, model_of
from flowspark.llm.words import slices
from flowspark.session import materialise

#: Pairs that every task holds, parts that a worker keeps, pairs that a task counts before it hands them on.
HEAD_PAIRS, _PARTS, _HELD = 500_000, 500_000, 1_000_000
_ROWS = 256
#: Bits of an id of B in the number that stands for a pair.
_SHIFT = 20
#: Characters that the byte-level pattern takes for white space, and letters and marks between which it
#: always ends a word. Fixed values.
_SPACE = "\t-\r \x85\xa0  -     　"
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_MARK = "!-@\\[-`{-~"
#: Appended to a piece model, it takes back the space put before a text: normaliser settings (field 3) in
#: which field 3 is 0; of a repeated setting the last one holds.
_NO_SPACE_BEFORE = bytes([3 << 3 | 2, 2, 3 << 3, 0])


def _byte_of_entry():
    """The byte that each character of a byte-level entry stands for: printable bytes are themselves, others follow 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def cut_groups(a_ends, b_ends):
    """Groups as (start and stop in A, start and stop in B), from cumulative byte ends.

    The tokens of a group that end together, its link, are the last of either slice.
    """
    a_at, b_at = dict(zip(a_ends, range(1, len(a_ends) + 1))), dict(zip(b_ends, range(1, len(b_ends) + 1)))
    groups, a, b = [], 0, 0
    for end in sorted(a_at.keys() & b_at.keys()):
        i, j = a_at[end], b_at[end]
        groups.append((a, i, b, j))
        a, b = i, j
    return groups


class Aligner:
    """Both tokenizers and the table of aligned parts."""

    def __init__(self, byte_file, piece_file):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.bytes_model = Tokenizer.from_str(byte_file.decode())
        self.bytes_model.no_truncation()
        self.bytes_model.no_padding()
        self.bytes_model.encode_special_tokens = True
        value = _byte_of_entry()
        vocabulary = self.bytes_model.get_vocab(with_added_tokens=False)
        self.entry = {i: bytes(value[c] for c in entry) for entry, i in vocabulary.items()}
        self.pieces = model_of(piece_file)
        self.piece_model = SentencePieceProcessor(model_proto=piece_file + _NO_SPACE_BEFORE)
        self.a_size, self.b_size = {i: len(b) for i, b in self.entry.items()}, list(map(len, self.pieces.piece_bytes))
        self.numbers = list(map(str, range(max(max(self.entry) + 1, len(self.b_size)))))
        if len(self.numbers) >> _SHIFT:
            raise ValueError(f"ids of {_SHIFT} bits at most")
        self.parts = Bounded(None, _PARTS)
        self._part = self._parts_pattern({b.replace("▁", " ") for b in self.pieces.touching})

    @staticmethod
    def _parts_pattern(touching):
        """White space and what follows it to the next white space, or to a mark after a letter.

        White space that pieces take after another character, such as a carriage return, goes on with the part.
        """
        spaces, letters, marks = (re.compile(f"[{c}]") for c in (_SPACE, _LETTER, _MARK))
        bound = "".join(sorted({re.escape(b[1]) for b in touching if spaces.match(b[1]) and not spaces.match(b[0])}))
        way = f"[{_SPACE}]*[^{_SPACE}]+" + (f"(?:[{bound}][{_SPACE}]*[^{_SPACE}]*)*" if bound else "")
        ways = [way, f"[{_SPACE}]+"]
        if not any(letters.match(b[0]) and marks.match(b[1]) for b in touching):
            ways.insert(0, f"[{_SPACE}]*[{_LETTER}]+(?=[{_MARK}])")
        return re.compile("|".join(ways))

    def cut(self, text):
        return self._part.findall(" " + text)

    def align(self, part, a, b):
        """(groups as text, pairs, tokens of A, tokens of B) of a part with its ids; pairs are None if bytes differ."""
        raw = part.encode()
        if b"".join(map(self.entry.__getitem__, a)) != raw or b"".join(map(self.pieces.piece_bytes.__getitem__, b)) != raw:
            return "", None, 0, 0
        a_said, b_said = list(map(self.numbers.__getitem__, a)), list(map(self.numbers.__getitem__, b))
        if len(a) == 1 or len(b) == 1:
            # one token ends where the part does, so the part is one group
            return f"{','.join(a_said)}|{','.join(b_said)}", (a[-1] << _SHIFT | b[-1]).to_bytes(8, sys.byteorder), len(a), len(b)
        groups = cut_groups(list(accumulate(map(self.a_size.__getitem__, a))), list(accumulate(map(self.b_size.__getitem__, b))))
        said = ";".join([f"{','.join(a_said[i:j])}|{','.join(b_said[k:l])}" for i, j, k, l in groups])
        pairs = array("q", [a[j - 1] << _SHIFT | b[l - 1] for _, j, _, l in groups]).tobytes()
        return said, pairs, len(a), len(b)

    def learn(self, texts):
        """Align the parts of texts that the table does not hold; returns the parts of every text."""
        cut = [self.cut(t) if t else [] for t in texts]
        asked = {p for parts in cut for p in parts if p not in self.parts}
        if asked:
            full = len(self.parts)
            self.parts.room(len(asked))
            if len(self.parts) < full:
                asked = {p for parts in cut for p in parts}
        self.parts.update((p, self.parts.before[p]) for p in asked & self.parts.before.keys())
        new = [p for p in asked if p not in self.parts]
        for i in range(0, len(new), 10_000):
            some = new[i:i + 10_000]
            first = self.bytes_model.encode_batch_fast(some, add_special_tokens=False)
            for part, a, b in zip(some, first, self.piece_model.encode(some, num_threads=1)):
                self.parts[part] = self.align(part, a.ids, b)
        return cut

    def of(self, parts):
        """The alignment of a text: what align() gives for a part, for all parts together, and the number of groups."""
        if not parts:
            return "", b"", 0, 0, 0
        said, pairs, n_a, n_b = zip(*map(self.parts.__getitem__, parts))
        if None in pairs:
            return "", b"", 0, 0, 0
        pairs = b"".join(pairs)
        return ";".join(said), pairs, sum(n_a), sum(n_b), len(pairs) // 8


_aligners = {}


def _aligner(byte_file, piece_file):
    """One aligner for each pair of files and worker process."""
    key = zlib.crc32(byte_file), zlib.crc32(piece_file), len(byte_file), len(piece_file)
    if key not in _aligners:
        _aligners[key] = Aligner(byte_file, piece_file)
    return _aligners[key]


def groups(docs, byte_path, piece_path, keep=("doc_id",)):
    """The kept columns with groups: an array of (a, b), the ids of A and B between two common ends."""
    files = file_content(byte_path), file_content(piece_path)
    plain = columns_of(docs, *keep, "text")
    types = dict(plain.dtypes)

    def run(batches):
        for batch in slices(batches, 32):
            aligner, rows = _aligner(*files), []
            for parts in aligner.learn(batch.column(len(keep)).to_pylist()):
                said = aligner.of(parts)[0]
                sides = [g.split("|") for g in said.split(";")] if said else []
                rows.append([{"a": [int(i) for i in a.split(",")], "b": [int(i) for i in b.split(",")]} for a, b in sides])
            kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(rows, kind)], names=[*keep, "groups"])

    return plain.mapInArrow(run, ", ".join([*(f"`{n}` {types[n]}" for n in keep), "groups array<struct<a:array<int>,b:array<int>>>"]))


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def linked(docs, byte_path, piece_path):
    """A written table: row, doc_id, the counts, groups_sha256, and the linked pairs with how often each occurs."""
    files = file_content(byte_path), file_content(piece_path)
    names = ["doc_id", *_COUNTS, "groups_sha256", "pairs", "times"]

    def run(batches):
        for batch in slices(batches, _ROWS):
            aligner = _aligner(*files)
            rows = [aligner.of(parts) for parts in aligner.learn(batch.column(1).to_pylist())]
            held = [np.frombuffer(r[1], dtype=np.int64) for r in rows]
            number = np.repeat(np.arange(len(rows), dtype=np.int64), [len(h) for h in held]) << 2 * _SHIFT
            both, times = np.unique(number | np.concatenate(held), return_counts=True)
            offsets = pa.array(np.searchsorted(both, np.arange(len(rows) + 1, dtype=np.int64) << 2 * _SHIFT).astype(np.int32))
            counts = [pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3, 4, 4)]
            digest = [hashlib.sha256(r[0].encode()).hexdigest() if r[0] else "" for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digest, pa.string()),
                 pa.ListArray.from_arrays(offsets, pa.array(both & ((1 << 2 * _SHIFT) - 1))),
                 pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))], names=names)

    found = columns_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS)
                                                          + ", groups_sha256 string, pairs array<long>, times array<int>")
    return materialise(found.withColumn("row", F.monotonically_increasing_id()), "alignment")


def pair_counts(links):
    """A written table: pair, n links over all documents, best: no pair with the same id of B has more."""

    def count(batches):
        held = []

        def summed():
            pairs, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return pairs, np.bincount(at, weights=np.concatenate([h[1] for h in held]), minlength=len(pairs)).astype(np.int64)

        for batch in slices(batches, 4 * _ROWS):
            held.append(tuple(batch.column(i).flatten().to_numpy() for i in (0, 1)))
            if sum(len(h[0]) for h in held) > _HELD:
                held = [summed()]
                if len(held[0][0]) > _HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["pair", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], names=["pair", "n"])

    counted = links.select("pairs", "times").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # the pairs of one id of B number no more than A has ids
    other = Window.partitionBy(F.col("pair").bitwiseAND((1 << _SHIFT) - 1))
    return materialise(counted.withColumn("best", F.col("n") == F.max("n").over(other)), "pair_counts")


def digests(docs, byte_path, piece_path, head_pairs=HEAD_PAIRS):
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    links = linked(docs, byte_path, piece_path)
    counts = pair_counts(links)
    cut_at = head_cut(counts, head_pairs)
    top = counts.where(F.lit(False) if cut_at is None else F.col("n") >= F.lit(cut_at)).orderBy("pair").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(tuple(top[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))
    rest = counts.where(F.lit(True) if cut_at is None else F.col("n") < F.lit(cut_at))
    kept = ["row", "doc_id", *_COUNTS, "groups_sha256"]

    def score(batches):
        known, n, best = sent.value
        for batch in slices(batches, 4 * _ROWS):
            pairs, times = (batch.column(len(kept) + i).flatten().to_numpy() for i in (0, 1))
            bounds = np.concatenate(([0], np.cumsum(batch.column(len(kept)).value_lengths().to_numpy())))
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), dtype=bool)
            worth = np.where(hit, n[at] * times, 0) if len(known) else np.zeros(len(pairs), dtype=np.int64)
            leads = np.where(hit & best[at], times, 0) if len(known) else worth
            sums = [np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[bounds] for x in (leads, worth)]
            missed = np.flatnonzero(~hit)
            offsets = pa.array(np.searchsorted(missed, bounds).astype(np.int32))
            more = pa.StructArray.from_arrays([pa.array(pairs[missed]), pa.array(times[missed])], names=["pair", "times"])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), *(pa.array(s[1:] - s[:-1]) for s in sums),
                 pa.ListArray.from_arrays(offsets, more)], names=[*kept, "n_best", "count_sum", "rest"])

    scored = materialise(links.select(*kept, "pairs", "times").mapInArrow(
        score, "row long, doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS)
        + ", groups_sha256 string, n_best long, count_sum long, rest array<struct<pair:long,times:int>>"), "scored")
    more = scored.select("row", F.inline("rest")).join(rest, "pair").groupBy("row").agg(
        F.sum(F.expr("if(best, times, 0)")).alias("more_best"), F.sum(F.expr("times * n")).alias("more_sum"))
    return scored.drop("rest").join(more, "row", "left").selectExpr(
        "doc_id", *_COUNTS, "n_best + coalesce(more_best, 0L) as n_best", "count_sum + coalesce(more_sum, 0L) as count_sum", "groups_sha256")
