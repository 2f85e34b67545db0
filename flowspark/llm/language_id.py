"""Language identification with blended-spectrum presence kernels and Nyström ridge regression.

A text is the set of its byte n-grams of two, three and four bytes, hashed to a fixed number of
cells for each length. The kernel of two texts is the mean over the lengths of |A and B| /
sqrt(|A| |B|). One-versus-rest kernel ridge regression is fitted over landmarks: with K the kernel of
the sample to the landmarks and M that of the landmarks, the weights solve (K'K + ridge n M) w = K'y.
As the kernel is a sum of normalised inner products, landmarks and weights fold into one matrix of
cells by languages, and whole texts are scored by products of presence rows with it, batch by batch.

The classifier is fitted on a bounded sample: of every language the `per_language` rows with the
least hash of text and id, `landmarks` of them being landmarks. Every document is scored.

Only text and non-null lang of documents with crc32(doc_id) mod 5 <> 0 are learned from; a null
doc_id is neither held out nor learned from. Defined cases: a text that is null or has no letter is
`und` with score 0; so is everything if there is nothing to learn from; ties go to the language that
sorts first; more than MAX_LANGUAGES values of lang are an error; repeated rows get equal results; other columns are ignored; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowspark.llm.keys import columns_of
from flowspark.llm.words import slices, text_buffers

PER_LANGUAGE = 250
LANDMARKS = 80
#: Languages a model may have, as it is one matrix of cells by languages; more are an error.
MAX_LANGUAGES = 1000
RIDGE = 1e-4
#: n-gram length and log2 of its cells.
SPECTRUM = ((2, 13), (3, 14), (4, 15))
_SIZES = [1 << bits for _, bits in SPECTRUM]
UNKNOWN = "und"

#: Bytes as the kernels see them: A-Z as a-z, all that is no letter of ASCII or above as a space.
_folded = np.full(256, 32, dtype=np.uint32)
_folded[97:123] = np.arange(97, 123)
_folded[65:91] = np.arange(97, 123)
_folded[128:] = np.arange(128, 256)


def presence(data, out):
    """Set the cells of a text's n-grams in one row (uint8) of cells."""
    folded = _folded[data]
    at = 0
    for (n, bits), size in zip(SPECTRUM, _SIZES):
        if len(folded) >= n:
            code = folded[:len(folded) - n + 1].copy()
            for k in range(1, n):
                code = code << np.uint32(8) | folded[k:len(folded) - n + 1 + k]
            # multiplicative hashing of the n bytes
            out[at + ((code * np.uint32(2654435761)) >> np.uint32(32 - bits))] = 1
        at += size


def has_letter(text):
    return text is not None and any(c.isalpha() for c in text)


def _rows(column):
    """Presence rows of a string array."""
    offsets, data = text_buffers(column)
    out = np.zeros((len(offsets) - 1, sum(_SIZES)), dtype=np.uint8)
    for i in range(len(out)):
        presence(data[offsets[i]:offsets[i + 1]], out[i])
    return out


def _parts(rows):
    """Normalised float rows for every n-gram length."""
    at = 0
    for size in _SIZES:
        part = rows[:, at:at + size].astype(np.float32)
        norm = np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1))
        yield at, part / norm
        at += size


def _packed_parts(packed, at, size):
    """(first row, normalised float rows) of packed rows for one n-gram length, few rows at a time."""
    for i in range(0, len(packed), 128):
        part = np.unpackbits(packed[i:i + 128, at // 8:(at + size) // 8], axis=1).astype(np.float32)
        part /= np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1))
        yield i, part


def _spans():
    """First cell and number of cells of every n-gram length."""
    return zip(np.cumsum([0, *_SIZES]).tolist(), _SIZES)


def _kernel(rows, others):
    """The kernel of packed rows."""
    total = np.zeros((len(rows), len(others)))
    for at, size in _spans():
        for j, right in _packed_parts(others, at, size):
            for i, left in _packed_parts(rows, at, size):
                total[i:i + len(left), j:j + len(right)] += left @ right.T
    return total / len(SPECTRUM)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(docs, per_language):
    """Presence rows and languages of the bounded sample."""
    learn = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out())
    counts = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    order = F.xxhash64("text", F.col("doc_id").cast("string")).alias("order")
    # hashes are spread evenly, so this share holds per_language rows and a margin
    share = F.least(F.lit(1.0), F.lit(per_language * 1.3 + 50) / F.col("n"))
    limits = counts.select("lang", (share * float(1 << 63) * 2 - float(1 << 63)).alias("limit"))
    rows = limits.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of lang")
    # counted above, so texts need not move to meet their language's limit
    limits = F.broadcast(docs.sparkSession.createDataFrame(rows, limits.schema))
    drawn = learn.select("lang", "text", order).join(limits, "lang").where(F.col("order").cast("double") <= F.col("limit"))

    def read(batches):
        for batch in slices(batches, 64):
            packed = np.packbits(_rows(batch.column(1)), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([p.tobytes() for p in packed], pa.binary())],
                names=["lang", "order", "cells"])

    kind = dict(docs.dtypes)["lang"]
    table = drawn.select("lang", "text", "order").mapInArrow(read, f"lang {kind}, order long, cells binary")
    found = sorted(map(tuple, table.collect()), key=lambda r: (str(r[0]), r[1], r[2]))
    taken, kept = {}, []
    for lang, _, cells in found:
        if taken.setdefault(lang, 0) < per_language:
            taken[lang] += 1
            kept.append((lang, taken[lang], np.frombuffer(cells, dtype=np.uint8)))
    return kept


def fit(docs, per_language=PER_LANGUAGE, landmarks=LANDMARKS, ridge=RIDGE):
    """(languages, matrix of cells by languages), or None when there is nothing to learn from."""
    kept = _sample(columns_of(docs, "doc_id", "text", "lang"), per_language)
    if not kept:
        return None
    languages = sorted({k[0] for k in kept})
    # rows stay packed, as the driver's memory is small: a thousand of them take 57 MB unpacked
    rows = np.stack([k[2] for k in kept])
    wanted = np.array([[float(k[0] == name) for name in languages] for k in kept])
    marks = rows[[k[1] <= landmarks for k in kept]]
    cross, inner = _kernel(rows, marks), _kernel(marks, marks)
    left = cross.T @ cross + ridge * len(rows) * inner + 1e-9 * np.eye(len(marks))
    weights = np.linalg.solve(left, cross.T @ wanted)
    folded = np.concatenate([
        sum(part.T @ weights[i:i + len(part)] for i, part in _packed_parts(marks, at, size)) for at, size in _spans()
    ]) / len(SPECTRUM)
    return languages, folded.astype(np.float32)


def predict(docs, model, keep=("doc_id",)):
    """The kept columns with lang_pred and score for every row."""
    plain = columns_of(docs, *keep, "text")
    kinds = dict(plain.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        languages, matrix = sent.value or ([], None)
        for batch in slices(batches, 64):
            column = batch.column(len(keep))
            names, scores = [], []
            best = np.zeros((batch.num_rows, max(1, len(languages))))
            if languages:
                for at, part in _parts(_rows(column)):
                    best += part @ matrix[at:at + part.shape[1]]
            for row, text in zip(best, column.to_pylist()):
                known = bool(languages) and has_letter(text)
                top = int(np.argmax(row))
                names.append(languages[top] if known else UNKNOWN)
                scores.append(float(min(1.0, max(0.0, row[top]))) if known else 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*keep, "lang_pred", "score"])

    return plain.mapInArrow(score, ", ".join([*(f"`{n}` {kinds[n]}" for n in keep), "lang_pred string", "score double"]))


def identify(docs, **settings):
    """Per document: doc_id, held_out, lang_pred, score."""
    rows = predict(docs, fit(docs, **settings))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs, least=0.2, **settings):
    """The documents, with all their columns, whose language is told with at least this score."""
    model = fit(docs, **settings)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def sift(batches):
        languages, matrix = sent.value or ([], None)
        for batch in slices(batches, 64):
            column = batch.column(at)
            best = np.zeros((batch.num_rows, max(1, len(languages))))
            if languages:
                for cell, part in _parts(_rows(column)):
                    best += part @ matrix[cell:cell + part.shape[1]]
            told = [bool(languages) and has_letter(t) and row.max() >= least for t, row in zip(column.to_pylist(), best)]
            yield batch.filter(pa.array(told, pa.bool_()))

    return docs.mapInArrow(sift, docs.schema)
