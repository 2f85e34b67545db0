"""Set-similarity join on word n-grams with rare-first prefixes.

Every text becomes a set of shingle tokens in one global order, rare shingles first: shingles that many
texts hold come last, and within both parts a shingle comes the earlier the less often its words occur
in all texts. Texts with equal sets form a class; the join runs on classes. Two sets can only reach the similarity when they share a
token in their prefixes, so prefixes are the index. A posting pair is dropped by three exact bounds:
length, position (tokens before the shared one that no other prefix holds cannot be shared) and a
suffix bound (the sets differ in at least as many tokens as their parities over 256 token ranges do).
What is left is verified once per pair against the whole sets.

Groups are never paired with themselves outright. The first pass links every posting group with one
hub for each length band, the member with most shared prefix tokens; verified links make components.
The second pass takes the pairs of a group whose ends are not yet in one component, with all three
bounds inside the join. So a group of copies costs its size, and no link between components is lost.
A pair that shares many tokens is taken at the first of them: where a token of the few before the shared
one is shared as well, the pair has been met there, and the bounds hold at every token that a link shares.

That gives the components, which are all that one row of every group needs (similar_groups). Links are
counted by similar_links and listed by similar_pairs: every link lies inside a component, so there the
classes of a component are dealt to tiles, and each pair of classes is compared once over the whole
sets, tile against tile. Counting makes a row for each class and tile, not for each pair.

Defined cases: null and empty texts, or texts without words, have an empty set and link with nothing;
a text with fewer words than a shingle is one shingle of all its words. Rows with equal texts or equal
ids are rows of their own with equal results. A null doc_id stays null and is not taken as the smallest
id unless all ids of its component are null. Other columns are ignored. Empty tables give no rows.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowspark.llm.components import connected_components
from flowspark.llm.keys import columns_of, free_names, text_key
from flowspark.llm.words import WHITE_SPACE, slices, windows, words_of
from flowspark.session import materialise, release

#: Words are counted in this many cells; only the order of the tokens depends on it.
CELL_BITS = 20
_CELLS = 1 << CELL_BITS
#: A token is crowded when more texts than this hold it among the first of their order.
CROWD = 32
#: So many tokens before a posting tell whether a pair was met before.
EARLIER = 4
#: Sets that go to the tasks are sets of bits of this fixed size, which may let more pass.
CROWD_BITS = 24
#: A tile holds about this many classes, or this many tokens if those are fewer classes.
TILE, TILE_TOKENS = 1024, 1 << 20
_WEIGHT_SHIFT, _HASH_SHIFT = np.uint64(51), np.uint64(13)


def word_weights(docs):
    """For every counting cell 16 * log2 of how many words of all texts fall in it."""

    def count(batches):
        total = np.zeros(_CELLS, dtype=np.int64)
        for batch in slices(batches):
            hashes, _ = words_of(batch.column(0), WHITE_SPACE)
            total += np.bincount((hashes & np.uint64(_CELLS - 1)).astype(np.int64), minlength=_CELLS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["cell", "n"])

    counts = docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most _CELLS rows
    n = np.ones(_CELLS, dtype=np.int64)
    n[table["cell"].to_numpy()] = table["n"].to_numpy()
    return np.minimum(16 * np.log2(n), 800).astype(np.uint16)


def _tokens(shingles, weights, crowded):
    tokens = (np.minimum(weights, 4095).astype(np.uint64) << _WEIGHT_SHIFT) | (shingles >> _HASH_SHIFT)
    if crowded is not None:
        tokens |= _in_bits(crowded, tokens.view(np.int64)).astype(np.uint64) << np.uint64(63)
    return tokens


def tokens_by_text(column, words, order):
    """Yield each text's distinct tokens, first of the global order first."""
    weights, crowded = order
    hashes, first = words_of(column, WHITE_SPACE)
    sums = np.concatenate(([0], np.cumsum(weights[(hashes & np.uint64(_CELLS - 1)).astype(np.int64)], dtype=np.int64)))
    every = windows(hashes, words)
    every = _tokens(every, sums[words:words + len(every)] - sums[:len(every)], crowded)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            yield np.unique(every[a:b - words + 1])
        elif b > a:
            yield _tokens(windows(hashes[a:b], b - a), sums[b:b + 1] - sums[a:a + 1], crowded)
        else:
            yield every[:0]


def _prefix(tokens, percent, share=1):
    """The first tokens, `share` times as many as any similar set must share one of."""
    return tokens[:share * (len(tokens) - _overlap_needed(len(tokens), percent) + 1)].view(np.int64)


def crowded_tokens(docs, weights, words, percent):
    """Bits of the tokens that more than CROWD texts hold within twice their prefix."""
    sent = docs.sparkSession.sparkContext.broadcast((weights, None))

    def emit(batches):
        for batch in slices(batches):
            found = [_prefix(t, percent, 2) for t in tokens_by_text(batch.column(0), words, sent.value) if len(t)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["token"])

    counts = docs.select("text").mapInArrow(emit, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    bits = _bits(counts.where(F.col("n") > CROWD).select("token"))
    release(docs.sparkSession, sent)
    return bits


def _bits(numbers):
    """A set of long numbers as 2**CROWD_BITS bits, by the numbers' last bits."""
    size = 1 << CROWD_BITS
    (name,) = numbers.columns
    at = numbers.select(F.col(name).bitwiseAND(size - 1).cast("int").alias("at")).distinct()
    at = at.toArrow()["at"].to_numpy()  # at most 2**CROWD_BITS rows
    bits = np.zeros(size >> 3, dtype=np.uint8)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


def _in_bits(bits, numbers):
    at = numbers & ((1 << CROWD_BITS) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1


def _parity(tokens):
    bits = np.bincount((tokens & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _lists(arrays):
    ends = np.cumsum([0, *(len(a) for a in arrays)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _overlap_needed(size, percent):
    """Least overlap of a set of this size with any set that reaches the similarity."""
    return -(-size * percent // 100)


def token_sets(docs, order, words, percent):
    """A written table, per row: doc_id, text_id, n (set size), sig (equal for equal sets), prefix tokens and parities."""
    sent = docs.sparkSession.sparkContext.broadcast(order)

    def build(batches):
        for batch in slices(batches):
            sizes, sigs, prefixes, parities = [], [], [], []
            for tokens in tokens_by_text(batch.column(1), words, sent.value):
                sizes.append(len(tokens))
                sigs.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                prefixes.append(_prefix(tokens, percent) if len(tokens) else tokens.view(np.int64))
                parities.append(_parity(tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()),
                 _lists(prefixes), _lists(parities)],
                names=["doc_id", "text_id", "n", "sig", "prefix", "parity"])

    kind = dict(docs.dtypes)["doc_id"]
    sets = materialise(docs.select("doc_id", "text", text_key(F.col("text")).alias("text_id")).mapInArrow(
        build, f"doc_id {kind}, text_id binary, n long, sig binary, prefix array<long>, parity array<long>"), "token_sets")
    release(docs.sparkSession, sent)
    return sets


def _postings(classes):
    """Prefix tokens that at least two classes hold: (token, id, n, width, free, pos).

    `free` counts the tokens of the prefix before this one that some other prefix holds too, `width`
    all of them.
    """
    every = classes.select("id", F.posexplode("prefix").alias("pos", "token"))
    shared = every.groupBy("token").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1").select("token")
    kept = every.join(shared, "token").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("tokens"))
    per_class = kept.join(classes.select("id", F.col("n").cast("int").alias("n")), "id")
    return per_class.select("id", "n", F.size("tokens").alias("width"), F.posexplode("tokens").alias("free", "t")).select(
        F.col("t.token").alias("token"), "id", "n", "width", "free", F.col("t.pos").alias("pos"))


def _needed(na, nb, percent):
    """Least intersection of similar sets: intersection * (100 + percent) >= percent * (na + nb)."""
    return F.ceil((na + nb) * percent / F.lit(100 + percent) - F.lit(1e-6))


def _may_link(percent):
    """The length and the position bound for a token that the sets a and b share in their prefixes."""
    na, nb = F.col("a_n"), F.col("b_n")
    rest = F.least(na - F.col("a_pos"), nb - F.col("b_pos"))
    before = F.least("a_free", "b_free")
    return (na * 100 >= nb * percent) & (nb * 100 >= na * percent) & (before + rest >= _needed(na, nb, percent))


_SIDE = ("id", "n", "pos", "free")


def _side(postings, side, *more):
    return postings.select("token", *[F.col(c).alias(f"{side}_{c}") for c in _SIDE], *more)


def _hub_pairs(postings, percent):
    """Pairs of each class with the hub of its posting group, for its own and the next length band."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent)))
    banded = postings.withColumn("band", band.cast("int"))
    best = F.struct((-F.col("width")).alias("rank"), *_SIDE)
    hubs = banded.groupBy("token", "band").agg(F.min(best).alias("h"))
    hubs = hubs.select("token", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"),
                       *[F.col(f"h.{c}").alias(f"a_{c}") for c in _SIDE])
    joined = _side(banded, "b", "band").join(hubs, ["token", "band"])
    return joined.where((F.col("a_id") != F.col("b_id")) & _may_link(percent))


def _cross_pairs(postings, classes, parts, percent):
    """Pairs of a posting group whose ends are in different components, with all bounds in the join; and the
    written table that they come from."""
    marked = postings.join(parts, postings["id"] == parts["node"], "left").withColumn(
        "part", F.coalesce("component", "id")).drop("node", "component")
    several = marked.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    marked = marked.join(several.where("low <> high").select("token"), "token")
    # a token that two components share is in the table for both
    before = F.collect_list("token").over(Window.partitionBy("id").orderBy("pos").rowsBetween(-EARLIER, -1))
    marked = materialise(marked.join(classes.select("id", "parity"), "id").withColumn("earlier", before), "marked")
    a = _side(marked, "a", F.col("part").alias("a_part"), F.col("parity").alias("pa"), F.col("earlier").alias("ea"))
    b = _side(marked, "b", F.col("part").alias("b_part"), F.col("parity").alias("pb"), F.col("earlier").alias("eb"))
    return a.join(b, "token").where(
        (F.col("a_id") < F.col("b_id")) & (F.col("a_part") != F.col("b_part")) & ~F.arrays_overlap("ea", "eb") & _may_link(percent)
        & _few_differ(F.col("a_n"), F.col("b_n"), percent)).select("a_id", "b_id"), marked


def _few_differ(na, nb, percent):
    """The suffix bound: sets differ in at least as many tokens as their parities pa and pb do."""
    differ = sum((F.bit_count(F.get("pa", F.lit(i)).bitwiseXOR(F.get("pb", F.lit(i)))) for i in range(4)), F.lit(0))
    return differ <= na + nb - 2 * _needed(na, nb, percent)


def _suffix_bound(pairs, classes, percent):
    """The pairs whose sets differ in few enough tokens, as far as their parities tell."""
    info = classes.select("id", "n", "parity")
    a = info.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    b = info.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    return pairs.join(a, "a").join(b, "b").where(_few_differ(F.col("na"), F.col("nb"), percent)).select("a", "b")


def _verified(pairs, docs, classes, order, words, percent, spent=()):
    """A written table of the pairs that reach the similarity, each compared once over the whole sets.

    Tables in spent are those that the pairs come from and nothing else needs.
    """
    pairs = pairs.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()
    pairs = materialise(_suffix_bound(pairs, classes, percent), "pairs")
    release(docs.sparkSession, *spent)
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _sets_of(classes.join(ends, "id"), docs, order, words)
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("right"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - shared
    links = materialise(both.where(shared * 100 >= union * percent).select("a", "b"), "links")
    release(docs.sparkSession, pairs, sets)
    return links


def _sets_of(classes, docs, order, words):
    """The whole token set of each class: (id, tokens)."""
    wanted = materialise(classes.select("text_id", "id"), "wanted")
    bits = _bits(wanted.select(F.xxhash64("text_id").alias("h")))
    sent = docs.sparkSession.sparkContext.broadcast((order, bits))

    def tokens(batches):
        """Token sets of the texts that may be wanted, so that only these are shuffled."""
        order, bits = sent.value
        done = set()
        for batch in slices(batches):
            found = np.flatnonzero(_in_bits(bits, batch.column(2).to_numpy()))
            fresh = [i for i, key in zip(found, batch.column(0).take(pa.array(found)).to_pylist())
                     if key not in done and not done.add(key)]
            if len(done) > 1 << 16:
                done.clear()
            part = batch.take(pa.array(fresh, pa.int64()))
            sets = [t.view(np.int64) for t in tokens_by_text(part.column(1), words, order)]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(sets)], names=["text_id", "tokens"])

    key = text_key(F.col("text"))
    texts = docs.select(key.alias("text_id"), "text").select("text_id", "text", F.xxhash64("text_id").alias("h"))
    sets = texts.mapInArrow(tokens, "text_id binary, tokens array<long>").join(wanted, "text_id")
    sets = materialise(sets.groupBy("id").agg(F.first("tokens").alias("tokens")), "sets")
    release(docs.sparkSession, wanted, sent)
    return sets


def _groups(docs, words, percent):
    """(doc_id and text, token order, sets, classes, components of classes that have links)."""
    plain = columns_of(docs, "doc_id", "text")
    weights = word_weights(plain)
    order = (weights, crowded_tokens(plain, weights, words, percent))
    wide = token_sets(plain, order, words, percent)
    classes = wide.where("n > 0").groupBy("sig").agg(
        F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"),
        F.first("parity").alias("parity"), F.min("text_id").alias("text_id"), F.count(F.lit(1)).alias("n_rows"))
    # the number is drawn once, when the table is written
    with_prefix = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    # prefixes are needed for the postings only; what goes on is written without them
    sets = materialise(wide.drop("prefix", "parity"), "rows")
    classes = materialise(with_prefix.drop("prefix"), "classes")
    release(plain.sparkSession, wide)
    postings = materialise(_postings(with_prefix), "postings")
    release(plain.sparkSession, with_prefix)
    links = _verified(_hub_pairs(postings, percent), plain, classes, order, words, percent)
    parts = connected_components(links, "a", "b")
    cross, marked = _cross_pairs(postings, classes, parts, percent)
    more = _verified(cross, plain, classes, order, words, percent, (marked, postings, parts))
    parts = connected_components(links.unionByName(more), "a", "b")
    release(plain.sparkSession, links, more)
    return plain, order, sets, classes, parts


def _members(sets, classes, parts, *more):
    """Per row: doc_id, n_shingles, component_id, text_id, part and the named columns of its class."""
    named = classes.join(parts, F.col("id") == F.col("node"), "left").select(
        "sig", "least_id", F.coalesce("component", "id").alias("part"), *more)
    least = named.groupBy("part").agg(F.min("least_id").alias("component_id"))
    by_class = named.join(least, "part").select("sig", "component_id", "part", *more)
    out = sets.select("doc_id", "n", "sig", "text_id").join(by_class, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.coalesce("component_id", "doc_id").alias("component_id"), "text_id", "part", *more)


def similar_groups(docs, words=3, percent=90):
    """Per row of docs: doc_id, n_shingles, component_id, text_id, part.

    Two rows link when 100 * intersection >= percent * union of their shingle sets; component_id is
    the least doc_id reachable by links, its own id for a row without links. part names the component
    and is null for an empty set. Links are verified as far as the components need them.
    """
    _, _, sets, classes, parts = _groups(docs, words, percent)
    return _members(sets, classes, parts)


def _tiles(sets, classes, parts, tile):
    """Classes of each component, once for every pair of tiles that theirs is in: (part, low, high, second, id, n_rows, tokens)."""
    inside = classes.join(parts, F.col("id") == F.col("node")).select("id", "n", "n_rows", F.col("component").alias("part"))
    counts = inside.groupBy("part").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / tile, F.sum("n") / TILE_TOKENS)).cast("int").alias("n_tiles"))
    dealt = inside.join(counts, "part").withColumn("own", F.pmod(F.xxhash64("id"), F.col("n_tiles")).cast("int"))
    every = dealt.join(sets, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)))
    return every.select("part", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                        (F.col("own") > F.col("other")).alias("second"), "id", "n_rows", "tokens")


def _linked(table, percent):
    """(place of each first class, places of the classes linked to it) of one pair of tiles, every pair of classes once."""
    lists = table["tokens"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    sizes = np.diff(first)
    terms, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    second = table["second"].to_numpy()
    here = np.zeros(len(terms), dtype=bool)
    # within one tile a class is compared with those after it
    one_tile = table["low"][0] == table["high"][0]
    ends = np.arange(len(sizes)) if one_tile else np.flatnonzero(second)
    right = codes if one_tile else np.concatenate([codes[first[k]:first[k + 1]] for k in ends] or [codes[:0]])
    starts = np.concatenate(([0], np.cumsum(sizes[ends])))
    for i in np.flatnonzero(~second):
        skip = i + 1 if one_tile else 0
        if skip >= len(ends):
            continue
        here[codes[first[i]:first[i + 1]]] = True
        shared = np.add.reduceat(here[right[starts[skip]:]], starts[skip:-1] - starts[skip], dtype=np.int64)
        here[codes[first[i]:first[i + 1]]] = False
        yield i, ends[skip:][shared * 100 >= (sizes[i] + sizes[ends[skip:]] - shared) * percent]


def _pairs_of(table, percent):
    ids = table["id"].to_numpy()
    found = [(np.full(len(at), ids[i]), ids[at]) for i, at in _linked(table, percent) if len(at)]
    a, b = (np.concatenate([x[k] for x in found] or [ids[:0]]) for k in (0, 1))
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _counts_of(table, percent):
    ids, rows = table["id"].to_numpy(), table["n_rows"].to_numpy()
    total = np.zeros(len(ids), dtype=np.int64)
    for i, at in _linked(table, percent):
        total[i] += rows[at].sum()
        total[at] += rows[i]
    return pa.table({"id": ids, "n_linked": total})


def _by_tiles(groups, words, percent, tile, function, schema):
    plain, order, _, classes, parts = groups
    sets = _sets_of(classes.join(parts, F.col("id") == F.col("node")), plain, order, words)
    tiles = _tiles(sets, classes, parts, tile)
    return tiles.groupBy("part", "low", "high").applyInArrow(lambda table: function(table, percent), schema)


def similar_pairs(docs, words=3, percent=90, tile=TILE):
    """Two tables: per row doc_id, n_shingles, component_id, text_id, part and class id; and every pair a < b of
    linked classes, once. Rows of one class link with each other and with all rows of linked classes."""
    groups = _groups(docs, words, percent)
    return (_members(*groups[2:], "id"), _by_tiles(groups, words, percent, tile, _pairs_of, "a long, b long"))


def similar_links(docs, words=3, percent=90, tile=TILE):
    """Per row of docs: the columns of similar_groups and n_links, the number of other rows it links with."""
    groups = _groups(docs, words, percent)
    _, _, sets, classes, parts = groups
    counts = _by_tiles(groups, words, percent, tile, _counts_of, "id long, n_linked long")
    counts = counts.groupBy("id").agg(F.sum("n_linked").alias("n_linked"))
    classes = classes.join(counts, "id", "left").withColumn(
        "n_links", F.col("n_rows") - 1 + F.coalesce("n_linked", F.lit(0)))
    members = _members(sets, materialise(classes.select("id", "sig", "least_id", "n_links"), "counted"), parts, "n_links")
    return members.withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))


def keep_one_of_each_group(docs, words=5, percent=80):
    """One row of every group of similar documents, with all its columns: the one with the least
    doc_id (null ids last, ties by text). Documents without words stay. Rows that repeat both id and
    text of the one that stays are left out.
    """
    _, _, sets, classes, parts = _groups(docs, words, percent)
    members = materialise(_members(sets, classes, parts), "groups")
    release(docs.sparkSession, sets, classes, parts)
    groups = members.where("part is not null")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_id")
    first = groups.groupBy("part").agg(F.min(order).alias("first")).select(
        "part", F.col("first.doc_id").alias("first_id"), F.col("first.text_id").alias("first_text"))
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_id") == F.col("first_text"))
    ident, text, gone, repeated = free_names(docs, "id", "text", "gone", "repeated")
    marks = groups.join(first, "part").groupBy("doc_id", "text_id").agg(
        (~F.max(same)).alias(gone), (F.count(F.lit(1)) > 1).alias(repeated))
    marks = materialise(marks.where(F.col(gone) | F.col(repeated)).select(
        F.col("doc_id").alias(ident), F.col("text_id").alias(text), gone, repeated), "marks")
    release(docs.sparkSession, members)
    marked = docs.join(marks, F.col("doc_id").eqNullSafe(F.col(ident)) & (text_key(F.col("text")) == F.col(text)), "left")
    kept = marked.where(~F.coalesce(gone, F.lit(False)))
    once = kept.where(~F.coalesce(repeated, F.lit(False))).select(docs["*"])
    if marks.where(F.col(repeated) & ~F.col(gone)).isEmpty():
        return once
    twice = kept.where(repeated).dropDuplicates([ident, text]).select(docs["*"])
    return once.unionByName(twice)
