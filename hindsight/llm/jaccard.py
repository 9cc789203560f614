"""Documents that share most of their word shingles: a blocked sparse product.

The incidence matrix of documents and shingles is cut into blocks of columns (`repeats`),
where shingles of one document only, which add nothing to any product, drop out.  What is
left of a document is ordered from its rarest shingle on.  Sizes bound the rest: a document
of n shingles that reaches the threshold with any other shares ceil(t * n) of them at least,
so both have one among their first n - ceil(t * n) + 1 in common: only in the columns of these
firsts do rows meet.  In the first column that two rows have in common, neither shares more
than what it has from there on, so a row leaves the columns where that is too little for the
smallest of the others.  Pairs that cannot reach the bound, by their sizes, by what they have
left, and by a sketch of it, are discarded where they meet; the others get their product from
the two whole rows.

Only components are asked for, so pairs within one are not needed.  Rows first meet some that
lead a column of theirs, and are merged if linked, a few times over, and only what lies in
different components after that meets pairwise.  Leaders are the rows with the most common
shingles: of near copies those with the fewest changes, which are linked with most others, while
two of any are not where each has changes of its own.  So a group of near copies costs a few
products for each copy, and nothing is left out: a pair is never compared only if its two
documents are known to be connected, or the bounds say that they are not linked.

Documents with one and the same set are one row of the matrix.

Cases: a null or empty text has an empty set and is linked with nothing; a text of fewer words
than a shingle has is one shingle; repeated rows are copies of each other, rows without a number
come after all others; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindsight.llm.arrays import LOWER, mix, running_sums, signed, slices, span_hashes, windows, words
from hindsight.llm.repeats import HOT_OWNERS, Entries, bucket_bits, pack_entries, shared_entries
from hindsight.llm.shared import components, order_key, sent_if_small, settle

SHINGLE = 5
#: Documents are linked if PERCENT * union <= 100 * intersection.
PERCENT = 75
#: How often rows meet leaders of their columns before all that is left meets, and how many.
TURNS = 2
LEADERS = 3
#: Longs of a row's sketch.
SKETCH = 16


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle) of each distinct shingle, by text, and each text's set number.

    Texts with equal sets have equal set numbers, which are never negative; -1: no set.
    """
    count = len(at) - 1
    low = LOWER[data]
    begin, end, text = words(low, at)
    word = span_hashes(running_sums(low), begin, end)
    runs = windows(word, size)
    inside = np.flatnonzero(text[: len(runs)] == text[size - 1 :]) if len(runs) else np.zeros(0, np.int64)
    owner, shingle = text[inside], runs[inside]
    # the whole sequence of short texts, told apart from shingles by its length
    per = np.bincount(text, minlength=count)
    first = np.searchsorted(text, np.arange(count))
    for i in np.flatnonzero((per > 0) & (per < size)):
        whole = mix(windows(word[first[i] : first[i] + per[i]], int(per[i])) + np.uint64(per[i]))
        owner, shingle = np.append(owner, i), np.append(shingle, whole)
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    owner, shingle = owner[new], shingle[new]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(shingle ^ np.uint64(0x5DEECE66D)), dtype=np.uint64)])
    cuts = np.searchsorted(owner, np.arange(count + 1))
    sizes = np.diff(cuts)
    number = mix(sums[cuts[1:]] - sums[cuts[:-1]] + mix(sizes.astype(np.uint64))) >> np.uint64(1)
    return owner, shingle, np.where(sizes > 0, signed(number), -1)


def members(docs: DataFrame) -> DataFrame:
    """row, n_shingles, set_id of every document; `docs` has row (any type) and text."""
    kind = docs.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch):
                owner, _, sets = shingle_sets(data, at)
                sizes = np.bincount(owner, minlength=len(sets))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(sizes), pa.array(sets)], ["row", "n_shingles", "set_id"])

    return docs.select("row", "text").mapInArrow(run, f"row {kind}, n_shingles long, set_id long")


def _entries(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> Entries:
    owner, shingle, sets = shingle_sets(data, at)
    sizes = np.bincount(owner, minlength=len(sets))
    # one document of each set, sets in order
    _, one = np.unique(sets, return_index=True)
    chosen = np.zeros(len(sets), bool)
    chosen[one] = True
    kept = chosen[owner]
    owner, shingle = owner[kept], shingle[kept]
    order = np.argsort(sets[owner], kind="stable")
    owner, shingle = owner[order], shingle[order]
    return shingle, sets[owner], sizes[owner]


def _needed(n: Column) -> Column:
    """The least a set of n shares with any set that it is linked with."""
    return F.ceil(n * PERCENT / 100)


def _needed_of_both(a: Column, b: Column) -> Column:
    """The least that linked sets of a and of b share."""
    return F.ceil((a + b) * PERCENT / (100 + PERCENT))


def _enough(overlap: Column, a: Column, b: Column) -> Column:
    """100 * overlap >= PERCENT * union."""
    return overlap * (100 + PERCENT) >= (a + b) * PERCENT


def rows_of_matrix(docs: DataFrame, bits: int, hot_owners: int = HOT_OWNERS) -> DataFrame:
    """(set_id, n, shared, popular): what can be linked, with its shared shingles, rarest first.

    `popular` is in how many sets a shingle of this one is, on average.
    """
    entries = shared_entries(pack_entries(docs.select("text"), _entries, bits, hot_owners), bits)
    # repeated entries of one set from several slices are one
    grouped = entries.groupBy(F.col("owner").alias("set_id"), F.col("extra").alias("n")).agg(
        F.sort_array(F.collect_set(F.struct(F.col("owners").cast("int").alias("owners"), "key"))).alias("s")
    )
    popular = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["owners"]) / F.col("n")
    return settle(
        grouped.where(F.size("s") >= _needed(F.col("n"))).select(
            "set_id", "n", F.col("s.key").alias("shared"), popular.cast("float").alias("popular")
        )
    )


def _index(rows: DataFrame) -> DataFrame:
    """(key, node, n, rest, popular, share): the first shared shingles of each row.

    `rest` is how many it has from that one on, `share` the part of its shingles that are shared.
    """
    size = F.size("shared")
    firsts = F.slice("shared", F.lit(1), (size - _needed(F.col("n")) + 1).cast("int"))
    out = rows.select(
        F.col("set_id").alias("node"), "n", size.alias("s"), "popular", (size / F.col("n")).cast("float").alias("share"),
        F.posexplode(firsts).alias("place", "key"),
    )
    return out.select("key", "node", "n", (F.col("s") - F.col("place")).alias("rest"), "popular", "share")


def _linked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, b) whose whole rows overlap enough."""
    row = rows.select("set_id", "n", "shared")
    both = (
        pairs.join(row.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa")), "a")
        .join(row.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb")), "b")
    )
    return settle(both.where(_enough(F.size(F.array_intersect("sa", "sb")), F.col("na"), F.col("nb"))).select("a", "b"))


def _sizes_fit(a: str, b: str) -> Column:
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def _with_component(index: DataFrame, known: DataFrame | None) -> DataFrame:
    """The index with each row's component, without columns that lie in one component.

    A row leaves the columns where it has too little left to be linked with the smallest there.
    """
    if known is None:
        out = index.withColumn("c", F.col("node"))
    else:
        out = index.join(known, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    mixed = out.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("least")).where("lo < hi")
    smallest = F.greatest("least", _needed(F.col("n")))
    kept = out.join(mixed.select("key", "least"), "key").where(F.col("rest") >= _needed_of_both(F.col("n"), smallest))
    return settle(kept.drop("least"))


def _met_leaders(index: DataFrame, turn: int) -> DataFrame:
    """(a, b): each row and, in each of LEADERS orders, the first of all rows that lead its columns.

    The orders are by common shingles, by the part that is shared, and by chance; in later turns
    chance has some weight in all of them.
    """
    chance = [F.pmod(F.xxhash64("node", F.lit(turn * LEADERS + i)), F.lit(1 << 20)) / (1 << 20) for i in range(LEADERS)]
    orders = [-F.col("popular") * (1 + 0.05 * turn * chance[0]), -F.col("share") - 0.02 * turn * chance[1], chance[2]]
    lead = index.groupBy("key").agg(*[F.min(F.struct(o.alias("o"), "node", "n", "c")).alias(f"l{i}") for i, o in enumerate(orders)])
    met = index.join(lead, "key")
    fits = [F.when((F.col("c") != F.col(f"l{i}.c")) & _sizes_fit("n", f"l{i}.n"), F.col(f"l{i}")) for i in range(LEADERS)]
    met = met.groupBy("node").agg(*[F.min(f).alias(f"l{i}") for i, f in enumerate(fits)])
    met = met.select("node", F.explode(F.array(*[f"l{i}.node" for i in range(LEADERS)])).alias("lead")).where("lead IS NOT NULL")
    return met.select(F.greatest("node", "lead").alias("a"), F.least("node", "lead").alias("b")).distinct()


def _sketch(shared: str) -> list[Column]:
    """1024 bits, as longs, of which each shingle sets one."""

    def word(number: int) -> Column:
        mine = F.filter(shared, lambda k: F.floor(F.pmod(k, F.lit(64 * SKETCH)) / 64) == number)
        bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(k, F.lit(64)).cast("int"))
        return F.aggregate(mine, F.lit(0).cast("long"), lambda a, k: a.bitwiseOR(bit(k)))

    return [word(i).alias(f"w{i}") for i in range(SKETCH)]


def _met_pairs(index: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): rows of different components that share a column and may overlap enough.

    In each column the rows outside its largest component meet all others.  Pairs are dropped
    where they meet if they cannot reach the bound: by their sizes, by how many shared shingles
    they have from there on, and by a sketch, as a bit that only one of two rows has stands for a shingle, at
    least, that the other has not.
    """
    bits = settle(rows.join(index.select(F.col("node").alias("set_id")).distinct(), "set_id", "left_semi").select(
        F.col("set_id").alias("node"), F.size("shared").alias("s"), *_sketch("shared")
    ))
    sizes = index.groupBy("key", "c").agg(F.count("*").alias("k"))
    main = sizes.groupBy("key").agg(F.max(F.struct("k", "c")).alias("m")).select("key", F.col("m.c").alias("main"))
    full = index.join(bits, "node").join(main, "key")
    x, y = full.where("c <> main").alias("x"), full.alias("y")
    needed = _needed_of_both(F.col("x.n"), F.col("y.n"))

    def can_have(one: str, other: str) -> Column:
        lacks = [F.bit_count(F.col(f"{one}.w{i}").bitwiseAND(F.bitwise_not(f"{other}.w{i}"))) for i in range(SKETCH)]
        return F.col(f"{one}.s") - sum(lacks[1:], lacks[0])

    may = (
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.c") != F.col("y.c"))
        & ((F.col("y.c") == F.col("y.main")) | (F.col("x.c") < F.col("y.c")))
        & _sizes_fit("x.n", "y.n")
        & (F.least("x.rest", "y.rest") >= needed)
        & (can_have("x", "y") >= needed)
        & (can_have("y", "x") >= needed)
    )
    return x.join(y, may).select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def row_components(rows: DataFrame, turns: int = TURNS) -> DataFrame:
    """(node, component) of the rows that are linked with others."""
    index, found, known = _index(rows), None, None
    for turn in range(turns):
        index = _with_component(index.drop("c"), known)
        new = _linked(_met_leaders(index, turn), rows)
        found = new if found is None else settle(found.unionByName(new).distinct())
        known = settle(components(found))
    index = _with_component(index.drop("c"), known)
    new = _linked(_met_pairs(index, rows), rows)
    return known if new.isEmpty() else components(found.unionByName(new))


def _bits(sets: DataFrame) -> int:
    return bucket_bits(sets.agg(F.sum("n_shingles")).first()[0] or 0)


def similar_documents(docs: DataFrame, hot_owners: int = HOT_OWNERS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of all that links reach)."""
    numbered = docs.select(F.col("doc_id").cast("long").alias("row"), "text")
    sets = settle(members(numbered))
    known = row_components(rows_of_matrix(numbered, _bits(sets), hot_owners))
    number = order_key("row")
    classes = sets.where("set_id >= 0").groupBy("set_id").agg(F.min(number).alias("first"), F.count("*").alias("copies"))
    joined = classes.join(known, classes["set_id"] == known["node"], "left").withColumn("c", F.coalesce("component", "set_id"))
    linked = settle(joined.where("component IS NOT NULL").groupBy("c").agg(F.min("first").alias("least")))
    # sets of one document that are linked with nothing need no lookup
    place = joined.join(linked, "c", "left").where("least IS NOT NULL OR copies > 1")
    place = place.select("set_id", F.coalesce("least", "first").alias("component_id"))
    out = sets.join(place, "set_id", "left")
    return out.select(
        F.col("row").alias("doc_id"), "n_shingles", F.nullif(F.coalesce("component_id", number), F.lit(2**63 - 1)).alias("component_id")
    )


def one_of_each(docs: DataFrame, hot_owners: int = HOT_OWNERS) -> DataFrame:
    """The row with the smallest doc_id of each component, with all columns of `docs`.

    Of rows with one doc_id one stays.  Texts that are linked with nothing all stay.  Texts are
    shuffled only if the numbers that go are too many to be sent to all.
    """
    names = docs.columns
    found = settle(similar_documents(docs, hot_owners))
    each = found.groupBy(F.col("doc_id").alias("odd_id")).agg(
        F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"), (F.count("*") > 1).alias("repeated")
    )
    odd = settle(each.where("NOT stays OR repeated"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key = f"c{names.index('doc_id')}"
    marked = plain.join(sent_if_small(odd), plain[key].eqNullSafe(odd["odd_id"]), "left")
    once = marked.where("stays IS NULL").select(*plain.columns)
    again = marked.where("stays").select(*plain.columns).dropDuplicates([key])
    return once.unionByName(again).toDF(*names)
