"""Cross-entropy difference with word models whose vocabulary and counts grow with the corpus.

Two models of words and word pairs, alike in order, vocabulary and smoothing, are counted over
all texts of the target and over all other texts.  A token is a run of letters, digits and
characters beyond ASCII, as it is written; each other ASCII sign, and each character from
U+3000 on, is a token of its own.  The vocabulary is all tokens of all texts and the edge of a
text, V in number.  A text is read as edge, tokens, edge, and each token and the last edge, b
after a, is lost by the mean of both orders' losses

    -log2((n(b) + S / V) / (n + S))   and   -log2((n(a b) + S / V) / (n(a) + S)).

A text's score is the mean of the background's loss minus the target's (Moore and Lewis 2010),
in bits: positive where the target predicts it better.  Its own counts are left out of its
own model; else most pairs of a text, which no other text has, would only tell its label.

Each key (a token, or a pair) contributes by its own counts alone.  So a text sends one row per
distinct key to where the key's counts meet, and gets back what differs from a key that no
other text has; a key of this text alone sends nothing back.  Keys that are frequent in every
sixteenth document, of which at most HOT are taken, are counted on the map side, sent to all
tasks and applied where the text lies.  Which keys these are only decides their route.
Losses are whole multiples of 2**-20 bit, so sums do not depend on how rows are grouped.

Cases: a null or empty text, or one of separators only, has no tokens and scores 0; rows without
a number, or whose number has no label, are background; of repeated numbers every row counts;
with no target, or no other text, that model predicts by V alone.  Keys are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindsight.llm.arrays import SEPARATORS, mix, running_sums, signed, slices, span_hashes
from hindsight.llm.shared import sent_if_small, settle

UNIT = 1 << 20
#: How many occurrences the uniform estimate counts for.
STRENGTH = 8.0
#: A key beside its two counts is 24 bytes, so these are 6 MB.
HOT = 1 << 18
EDGE = np.uint64(0x5DEECE66D1234560)

#: Bytes of tokens that are longer than a sign.
INNER = np.zeros(256, bool)
INNER[128:] = True
for _first, _last in ("az", "AZ", "09"):
    INNER[ord(_first) : ord(_last) + 1] = True


@dataclass(frozen=True)
class Routes:
    """Every `sample`-th row is looked at; keys in `least` of these rows may be hot."""

    sample: int = 16
    least: int = 4
    most: int = HOT


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text number) of the tokens."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    run = INNER[data]
    alone = data >= 0xE3  # the first byte of a character from U+3000 on
    lead = (data & 0xC0) != 0x80
    first = np.zeros(len(data), bool)
    first[at[:-1][np.diff(at) > 0]] = True
    # the character that each byte belongs to stands alone
    start = np.flatnonzero(lead | first)
    alone = np.repeat(alone[start], np.diff(np.append(start, len(data))))
    joins = np.zeros(len(data), bool)
    joins[1:] = run[1:] & run[:-1] & ~(lead[1:] & (alone[1:] | alone[:-1]))
    joins &= ~first
    begin = np.flatnonzero(~joins)
    end = np.append(begin[1:], len(data))
    real = ~SEPARATORS[data[begin]]
    begin, end = begin[real], end[real]
    return begin, end, np.searchsorted(at, begin, "right") - 1


def keys(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, key, times) for each text's distinct keys, and events per text.

    Keys of pairs are odd, and those of tokens and of the edge are even.
    """
    begin, end, text = tokens(data, at)
    word = span_hashes(running_sums(data), begin, end) & ~np.uint64(1)
    count = len(at) - 1
    events = np.bincount(text, minlength=count)
    full = np.flatnonzero(events)
    events[full] += 1
    # an edge before each text's first token and one after its last
    starts = np.searchsorted(text, full)
    before = np.insert(word, starts, EDGE)
    ends = np.append(starts[1:], len(word))
    after = np.insert(word, ends, EDGE)
    owner = np.repeat(full, events[full])
    pair = mix(mix(before) * np.uint64(0xD1342543DE82EF95) + after) | np.uint64(1)
    owner, key = np.concatenate([owner, owner]), np.concatenate([after, pair])
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    at_new = np.flatnonzero(new)
    return owner[at_new], signed(key[at_new]), np.diff(np.append(at_new, len(key))), events


def summed(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    seen, place = np.unique(key, return_inverse=True)
    return [seen, *[np.bincount(place, v, len(seen)).astype(np.int64) for v in values]]


def hot_keys(docs: DataFrame, how: Routes) -> np.ndarray:
    """Sorted keys of many documents; only a choice of route depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = 0
        for batch in batches:
            some = batch.take(pa.array(np.arange(-passed % how.sample, len(batch), how.sample)))
            passed += len(batch)
            for _, data, at in slices(some) if len(some) else ():
                _, key, _, _ = keys(data, at)
                seen, rows = summed(key, np.ones(len(key)))
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(rows)], ["key", "rows"])

    found = docs.select("text").mapInArrow(run, "key long, rows long").groupBy("key").agg(F.sum("rows").alias("rows"))
    found = settle(found.where(F.col("rows") >= how.least))
    sizes = found.groupBy(F.floor(F.log2("rows") * 4).alias("size")).count().orderBy(F.desc("size")).collect()
    taken, least = 0, None
    for r in sizes:
        taken += r["count"]
        if taken > how.most:
            break
        least = r["size"]
    if least is None:
        return np.zeros(0, np.int64)
    return np.sort(found.where(F.floor(F.log2("rows") * 4) >= least).select("key").toPandas()["key"].to_numpy(np.int64))


def _places(hot: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in `hot`, is hot)."""
    if not len(hot):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
    return place, hot[place] == key


def totals(docs: DataFrame, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Counts of the hot keys and, last, of all events, in all texts and in the target; and V."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value
        sums = np.zeros((2, len(hot) + 1), np.int64)
        used = False
        for batch in batches:
            for part, data, at in slices(batch):
                wanted = part.column("wanted").to_numpy(zero_copy_only=False)
                owner, key, times, events = keys(data, at)
                place, is_hot = _places(hot, key)
                for i, which in enumerate((np.ones(len(part), bool), wanted)):
                    mine = is_hot & which[owner]
                    sums[i, : len(hot)] += np.bincount(place[mine], times[mine], len(hot)).astype(np.int64) if len(hot) else 0
                    sums[i, -1] += events[which].sum()
                used = True
                rest = np.unique(key[~is_hot & (key % 2 == 0)])
                none = np.zeros(len(rest), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(none - 1), pa.array(rest), pa.array(none), pa.array(none)], ["place", "key", "n", "t"])
        seen = np.flatnonzero(sums[0]) if used else np.zeros(0, np.int64)
        for i in range(0, len(seen), 1 << 16):
            p = seen[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(p * 0), pa.array(sums[0, p]), pa.array(sums[1, p])], ["place", "key", "n", "t"])

    each = docs.select("text", "wanted").mapInArrow(run, "place long, key long, n long, t long")
    each = each.groupBy("place", "key").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    rows = each.groupBy("place").agg(F.count("*").alias("many"), F.sum("n").alias("n"), F.sum("t").alias("t")).toPandas()
    known = rows[rows["place"] >= 0]
    out = np.zeros((2, len(hot) + 1), np.int64)
    out[0, known["place"].to_numpy(np.int64)] = known["n"]
    out[1, known["place"].to_numpy(np.int64)] = known["t"]
    words = int(rows.loc[rows["place"] < 0, "many"].sum()) + int(np.count_nonzero(hot % 2 == 0))
    return out[0], out[1], max(1, words)


def loss(key: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """What a key contributes each time, by its count and without the events, of both orders."""
    out = -np.log2(n + STRENGTH / words) + np.where(key % 2 == 0, np.log2(n + STRENGTH), 0.0)
    return np.rint(out * UNIT).astype(np.int64)


def _loss(key: Column, n: Column, words: int) -> Column:
    out = -F.log2(n + F.lit(STRENGTH / words)) + F.when(key % 2 == 0, F.log2(n + F.lit(STRENGTH))).otherwise(0.0)
    return F.rint(out * UNIT).cast("long")


def score(docs: DataFrame, hot: np.ndarray, n_all: np.ndarray, n_target: np.ndarray, words: int) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score (bits for each token)."""
    sent = docs.sparkSession.sparkContext.broadcast((hot, n_target, n_all - n_target))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, *models = sent.value
        for batch in batches:
            for part, data, at in slices(batch):
                wanted = part.column("wanted").to_numpy(zero_copy_only=False)
                row = part.column("row").to_numpy(zero_copy_only=False).astype(np.int64)
                owner, key, times, events = keys(data, at)
                place, is_hot = _places(hot, key)
                sums = []
                for model, mine in zip(models, (wanted, ~wanted), strict=True):
                    # hot keys by their counts in other texts, the rest as if no other text had them
                    others = np.where(is_hot, model[place] - np.where(mine[owner], times, 0), 0)
                    total = model[-1] - np.where(mine, events, 0)
                    here = np.zeros(len(part), np.int64)
                    np.add.at(here, owner, times * loss(key, others, words))
                    sums.append(here + events * np.rint(np.log2(total + STRENGTH) * UNIT).astype(np.int64))
                heads = pa.StructArray.from_arrays(
                    [part.column("doc_id"), pa.array(events), pa.array(sums[0]), pa.array(sums[1])], ["doc_id", "n_tokens", "target", "background"]
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(mix(row.view(np.uint64)))), pa.array(row), pa.array(np.zeros(len(row), np.int64)), heads], ["key", "row", "n", "head"]
                )
                cold = np.flatnonzero(~is_hot)
                # the target's occurrences go as negative numbers
                n = np.where(wanted[owner], -times, times)[cold]
                for i in range(0, len(cold), 1 << 16):
                    c = cold[i : i + (1 << 16)]
                    none = pa.nulls(len(c), heads.type)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[c]), pa.array(row[owner[c]]), pa.array(n[i : i + (1 << 16)]), none], ["key", "row", "n", "head"]
                    )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", "wanted")
    each = rows.mapInArrow(run, "key long, row long, n long, head struct<doc_id: long, n_tokens: long, target: long, background: long>")
    n, key = F.col("n"), F.col("key")
    by = Window.partitionBy("key")
    each = each.withColumn("t", F.sum(F.greatest(-n, F.lit(0))).over(by)).withColumn("b", F.sum(F.greatest(n, F.lit(0))).over(by))
    # heads, and keys that other texts have too
    each = each.where((n == 0) | (F.col("t") + F.col("b") > F.abs(n)))
    alone = F.when(key % 2 == 0, int(loss(np.zeros(1, np.int64), np.zeros(1), words)[0])).otherwise(int(loss(np.ones(1, np.int64), np.zeros(1), words)[0]))

    def moved(name: str, others: Column) -> Column:
        return F.when(n == 0, F.col(f"head.{name}")).otherwise(F.abs(n) * (_loss(key, others, words) - alone))

    each = each.select(
        "row", "head.doc_id", "head.n_tokens",
        moved("target", F.col("t") - F.greatest(-n, F.lit(0))).alias("target"),
        moved("background", F.col("b") - F.greatest(n, F.lit(0))).alias("background"),
    )
    sums = each.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("target").alias("t"), F.sum("background").alias("b"))
    mean = lambda c: c / (F.greatest(F.col("n_tokens"), F.lit(1)) * F.lit(2.0 * UNIT))
    return sums.select(
        "doc_id", "n_tokens", mean(F.col("t")).alias("target_loss"), mean(F.col("b")).alias("background_loss"), mean(F.col("b") - F.col("t")).alias("score")
    )


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, how: Routes = Routes()) -> DataFrame:  # noqa: B008
    """Score every document; the target are those whose doc_id is in `target_ids` (doc_id)."""
    wanted = settle(target_ids.select("doc_id").where("doc_id IS NOT NULL").distinct())
    wanted = sent_if_small(wanted).withColumn("wanted", F.lit(True))
    marked = docs.select("doc_id", "text").join(wanted, "doc_id", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    hot = hot_keys(docs, how)
    return score(marked, hot, *totals(marked, hot))
