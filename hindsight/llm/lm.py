"""Cross-entropy difference: how much nearer a text is to a target corpus than to the rest.

Two n-gram models of symbols, alike in order, vocabulary and smoothing, are counted over all
texts of the target and over all other texts.  A text's score is the mean over its symbols of
the background's loss minus the target's, in bits: positive where the target predicts it
better (Moore and Lewis 2010).

The vocabulary is fixed: 48 classes of bytes (letters regardless of case, kinds of signs,
groups of the bytes of other characters).  So a model has at most 48**4 counts at any size of
the corpus, is exact, and every text can be scored where it lies; only counts are shuffled.
Losses are whole multiples of 2**-20 bit, so sums do not depend on how rows are grouped.

Cases: a null or empty text has no symbols and scores 0; rows without a number, or whose
number has no label, are background; a target without rows predicts all symbols alike; of
repeated numbers every row counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindsight.llm.arrays import per_text, slices
from hindsight.llm.shared import sent_if_small, settle

ORDER = 4
SYMBOLS = 48
UNIT = 1 << 20
#: How many times a lower order's estimate counts beside the higher order's counts.
STRENGTH = 8.0


def _classes() -> np.ndarray:
    out = np.full(256, 27, np.int64)  # control characters
    for c in range(26):
        out[[ord("a") + c, ord("A") + c]] = c
    out[list(b"0123456789")] = 26
    out[ord(" ")], out[ord("\n")], out[ord(".")], out[ord(",")] = 28, 29, 30, 31
    out[list(b"!?;:'\"-")] = 32
    out[list(b"()[]{}")] = 33
    out[list(b"#*$%&|<>@/\\^_`~+=")] = 34
    high = np.arange(128, 256)
    out[128:] = np.where(high < 192, 35 + high % 9, 44 + high % 4)
    return out


CLASSES = _classes()
START = 29  # a text begins as after line breaks


def grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte, as a number below SYMBOLS**ORDER."""
    lead = ORDER - 1
    count = len(at) - 1
    padded = np.full(len(data) + lead * count, START, np.int64)
    place = np.arange(len(data)) + np.repeat(lead * np.arange(1, count + 1), np.diff(at))
    padded[place] = CLASSES[data]
    out = np.zeros(len(data), np.int64)
    for back in range(lead, -1, -1):
        out = out * SYMBOLS + padded[place - back]
    return out


def counts(docs: DataFrame) -> DataFrame:
    """(gram, n) over all texts; each task adds up what it reads before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**ORDER, np.int64)
        for batch in batches:
            for _, data, at in slices(batch):
                seen, times = np.unique(grams(data, at), return_counts=True)
                total[seen] += times
        seen = np.flatnonzero(total)
        for i in range(0, len(seen), 1 << 16):
            part = seen[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def losses(n: np.ndarray) -> np.ndarray:
    """Loss of each n-gram's last symbol in units of 2**-20 bit.

    An order's share is its counts and STRENGTH times the next lower order's share; below
    the first order all symbols are alike.
    """
    share = np.full(1, 1.0 / SYMBOLS)
    for order in range(1, ORDER + 1):
        here = n.reshape(-1, SYMBOLS**order).sum(axis=0, dtype=np.float64).reshape(-1, SYMBOLS)
        below = np.broadcast_to(share, SYMBOLS) if order == 1 else np.tile(share, SYMBOLS)
        total = here.sum(axis=1, keepdims=True)
        share = ((here + STRENGTH * below.reshape(-1, SYMBOLS)) / (total + STRENGTH)).reshape(-1)
    return np.rint(-np.log2(share) * UNIT).astype(np.int32)


def fit(all_counts: DataFrame, target_counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Losses under target and background, which is all but the target.

    The driver gets one row for each n-gram that occurs, SYMBOLS**ORDER at most.
    """
    tables = []
    for df in (all_counts, target_counts):
        rows = df.toPandas()
        table = np.zeros(SYMBOLS**ORDER, np.int64)
        table[rows["gram"].to_numpy(np.int64)] = rows["n"]
        tables.append(table)
    return losses(tables[1]), losses(tables[0] - tables[1])


def score(docs: DataFrame, target: np.ndarray, background: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score (bits for each symbol)."""
    sent = docs.sparkSession.sparkContext.broadcast((target, background))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        for batch in batches:
            for part, data, at in slices(batch):
                seen = grams(data, at)
                n = np.diff(at)
                sums = [per_text(m[seen], at) for m in models]
                each = [s / (np.maximum(n, 1) * float(UNIT)) for s in [*sums, sums[1] - sums[0]]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), *map(pa.array, each)],
                    ["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """Score every document; the target are those whose doc_id is in `target_ids` (doc_id)."""
    wanted = settle(target_ids.select("doc_id").where("doc_id IS NOT NULL").distinct())
    chosen = docs.select("doc_id", "text").join(sent_if_small(wanted), "doc_id", "left_semi")
    return score(docs, *fit(counts(docs), counts(chosen)))
