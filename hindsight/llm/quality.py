"""Quality rules of documents and of the hosts they come from.

Documents are measured one by one; the share of failures of each host is then shrunk
towards what hosts have in general, by a beta distribution fitted to all of them, so that
a host with two documents is not judged like one with two million.  Documents of hosts
whose shrunk share is too high go as well.

Cases: a null or empty text has no words and fails; rows without a host (null) are judged
by themselves only; every row counts, also repeated ones; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindsight.llm.arrays import mix, per_text, running_sums, slices, span_hashes, windows, words
from hindsight.llm.shared import sent_if_small, settle

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Limits of a document, and the largest share of failing documents of a host."""

    least_words: int = 50
    most_repeated_percent: int = 50
    most_failing: float = 0.5


def measure_texts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each text of a slice."""
    count = len(at) - 1
    begin, end, text = words(data, at)
    sums = running_sums(data)
    per = {"n_words": np.bincount(text, minlength=count)}
    # code points: bytes that do not continue a character
    inner = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = inner[end] - inner[begin]
    per["word_chars"] = np.bincount(text, weights=chars, minlength=count)
    per["n_symbols"] = per_text(_SYMBOLS[data], at)

    breaks = np.flatnonzero(data == 10)
    line = np.unique(np.concatenate([at[:-1], breaks + 1, at[-1:]]))
    first, last = line[:-1], line[1:]
    # a line's own bytes end before its break
    stop = last - (data[last - 1] == 10) if len(data) else last
    with_word = np.searchsorted(begin, last) > np.searchsorted(begin, first)
    first, stop = first[with_word], stop[with_word]
    owner = np.searchsorted(at, first, "right") - 1
    key = mix(span_hashes(sums, first, stop) + mix(owner.astype(np.uint64)))
    kept = np.unique(key, return_index=True)[1]
    per["n_dup_lines"] = np.bincount(owner, minlength=count) - np.bincount(owner[kept], minlength=count)

    runs = windows(span_hashes(sums, begin, end), 3)
    inside = np.flatnonzero(text[: len(runs)] == text[2:]) if len(runs) else np.zeros(0, np.int64)
    key = mix(runs[inside] + mix(text[inside].astype(np.uint64)))
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    again = inside[times[which] > 1]
    repeated = np.zeros(len(begin), bool)
    for i in range(3):
        repeated[again + i] = True
    per["n_repeat_words"] = np.bincount(text[repeated], minlength=count)
    return {k: v.astype(np.int64) for k, v in per.items()}


def measure(docs: DataFrame, carry: list[str]) -> DataFrame:
    """`carry` columns of the documents, which have `text`, and their MEASURES."""
    kept = [f.name for f in docs.schema if f.name in carry]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], F.col("text").alias("body"))
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "body"):
                found = measure_texts(data, at)
                columns = [part.column(f"c{i}") for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *[pa.array(found[m]) for m in MEASURES]], [f"c{i}" for i in range(len(kept))] + MEASURES
                )

    out = rows.mapInArrow(run, ", ".join([schema, *[f"{m} long" for m in MEASURES]]))
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(kept)})


def _failed(rules: Rules):
    return (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated_percent * F.col("n_words"))


def host_verdicts(failures: DataFrame, host: str, rules: Rules) -> DataFrame:
    """(host, documents, failing, shrunk, host_kept) from rows with `host`, `base_failed`.

    The prior has the mean and the spread of the hosts' shares (method of moments).  Hosts
    that all have one share shrink to it, as a prior of no spread says.
    """
    hosts = settle(
        failures.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count("*").alias("documents"), F.count_if("base_failed").alias("failing"))
    )
    share = F.col("failing") / F.col("documents")
    mean, spread = hosts.agg(F.avg(share), F.var_pop(share)).first()
    mean, spread = mean or 0.0, spread or 0.0
    # at most the weight of a million documents, at least that of one
    weight = min(1e6, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6
    shrunk = (F.col("failing") + mean * weight) / (F.col("documents") + weight)
    return hosts.withColumn("shrunk", shrunk).withColumn("host_kept", F.col("shrunk") <= rules.most_failing)


def quality_rules(docs: DataFrame, rules: Rules = Rules(), host: str = "source") -> DataFrame:
    """doc_id, the MEASURES, base_failed, kept, host_kept; one row for each of `docs`.

    Measures are kept in the shared folder, as both the hosts and the result need them.
    """
    base = settle(measure(docs.select("doc_id", "text", F.col(host).alias("host")), ["doc_id", "host"]).withColumn("base_failed", _failed(rules)))
    bad = host_verdicts(base, "host", rules).where(~F.col("host_kept")).select("host", "host_kept")
    judged = base.join(sent_if_small(bad), "host", "left")
    host_kept = F.coalesce("host_kept", F.lit(True))
    return judged.select(
        "doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & host_kept).alias("kept"), host_kept.alias("host_kept")
    )


def quality_filter(docs: DataFrame, rules: Rules = Rules(), host: str = "source") -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns.

    Texts are measured twice, for the hosts and for themselves, and never shuffled.
    """
    names = docs.columns
    failures = measure(docs.select("text", F.col(host).alias("host")), ["host"]).select("host", _failed(rules).alias("base_failed"))
    bad = host_verdicts(failures, "host", rules).where(~F.col("host_kept")).select("host")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    with_text = plain.withColumn("text", F.col(f"c{names.index('text')}"))
    fine = measure(with_text, plain.columns).where(~_failed(rules)).select(*plain.columns)
    return fine.join(sent_if_small(bad), fine[f"c{names.index(host)}"] == bad["host"], "left_anti").toDF(*names)
