"""Language identification by compression.

Each language has a dictionary of raw text.  A text, in lower case and without anything but
letters, is compressed with each of them, in blocks so short that what a block has from the
dictionary outweighs what it has from itself; the language with the smallest sum wins, the
commoner one in a tie.  A text whose best two sums are nearly equal is rejected.

Learning takes a bounded sample of labelled rows; everything else is one pass over all of
them without a shuffle.

Cases: a null text, or one without a letter, is `und` with score 0; rows without a language
teach nothing; with no rows to learn from every text is `und`; every row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindsight.llm.arrays import slices

UNKNOWN = "und"
#: Letters with the marks that belong to them, as vowel signs of Indian scripts do.
_NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Settings:
    """Bounds of what is learned, how texts are coded, and the margin below which one is rejected.

    A dictionary has at most `dictionary_bytes`, from at most `sample_texts` different texts of
    its language and `sample_chars` characters of each.  Every language is learned.
    """

    dictionary_bytes: int = 1 << 16
    sample_texts: int = 200
    sample_chars: int = 2000
    block_bytes: int = 1024
    level: int = 9
    narrow: float = 0.01


def letters(text: str) -> bytes:
    """A text in lower case with one blank for all between its letters; nothing if it has none."""
    if not _LETTER.search(text):
        return b""
    return _NO_LETTERS.sub(" ", text.lower()).strip().encode()


def learn(labelled: DataFrame, how: Settings = Settings()) -> list[tuple[str, bytes]]:
    """(language, dictionary), commonest language first, from rows with text and lang.

    Texts are chosen by a hash of theirs, copies once.  Only those below a share of all hashes,
    by the number of different texts of their language, are ranked, so no language meets in
    one task.
    """
    rows = labelled.select("lang", "text", F.xxhash64("text").alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("rows"), "lang").collect()
    if not counts:
        return []
    spark = labelled.sparkSession
    share = [(r["lang"], min(1.0, 8 * how.sample_texts / max(1, r["texts"]))) for r in counts]
    chosen = rows.join(F.broadcast(spark.createDataFrame(share, "lang string, share double")), "lang")
    chosen = chosen.where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    chosen = chosen.groupBy("lang", "h", "text").agg(F.lit(1))  # copies meet on the map side
    order = Window.partitionBy("lang").orderBy("h", "text")
    chosen = chosen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= how.sample_texts)
    room = F.greatest(F.length("text") - how.sample_chars, F.lit(0)) + 1
    part = F.substr("text", F.pmod(F.col("h"), room).cast("int") + 1, F.lit(how.sample_chars))
    texts: dict[str, dict[bytes, None]] = {r["lang"]: {} for r in counts}
    for r in chosen.select("lang", "n", part.alias("part")).orderBy("lang", "n").collect():
        texts[r["lang"]][letters(r["part"])] = None
    return [(lang, b" ".join(parts)[: how.dictionary_bytes]) for lang, parts in texts.items()]


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]], how: Settings):
        self.languages, self.block = [lang for lang, _ in dictionaries], how.block_bytes
        self.coders = []
        for _, raw in dictionaries:
            # zstd takes dictionaries from 8 bytes on
            raw = raw.ljust(8)
            code = zstandard.ZstdCompressionParameters.from_level(
                how.level, source_size=how.block_bytes, dict_size=len(raw), write_content_size=0, write_checksum=0, write_dict_id=0
            )
            kept = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(compression_params=code)
            self.coders.append(zstandard.ZstdCompressor(dict_data=kept, compression_params=code))

    def sizes(self, text: bytes) -> list[int]:
        """Compressed bytes of the whole text with each dictionary."""
        blocks = [text[i : i + self.block] for i in range(0, max(1, len(text)), self.block)]
        return [sum([len(c.compress(b)) for b in blocks]) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); the score is a share of weights that halve with each byte."""
        plain = letters(text or "")
        if not plain or not self.coders:
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(plain)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = [s for i, s in enumerate(sizes) if i != best]
        weight = np.exp2(-np.minimum(np.array(others, dtype=float) - sizes[best], 1000.0)).sum()
        margin = (min(others) - sizes[best]) / min(others) if others else 1.0
        return self.languages[best], float(1 / (1 + weight)), margin


def classify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], how: Settings = Settings(), reject: bool = True) -> DataFrame:
    """doc_id, lang_pred, score, narrow; with `reject`, narrow ones become `und`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Classifier(dictionaries, how)
        for batch in batches:
            for part, _, _ in slices(batch):
                found = [known.predict(t) for t in part.column("text").to_pylist()]
                narrow = [margin < how.narrow for _, _, margin in found]
                lang = [UNKNOWN if reject and bad else name for (name, _, _), bad in zip(found, narrow, strict=True)]
                columns = [pa.array(lang, pa.string()), pa.array([s for _, s, _ in found], pa.float64()), pa.array(narrow, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "lang_pred", "score", "narrow"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, narrow boolean")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: a fourth of them, by a checksum of their number."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, how: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, narrow: learned from the rest, applied to all.

    Narrow ones keep their language here.
    """
    dictionaries = learn(docs.where(~held_out()), how)
    found = classify(docs, dictionaries, how, reject=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "narrow")
