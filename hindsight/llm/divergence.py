"""How far the words of each source are from those of the other sources of its language.

Three passes.  The first counts for each language in how many of its documents a term
occurs; only terms of enough documents are kept, by exact counts.  Their minimal perfect
hashes (`perfecthash`), in shards of some thousand keys, go to all tasks.  The second pass
over the texts looks every distinct term of a stretch up there, compares it with the stored
key, and adds its count to a dense array of slots of its language and source.  Arrays are
summed shard by shard, and the last pass compares the sources of a language in tiles, one
shard at a time.

What is sent to all tasks has a bound in bytes (`sent_bytes`): shards of the terms in most
documents.  Terms beyond it have shards as well, which stay on the executors: their counts
meet the stored keys by a join.  Both give the same slots, and every term takes one way.

Terms are runs of A-Z, a-z and all that is not ASCII, with A-Z in lower case.  A term's share
is p = 1 + floor(10**9 * (count + 2) / (N + 2 V)) for N occurrences of V kept terms; two shares
differ by floor((p - q)**2 / (p + q)).  All of that is whole numbers.

Cases: null texts, languages and sources count as empty ones; texts without a term count as
documents of their group; a language without kept terms has pairs of value 0; every row
counts, also repeated ones; texts of any length are cut between terms; ties go by the UTF-8
bytes of the item; no rows give no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindsight.llm.perfecthash import PerfectHash, Shard, hashes
from hindsight.llm.shared import sent_if_small, settle

#: Letters stay, those in upper case become lower case, other ASCII parts terms.
TERM_BYTES = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
ONE = 1_000_000_000
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20
BATCH = 20_000


@dataclass(frozen=True)
class Audit:
    """Limits: documents of a kept term, terms of a report, and sizes that bound memory.

    held: distinct terms that a task counts before it passes them on; cells: slots that it
    holds; sent_bytes: keys, with 32 bytes for each, that are sent to all tasks; tile: sources
    that are compared at once; fan_in: tasks whose arrays are summed in one step.
    """

    least_documents: int = 10
    reported: int = 10
    shard_keys: int = 2048
    sent_bytes: int = 32 << 20
    held: int = 200_000
    cells: int = 4 << 20
    tile: int = 96
    fan_in: int = 64


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    plain = text.translate(TERM_BYTES)
    if len(plain) <= PIECE:
        yield plain.split()
        return
    begin = 0
    while begin < len(plain):
        end = plain.find(b" ", begin + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[begin:end].split()
        begin = end


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return pc.cast(batch.column(column), pa.binary()).to_pylist()


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _in_batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from table.to_batches(max_chunksize=BATCH)


def kept_terms(docs: DataFrame, how: Audit) -> DataFrame:
    """(lang, term, documents) of the terms in enough documents of a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, terms in found.items():
                yield from _in_batches(pa.table({
                    "lang": pa.array([lang] * len(terms), pa.string()), "term": _strings(list(terms)), "n": pa.array(list(terms.values()), pa.int64()),
                }))
            found.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), _texts(batch, "text"), strict=True):
                found[lang].update(set().union(*pieces(text)))
                if sum(map(len, found.values())) > how.held:
                    yield from flush()
        yield from flush()

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("documents")).where(F.col("documents") >= how.least_documents)


def shards_of(kept: DataFrame, how: Audit) -> DataFrame:
    """(lang, shard, sent, levels, bits, terms) of the perfect hashes of `kept`, which is settled.

    The driver gets bytes by powers of two of the number of documents, some dozen rows.
    """
    power = F.floor(F.log2("documents")).cast("int")
    classes = kept.groupBy(power.alias("c")).agg(F.sum(F.octet_length("term") + 32).alias("b")).collect()
    room, least = how.sent_bytes, 64
    for c in sorted(classes, key=lambda r: -r.c):
        room -= c.b
        if room < 0:
            break
        least = c.c
    marked = kept.select("lang", "term", (power >= least).alias("sent"))
    counts = marked.groupBy("lang", "sent").agg(F.ceil(F.count("*") / how.shard_keys).alias("shards"))
    # sent shards have even numbers, others odd ones
    number = 2 * F.pmod(F.xxhash64("term"), F.col("shards")) + F.when(F.col("sent"), 0).otherwise(1)
    dealt = marked.join(sent_if_small(settle(counts)), ["lang", "sent"])
    dealt = dealt.select("lang", number.cast("int").alias("shard"), "sent", F.col("shards").cast("int").alias("shards"), "term")

    def build(table: pa.Table) -> pa.Table:
        shard = Shard.of(pc.cast(table.column("term").combine_chunks(), pa.binary()).to_pylist())
        return pa.table({
            **{c: table.column(c).slice(0, 1) for c in ("lang", "shard", "sent", "shards")},
            "levels": pa.array([shard.levels], pa.list_(pa.int32())),
            "bits": pa.array([np.packbits(shard.bits).tobytes()], pa.binary()),
            "terms": pa.array([[k.decode() for k in shard.keys]], pa.list_(pa.string())),
        })

    return dealt.groupBy("lang", "shard").applyInArrow(
        build, "lang string, shard int, sent boolean, shards int, levels array<int>, bits binary, terms array<string>"
    )


class Lookup:
    """The sent shards: the slots of terms by language."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("lang", "ascending"), ("shard", "ascending")])
        shards, langs = [], rows.column("lang").to_pylist()
        for i in range(rows.num_rows):
            levels = rows.column("levels")[i].as_py()
            bits = np.unpackbits(np.frombuffer(rows.column("bits")[i].as_py(), np.uint8))[: sum(levels)].astype(bool)
            shards.append(Shard(levels, bits, [t.encode() for t in rows.column("terms")[i].as_py()]))
        self.hash = PerfectHash(shards)
        self.numbers = np.array(rows.column("shard").to_pylist(), np.int64)
        # of each language: its first shard here, how many it has here, and how many terms were dealt to
        self.of: dict[str, tuple[int, int, int]] = {}
        for lang, n in Counter(langs).items():
            first = langs.index(lang)
            self.of[lang] = (first, n, rows.column("shards")[first].as_py())

    def slots(self, lang: str, terms: list[bytes]) -> np.ndarray:
        """Places in the dense array of the language, or -1."""
        if lang not in self.of or not terms:
            return np.full(len(terms), -1, np.int64)
        first, here, dealt = self.of[lang]
        h = hashes(terms)
        number = 2 * (h.view(np.int64) % dealt)
        shard = first + np.searchsorted(self.numbers[first : first + here], number)
        there = np.flatnonzero((shard < first + here) & (self.numbers[np.minimum(shard, first + here - 1)] == number))
        out = np.full(len(terms), -1, np.int64)
        out[there] = self.hash.slots([terms[i] for i in there], h[there], shard[there])
        return np.where(out >= 0, out - self.hash.first[first], -1)

    def size(self, lang: str) -> int:
        first, here, _ = self.of[lang]
        return int(self.hash.first[first + here] - self.hash.first[first])

    def cut(self, lang: str, dense: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, slots in it, counts) of the shards with counts."""
        first, here, _ = self.of[lang]
        edges = self.hash.first[first : first + here + 1] - self.hash.first[first]
        for i in range(here):
            own = dense[edges[i] : edges[i + 1]]
            some = np.flatnonzero(own)
            if len(some):
                yield int(self.numbers[first + i]), some, own[some]


_LOOKUPS: dict[str, Lookup] = {}


def _lookup(name: str, broadcast) -> Lookup:
    """Unpacked once in each Python worker."""
    if name not in _LOOKUPS:
        _LOOKUPS.clear()
        _LOOKUPS[name] = Lookup(broadcast.value)
    return _LOOKUPS[name]


RECOUNT = "lang string, source string, shard int, slots array<int>, counts array<long>, term string, n long, part int"


def _recount(docs: DataFrame, broadcast, how: Audit, rest: bool) -> DataFrame:
    """Counts of the kept terms by language and source, each task's for itself.

    Rows with `shard` hold slots and counts; without a source they are of the whole language.
    With `rest`, terms that no sent shard has come as rows with `term` and `n`.
    """
    name = uuid.uuid4().hex
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("shard", pa.int32()), ("slots", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("term", pa.string()), ("n", pa.int64()), ("part", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(name, broadcast)
        part = TaskContext.get().partitionId()
        held: dict[tuple[str, str], Counter] = defaultdict(Counter)
        dense: dict[tuple[str, str], np.ndarray] = {}

        def pour() -> Iterator[pa.RecordBatch]:
            """Add the held terms to the slots."""
            for (lang, source), terms in held.items():
                strings = list(terms)
                counts = np.fromiter(terms.values(), np.int64, len(strings))
                slot = lookup.slots(lang, strings)
                known = slot >= 0
                if known.any():
                    if (lang, source) not in dense:
                        if sum(map(len, dense.values())) + lookup.size(lang) > how.cells:
                            yield from flush()
                        dense[lang, source] = np.zeros(lookup.size(lang), np.int64)
                    dense[lang, source][slot[known]] += counts[known]
                if rest and not known.all():
                    others = np.flatnonzero(~known)
                    n = len(others)
                    yield from _in_batches(pa.Table.from_arrays([
                        pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, schema.field("slots").type),
                        pa.nulls(n, schema.field("counts").type), _strings([strings[i] for i in others]), pa.array(counts[others]), pa.array([part] * n, pa.int32()),
                    ], schema=schema))
            held.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            """Pass the slots on, by source and for the whole language."""
            whole: dict[str, np.ndarray] = {}
            for (lang, _), counts in dense.items():
                whole[lang] = whole[lang] + counts if lang in whole else counts
            out: list[tuple] = []
            for (lang, source), counts in [*dense.items(), *[((lang, None), counts) for lang, counts in whole.items()]]:
                for shard, slots, n in lookup.cut(lang, counts):
                    out.append((lang, source, shard, slots.astype(np.int32), n, None, None, part))
                    if len(out) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                        out.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            dense.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), _texts(batch, "text"), strict=True):
                own = held[lang, source]
                for terms in pieces(text):
                    own.update(terms)
                    if len(own) > how.held:
                        yield from pour()
                        own = held[lang, source]
            if sum(map(len, held.values())) > how.held:
                yield from pour()
        yield from pour()
        yield from flush()

    return docs.select("lang", "source", "text").mapInArrow(run, RECOUNT)


def _sum_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row from the rows of a (lang, source, shard), read one batch after the other."""
    total, first = np.zeros(0, np.int64), None
    for batch in batches:
        if not batch.num_rows:
            continue
        first = first or batch.slice(0, 1)
        slots, counts = (batch.column(c).flatten().to_numpy() for c in ("slots", "counts"))
        if len(slots) and slots.max() >= len(total):
            total = np.concatenate([total, np.zeros(int(slots.max()) + 1 - len(total), np.int64)])
        np.add.at(total, slots, counts)
    if first is not None:
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [*[first.column(c) for c in ("lang", "source", "shard")], pa.array([some], pa.list_(pa.int32())), pa.array([total[some]], pa.list_(pa.int64())), first.column("part")],
            ["lang", "source", "shard", "slots", "counts", "part"],
        )


def _summed(rows: DataFrame, tasks: int, how: Audit) -> DataFrame:
    """(lang, source, shard, slots, counts), summed over tasks, a bounded number at a time."""
    rows = rows.select("lang", "source", "shard", "slots", "counts", "part")
    schema = "lang string, source string, shard int, slots array<int>, counts array<long>, part int"
    while True:
        tasks = -(-tasks // how.fan_in)
        rows = rows.withColumn("part", F.expr(f"part div {how.fan_in}").cast("int") if tasks > 1 else F.lit(0))
        rows = rows.groupBy("lang", "source", "shard", "part").applyInArrow(_sum_arrays, schema)
        if tasks <= 1:
            return rows.drop("part")


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / total), by long division so that no product overflows."""
    rest = counts + 2
    out, rest = rest // total, rest % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _compare(reported: int):
    """The sources of a tile, or of two, over the terms of one shard of their language."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lang, shard = rows[0]["lang"], next((r for r in rows if r["source"] is None), None)
        groups = sorted((r for r in rows if r["source"] is not None), key=lambda r: (r["tile"], r["source"]))
        size = rows[0]["size"]

        def own(r: dict) -> tuple[np.ndarray, np.ndarray]:
            counts = np.zeros(size, np.int64)
            if r["slots"]:
                counts[r["slots"]] = r["counts"]
            return counts, shares(counts, r["total"] + 2 * r["kept"]) if size else counts

        out: list[tuple[str, str, str, int]] = []
        all_counts = [own(r) for r in groups]
        p = np.stack([s for _, s in all_counts]) if groups else np.zeros((0, size), np.int64)
        same = rows[0]["i"] == rows[0]["j"]
        for i, r in enumerate(groups):
            # in a tile each pair once; between two, those of the first with those of the second
            first = i + 1 if same else next((k for k, g in enumerate(groups) if g["tile"] != groups[0]["tile"]), len(groups))
            if same or r["tile"] == groups[0]["tile"]:
                values = distance(p[i], p[first:]).sum(axis=1)
                out += [(r["source"], "pair", g["source"], int(v)) for g, v in zip(groups[first:], values, strict=True)]
        if same and shard is not None and size:
            _, q = own(shard)
            terms = np.array([t.encode() for t in shard["terms"]], object)
            for r, (counts, mine) in zip(groups, all_counts, strict=True):
                some = np.flatnonzero((counts > 0) & (mine > q))
                values = distance(mine[some], q[some])
                if len(some) > reported:
                    # all that reach the last reported value, as ties go by the term
                    least = np.partition(values, -reported)[-reported]
                    some, values = some[values >= least], values[values >= least]
                best = sorted(zip((-values).tolist(), terms[some], strict=True))[:reported]
                out += [(r["source"], "term", t.decode(), -v) for v, t in best]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        types = [pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.Table.from_arrays(
            [pa.array([lang] * len(out), pa.string()), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
            ["lang", "source", "part", "item", "value"],
        )

    return run


def recounted(docs: DataFrame, kept: DataFrame, how: Audit) -> tuple[DataFrame, DataFrame]:
    """The settled shards of `kept`, and (lang, source, shard, slots, counts) over all documents.

    Rows without a source are of the whole language.
    """
    spark = docs.sparkSession
    shards = settle(shards_of(kept, how))
    sent = shards.where("sent").select("lang", "shard", "shards", "levels", "bits", "terms").toArrow()
    rest = shards.where("NOT sent").select("lang", "shard", F.posexplode("terms").alias("slot", "term"))
    some_rest = not shards.where("NOT sent").isEmpty()
    broadcast = spark.sparkContext.broadcast(sent)
    found = _recount(docs, broadcast, how, some_rest)
    if some_rest:
        found = settle(found)
    tasks = docs.rdd.getNumPartitions()
    parts = [_summed(found.where("shard IS NOT NULL"), tasks, how)]
    if some_rest:
        by_source = found.where("term IS NOT NULL").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
        slotted = settle(by_source.join(rest, ["lang", "term"]).select("lang", "source", "shard", "slot", "n"))
        of_lang = slotted.groupBy("lang", F.lit(None).cast("string").alias("source"), "shard", "slot").agg(F.sum("n").alias("n"))
        packed = slotted.unionByName(of_lang).groupBy("lang", "source", "shard").agg(F.collect_list(F.struct("slot", "n")).alias("p"))
        parts.append(packed.select("lang", "source", "shard", F.col("p.slot").alias("slots"), F.col("p.n").alias("counts")))
    counts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return shards, settle(counts)


def source_divergence(docs: DataFrame, how: Audit = Audit()) -> DataFrame:
    """lang, source, part, item, value, rank from documents (text, lang, source).

    Part `pair`: the other sources of the language by the summed difference of all kept terms.
    Part `term`: the terms by which a source exceeds its language most.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = settle(kept_terms(docs, how))
    shards, counts = recounted(docs, kept, how)

    # every group with its total, that of its language, and the number of kept terms
    totals = counts.select("lang", "source", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    totals = totals.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    languages = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = docs.select("lang", "source").distinct()
    groups = groups.join(totals.where("source IS NOT NULL"), ["lang", "source"], "left").join(languages, "lang", "left")
    of_lang = groups.groupBy("lang").agg(F.ceil(F.count("*") / how.tile).cast("int").alias("tiles"))
    groups = settle(groups.join(of_lang, "lang").select(
        "lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"),
        "tiles", F.pmod(F.xxhash64("source"), "tiles").cast("int").alias("tile"),
    ))

    # a row for each source and shard, with what was counted there; a language without kept terms has one empty shard
    pieces_of = shards.select("lang", "shard", F.size("terms").alias("size"))
    placed = groups.join(pieces_of, "lang", "left").withColumns({"shard": F.coalesce("shard", F.lit(-1)), "size": F.coalesce("size", F.lit(0))})
    placed = placed.join(counts.where("source IS NOT NULL"), ["lang", "source", "shard"], "left")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    placed = placed.withColumn("other", other).select(
        "lang", "shard", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile",
        "source", "size", "slots", "counts", "total", "kept", F.lit(None).cast("array<string>").alias("terms"),
    )
    # the language's own counts and terms go to every tile that is compared with itself
    per_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kept").alias("kept"), F.max("tiles").alias("tiles"))
    whole = shards.join(per_lang, "lang").join(counts.where("source IS NULL").drop("source"), ["lang", "shard"], "left")
    whole = whole.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "lang", "shard", F.col("tile").alias("i"), F.col("tile").alias("j"), "tile",
        F.lit(None).cast("string").alias("source"), F.size("terms").alias("size"), "slots", "counts", "total", "kept", "terms",
    )
    both = placed.unionByName(whole)
    found = settle(both.groupBy("lang", "shard", "i", "j").applyInArrow(_compare(how.reported), "lang string, source string, part string, item string, value long"))

    summed = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    turned = summed.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value")
    pairs = summed.unionByName(turned)
    terms = found.where("part = 'term'")
    return _ranked(pairs).unionByName(_ranked(terms, how.reported))


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    out = rows.withColumn("rank", rank)
    out = out if most is None else out.where(F.col("rank") <= most)
    return out.select("lang", "source", "part", "item", "value", "rank")
