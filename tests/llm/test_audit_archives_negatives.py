"""Source divergence, WARC archives and hard negatives against plain Python."""

import base64
import gzip
import hashlib
import io
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindsight.llm import divergence, negatives, warc
from hindsight.llm.divergence import Audit, source_divergence
from hindsight.llm.negatives import Mining, hard_negatives
from hindsight.llm.perfecthash import PerfectHash, Shard, hashes
from hindsight.llm.shared import ship


# Perfect hashes


def test_perfect_hash(spark):
    rnd = random.Random(1)
    words = list({bytes(rnd.choices(range(97, 123), k=rnd.randint(1, 9))) for _ in range(6000)})
    cuts = [words[:1], words[1:900], [], words[900:4000]]
    table = PerfectHash([Shard.of(c) for c in cuts])
    for i, keys in enumerate(cuts):
        slots = table.slots(keys, hashes(keys), np.full(len(keys), i))
        assert sorted(slots) == list(range(table.first[i], table.first[i + 1]))
        assert [table.keys[s].as_py() for s in slots] == keys
    others = words[4000:]
    assert (table.slots(others, hashes(others), np.full(len(others), 3)) == -1).all()
    # as Spark's own function, which deals the keys to their shards
    texts = ["", "a", "né", "x" * 100, *[w.decode() for w in words[:50]]]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()
    assert [r[0] for r in found] == hashes([t.encode() for t in texts]).view(np.int64).tolist()


def test_perfect_hash_of_keys_with_one_hash(monkeypatch):
    import hindsight.llm.perfecthash as module

    monkeypatch.setattr(module, "hashes", lambda keys: np.array([k[0] for k in keys], np.uint64))
    keys = [b"ab", b"ac", b"bd", b"ae", b"cc"]
    shards = [Shard.of(keys), Shard.of([b"zz", b"zy"]), Shard.of([b"q"])]
    table = PerfectHash(shards)
    for i, s in enumerate(shards):
        strings = [*s.keys, b"an", b"none"]
        slots = table.slots(strings, module.hashes(strings), np.full(len(strings), i))
        assert slots.tolist() == [*range(table.first[i], table.first[i + 1]), -1, -1]


# Source divergence


def audit_of(rows, least, reported):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    seen = Counter((lang, t) for lang, _, terms in docs for t in set(terms))
    kept = defaultdict(list)
    for (lang, t), n in seen.items():
        if n >= least:
            kept[lang].append(t)
    groups = defaultdict(Counter)
    for lang, source, terms in docs:
        some = Counter(t for t in terms if t in set(kept[lang]))
        groups[lang, source] += some
        groups[lang, None] += some

    def share(lang, source):
        counts = groups[lang, source]
        total = sum(counts.values()) + 2 * len(kept[lang])
        return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept[lang]}

    out = []
    for lang, source in [g for g in groups if g[1] is not None]:
        p = share(lang, source)
        value = lambda q: {t: (p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in p}  # noqa: E731, B023
        q = share(lang, None)
        parts = {"pair": [(-sum(value(share(lang, o)).values()), o) for k, o in groups if k == lang and o not in (None, source)]}
        parts["term"] = sorted((-v, t) for t, v in value(q).items() if groups[lang, source][t] and p[t] > q[t])[:reported]
        for part, items in parts.items():
            items.sort(key=lambda x: (x[0], x[1].encode()))
            out += [(lang, source, part, item, -v, rank) for rank, (v, item) in enumerate(items, 1)]
    return sorted(out)


def odd_texts():
    rnd = random.Random(5)
    vocabulary = ["Über", "naïve", "ok", "Zebra", "a", "é", "日本", "don't", "x1y", "İstanbul", *["w" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(60)]]
    rows = [
        (" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 60))), rnd.choice(["en", "de", None]), rnd.choice(["s0", "s0", "s1", "s2", "s3", "S3", None, "é"]))
        for _ in range(160)
    ]
    rows += [(None, "en", "s9"), ("", "xx", "s1"), ("only here", "xx", "s2"), (None, None, None), ("1 2 3 --", "yy", "s0")]
    return rows + rows[:20] + [("wa " * 3000 + "wb", "en", "s1")]


ODD_COLUMNS = "text string, lang string, source string"


@pytest.mark.parametrize("how", [
    Audit(least_documents=4),
    Audit(least_documents=4, tile=2, shard_keys=8, held=30, cells=40, fan_in=2),
    Audit(least_documents=4, tile=3, shard_keys=8, sent_bytes=1200),
    Audit(least_documents=4, sent_bytes=0, reported=2),
])
def test_source_divergence(spark, how, monkeypatch):
    ship(spark)
    rows = odd_texts()
    docs = spark.createDataFrame([(*r, "c", "d", 1) for r in rows], ODD_COLUMNS + ", term string, shard string, n int").repartition(5)
    found = sorted(tuple(r) for r in source_divergence(docs, how).collect())
    assert found == audit_of(rows, how.least_documents, how.reported)


def test_source_divergence_without_rows_or_terms(spark):
    ship(spark)
    docs = spark.createDataFrame(odd_texts(), ODD_COLUMNS)
    assert source_divergence(docs.limit(0)).count() == 0
    none = source_divergence(docs, Audit(least_documents=10**6)).collect()
    assert {(r.part, r.value) for r in none} == {("pair", 0)}


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = "Aa bb  ccc, ddddddddddddddd é1é " * 5
    cut = list(divergence.pieces(text.encode()))
    assert len(cut) > 5
    assert [t.decode() for p in cut for t in p] == ["aa", "bb", "ccc", "ddddddddddddddd", "é", "é"] * 5


def test_shares_are_exact():
    counts, total = np.array([0, 1, 10**13, 123456789012]), 10**13 + 4 * 10**5
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in counts]


# WARC


def pages_of():
    big = "".join(random.Random(2).choices("<p>é日 ab\r\n", k=150_000))
    rows = [(i, f"http://a/{i % 5}?q=ü x\n", t) for i, t in enumerate(["same", "x", "same", "", None, big, "same", "WARC/1.1\r\n\r\n", big, "é", "\x1f\x08"])]
    return rows + [(2, "dup", "other"), (6, None, "same"), (None, "n", "same"), (None, None, None), (-7, "neg", "x"), (2**62, "", "x")]


def archived(rows, least=0):
    out = []
    raw = [(n, (t or "").encode()) for n, _, t in rows]
    for n, b in raw:
        last = max([m for m, c in raw if c == b and m is not None], default=None) if n is not None and len(b) >= least else n
        sha1 = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((n, len(b), sha1, "response" if n == last else "revisit", None if n == last else last))
    return sorted(out, key=str)


@pytest.mark.parametrize("how", [{}, {"least_bytes": 3}, {"archive_bytes": 1, "level": 0}])
def test_archived_pages(spark, tmp_path, how):
    ship(spark)
    rows = pages_of()
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, last int").repartition(3)
    found = warc.archived_pages(pages, str(tmp_path / "w"), **how)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, found.collect()), key=str) == archived(rows, how.get("least_bytes", 0))
    assert warc.archived_pages(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_archives_are_read_whole(spark, tmp_path):
    """Files, headers, payloads, offsets; each member alone is a gzip file of one record."""
    ship(spark)
    rows = [r for r in pages_of() if r[0] is not None][:9]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    files = warc.write_warc(pages, str(tmp_path / "w"))
    [one] = files.collect()
    raw = open(one.path, "rb").read()
    assert (one.records, one.bytes) == (len(rows), len(raw))
    read = warc.read_warc(files, payloads=True).orderBy("offset").collect()
    assert read[0].type == "warcinfo" and len(read) == len(rows) + 1
    ends = [r.offset for r in read[1:]] + [len(raw)]
    for r, row, begin, end in zip(read[1:], rows, ends, ends[1:], strict=False):
        plain = gzip.decompress(raw[begin:end])
        assert plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n") and plain.count(b"WARC-Type:") == 1
        assert r.problem is None and warc.page_of(r.record_id) == row[0]
        assert r.target_uri == f"http://a/{row[0] % 5}?q=%C3%BC%20x%0A"
        assert bytes(r.payload) == ((row[2] or "").encode() if r.type == "response" else b"")
        assert r.headers["warc-payload-digest"] == f"sha1:{r.payload_digest}"


def member_of(text: bytes) -> bytes:
    return gzip.compress(text)


def test_unsound_archives(monkeypatch):
    good = warc.page_record(1, "http://a", b"payload" * 9, None, "2024-01-01T00:00:00Z", 6)
    plain = gzip.decompress(good)
    broken = {
        "block-digest": plain.replace(b"payloadp", b"paymoadp"),
        "longer": plain.replace(b"payloadp", b"payload!p"),
        "shorter": plain[:-12],
        "two line ends": plain[:-1],
        "WARC version": b"X" + plain,
        "no number": re.sub(rb"\r\nContent-Length: \d+\r\n\r\nHTTP", b"\r\nContent-Length: 1x\r\n\r\nHTTP", plain),
        "no name": plain.replace(b"WARC-Type: ", b"WARC-Type "),
        "headers do not end": plain[:40],
        "payload-digest": re.sub(rb"(WARC-Payload-Digest: sha1:)\w", rb"\g<1>0", plain),
    }
    for chunk in (1, 100, 1 << 16):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        monkeypatch.setattr(warc, "DECOMPRESSED", max(7, chunk // 50))
        for what, text in broken.items():
            found = list(warc.records(io.BytesIO(good + member_of(text) + good), True))
            assert [r.problem is None for r in found] == [True, False, True] and what in found[1].problem
            assert [r.offset for r in found] == [0, len(good), len(good) + len(member_of(text))]
            assert found[2].payload == b"payload" * 9 and found[0].payload_bytes == 63
        for cut in (good[:-3], good[:20], b"nogzip", good[:30] + b"\xff" + good[31:]):
            found = list(warc.records(io.BytesIO(good + cut), False))
            assert found[0].problem is None and found[1].problem.startswith("broken member") and len(found) == 2
        assert list(warc.records(io.BytesIO(b""), False)) == []


def test_other_records_are_read():
    """Two versions, folded and repeated lines, records that are not of HTTP, unknown digests."""
    text = b"WARC/1.0\r\nWARC-Type: resource\r\nX-Long: a\r\n b\r\nwarc-payload-digest: md5:abc\r\ncontent-length: 5\r\n\r\nhello\r\n\r\n"
    [r] = warc.records(io.BytesIO(member_of(text)), True)
    assert r.problem is None and r.headers["x-long"] == "a b" and r.payload == b"hello" and r.payload_bytes == 5
    [empty] = warc.records(io.BytesIO(member_of(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")), True)
    assert empty.problem is None and empty.payload_bytes == 0


def test_record_ids():
    sha1 = hashlib.sha1(b"x").digest()
    for n in (0, 1, -1, 2**63 - 1, -(2**63), 123456789):
        assert warc.page_of(warc.record_id(n, sha1)) == n
    assert warc.page_of(warc.record_id(None, sha1)) is None is warc.page_of("urn:uuid:no") is warc.page_of(None)


# Hard negatives


def mined(rows, is_anchor, k=5):
    """All scores compared, with Python's whole numbers."""
    fine = []
    for n, v, label in dict.fromkeys((n, tuple(v) if v is not None else None, label) for n, v, label in rows):
        if n is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.append((n, [math.floor(256 * x) for x in v], label))
    out = []
    for n, a, label in fine:
        if not is_anchor(n):
            continue
        scores = [(-sum(x * y for x, y in zip(a, v, strict=True)), m, other) for m, v, other in fine if m != n and len(v) == len(a)]
        for s, m, _ in sorted(x[:2] + (0,) for x in scores if x[2] == label)[:k]:
            near = sorted(x[:2] for x in scores if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out += [(n, m, rank, o, -s, -t) for rank, (t, o) in enumerate(near, 1)]
    return sorted(out)


def odd_vectors():
    rnd = np.random.default_rng(3)
    centres = rnd.standard_normal((6, 12))
    rows = [(i, (centres[i % 6] * rnd.uniform(0.2, 3) + 0.3 * rnd.standard_normal(12)).tolist(), int(rnd.integers(0, 4))) for i in range(260)]
    rows += [(300 + i, rows[i % 3][1], i % 4) for i in range(40)]  # ties
    rows += [(400, [0.0] * 12, 1), (401, [0.0] * 12, 2), (402, [0.0] * 12, 1), (403, [1.0] * 5, 1), (404, [1.0] * 5, 2), (405, [0.5] * 5, 1), (410, [2.0] * 5, 1)]
    rows += [(420, [], 1), (421, [], 2), (422, [], 1), (430, [1e5] * 12, 1), (431, [9e4] * 12, 1), (432, [8.5e4] * 12, 2)]
    rows += [(500, None, 1), (510, [1.0, None], 1), (520, [float("nan")] * 12, 1), (530, [float("inf")] * 12, 1), (540, [1.0] * 12, None), (None, [1.0] * 12, 1)]
    rows += [(10, rows[11][1], 3), (440, [3e16] * 5, 1), (441, [3e16] * 5, 1), (442, [3e16] * 5, 2)]
    return rows + rows[:30]


@pytest.mark.parametrize("how", [Mining(), Mining(block_rows=16, asked_bytes=3000, focus=3), Mining(block_rows=40, buckets=1, focus=1)])
def test_hard_negatives(spark, how):
    ship(spark)
    rows = [r for r in odd_vectors() if r[0] is None or r[0] < 440 or r[0] >= 500]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, block int, v string").repartition(4)
    found = hard_negatives(vectors, F.col("vec_id") % 10 == 0, how=how)
    assert sorted(map(tuple, found.collect())) == mined(rows, lambda n: n % 10 == 0)
    assert hard_negatives(vectors.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_scores_beyond_64_bits(spark):
    """They count as the largest 64-bit number."""
    ship(spark)
    rows = [r for r in odd_vectors() if r[0] is not None and 440 <= r[0] < 500]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = hard_negatives(vectors, F.col("vec_id") == 440).collect()
    assert [tuple(r) for r in found] == [(440, 441, 1, 442, 2**63 - 1, 2**63 - 1)]


def test_candidates_miss_no_row_and_leave_rows_out():
    rnd = np.random.default_rng(8)
    centres = rnd.standard_normal((20, 16))
    vectors = centres[rnd.integers(0, 20, 3000)] + 0.1 * rnd.standard_normal((3000, 16))
    # as in a bucket, rows of about one length
    vectors = np.floor(1000 * vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.int64)
    block = negatives.Block(vectors)
    looked_at = 0
    for anchor in vectors[:40]:
        scores = vectors @ anchor
        least = np.sort(scores)[-8]
        some = block.candidates(anchor, float(least), 6)
        assert set(np.flatnonzero(scores >= least)) <= set(some) and len(set(some)) == len(some)
        looked_at += len(some)
        assert (block.scores(some, anchor) == scores[some]).all()
    assert looked_at < 0.2 * 40 * 3000
