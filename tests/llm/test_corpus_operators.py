"""Duplicates, neighbours, tool calls and the pipeline against plain Python."""

import hashlib
import itertools
import json
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from compare import database, difference
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from hindsight.llm import bpe, jaccard, neighbours, oracle, pseudonyms, queries, quality, repeats, suffix, toolcalls
from hindsight.llm.shared import components, ship

SF = "/root/testdata/sf0.001"
LAST = 2**63 - 1


def text_key(row):
    return str(tuple(row))


def components_of(links, nodes):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(range(256)).lower()))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def linked_by(rows):
    """(set size, component) of each row, by comparing all."""
    sets = [shingles(r[1]) for r in rows]
    ids = [LAST if r[0] is None else r[0] for r in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    top = components_of(links, range(len(rows)))
    least = defaultdict(lambda: LAST)
    for i, t in top.items():
        least[t] = min(least[t], ids[i])
    return [(len(sets[i]), least[top[i]] if least[top[i]] < LAST else None) for i in range(len(rows))]


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randint(-40, 400), rnd.randint(-40, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components_of(links, {n for link in links for n in link})
    alone = {a for a, b in links if a == b} - {n for a, b in links if a != b for n in (a, b)}
    assert found == {n: c for n, c in want.items() if n not in alone}


@pytest.mark.parametrize("hot", [64, 3])
def test_similar_documents(docs, rows, hot):
    found = jaccard.similar_documents(docs, hot_owners=hot).collect()
    want = [(r[0], *w) for r, w in zip(rows, linked_by(rows), strict=True)]
    assert sorted(map(text_key, found)) == sorted(map(str, want))


def test_one_of_each(docs, no_docs, rows):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = {w[1] if w[0] else r[0] for r, w in zip(rows, linked_by(rows), strict=True)}
    assert {r.doc_id for r in kept.collect()} == groups
    assert jaccard.one_of_each(no_docs).count() == 0 == jaccard.similar_documents(no_docs).count()


def test_a_large_group_of_near_copies_makes_few_pairs(spark, writers, monkeypatch):
    """Leaders join the group; what is then looked at pair by pair is in proportion to the rows."""
    rnd, (prose, changed) = random.Random(4), writers
    base = prose(rnd, 150)
    texts = [changed(rnd, base, 0.01) for _ in range(200)] + [prose(rnd, 60) for _ in range(60)]
    met = []
    old = jaccard._met_pairs
    monkeypatch.setattr(jaccard, "_met_pairs", lambda *a: met.append(old(*a)) or met[-1])
    rows_ = list(enumerate(texts))
    found = jaccard.similar_documents(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == sorted((r[0], *w) for r, w in zip(rows_, linked_by(rows_), strict=True))
    assert len(met) == 1 and met[0].count() <= 4 * len(texts)


def test_near_copies_that_are_linked_only_through_the_least_changed_make_few_pairs(spark, writers, monkeypatch):
    """Two changed copies are rarely linked with each other, and some with none at all."""
    rnd, (prose, changed) = random.Random(5), writers
    base = prose(rnd, 150)
    texts = [changed(rnd, base, 0.025) for _ in range(300)] + [prose(rnd, 60) for _ in range(60)]
    met, columns = [], []
    pairs, index = jaccard._met_pairs, jaccard._with_component
    monkeypatch.setattr(jaccard, "_met_pairs", lambda *a: met.append(pairs(*a)) or met[-1])
    monkeypatch.setattr(jaccard, "_with_component", lambda *a: columns.append(index(*a)) or columns[-1])
    rows_ = list(enumerate(texts))
    found = jaccard.similar_documents(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    want = sorted((r[0], *w) for r, w in zip(rows_, linked_by(rows_), strict=True))
    assert sorted(map(tuple, found)) == want
    groups = Counter(c for _, _, c in want)
    assert max(groups.values()) > 150 and sum(groups[i] == 1 for i in range(300)) > 20  # one group, and copies outside of it
    assert len(met) == 1 and met[0].count() <= len(texts)
    assert columns[-1].count() <= 10 * len(texts)


def test_packed_rows_are_as_many_as_the_entries_call_for(spark, writers):
    rnd, (prose, _) = random.Random(6), writers
    ship(spark)
    docs = spark.createDataFrame([(prose(rnd, 1000),) for _ in range(250)], "text string").coalesce(1)
    entries = 250 * (1000 - 4)
    packed = repeats.pack_entries(docs, jaccard._entries, 9)
    assert packed.count() <= (1 << 9) + entries / repeats.ROW_ENTRIES
    again = docs.unionAll(docs).withColumn("text", F.concat("text", F.lit(" "))).coalesce(1)
    found = repeats.shared_entries(repeats.pack_entries(again, jaccard._entries, 9), 9).agg(F.count("*"), F.min("extra"), F.max("extra")).first()
    assert tuple(found)[0] == 0  # a set and its copy are one owner


def test_buckets_of_anchors_are_even(spark, writers):
    rnd, (prose, _) = random.Random(8), writers
    ship(spark)
    docs = spark.createDataFrame([(i, prose(rnd, 1000)) for i in range(60)], "row long, text string")
    packed = repeats.pack_entries(docs, suffix._entries, 6)
    sizes = [r["entries"] for r in packed.groupBy("bucket").agg((F.sum(F.octet_length("low")) / 4).alias("entries")).collect()]
    assert len(sizes) == 1 << 6
    assert max(sizes) <= 1.5 * sum(sizes) / len(sizes)  # least hashes as keys had the first bucket get 17 times the mean


def repeats_of(rows):
    """(bytes, kept bytes, spans) of each row, by a table of all strings."""
    first = {}
    ids = [LAST if r[0] is None else r[0] for r in rows]
    raw = [(r[1] or "").encode() for r in rows]
    for i, b in zip(ids, raw, strict=True):
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], LAST), i)
    out = []
    for i, b in zip(ids, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), kept))
    return out


@pytest.mark.parametrize("how", [{}, {"hot_owners": 3, "group_documents": 8, "group_runs": 50}])
def test_repeated_strings(docs, rows, how):
    found = suffix.repeated_strings(docs, **how).collect()
    want = [(r[0], a, b, c, hashlib.sha256(k).hexdigest()) for r, (a, b, c, k) in zip(rows, repeats_of(rows), strict=True)]
    assert sorted(map(text_key, found)) == sorted(map(str, want))


def test_no_stage_of_repeated_strings_has_two_python_nodes(docs):
    plan = suffix.repeated_strings(docs, hot_owners=3, group_documents=8, group_runs=50)._jdf.queryExecution().executedPlan().toString()
    above, found = [], 0
    for line in plan.splitlines():
        name = line.lstrip(" :+-")
        depth = len(line) - len(name)
        while above and above[-1][0] >= depth:
            above.pop()
        above.append((depth, name))
        if "InArrow" in name:
            found += 1
            stage = itertools.takewhile(lambda n: "Exchange" not in n, [n for _, n in reversed(above[:-1])])
            assert not any("InArrow" in n for n in stage)
    assert found >= 4


def test_without_repeats(docs, no_docs, rows):
    found = suffix.without_repeats(docs)
    assert found.columns == docs.columns
    want = []
    for r, (_, gone, _, kept) in zip(rows, repeats_of(rows), strict=True):
        text = kept.decode("utf-8", "ignore") if gone else r[1]
        if text or not gone:
            want.append((r[0], text, None if text is None else len(text)))
    assert sorted(str((r.doc_id, r.text, r.n_chars)) for r in found.collect()) == sorted(map(str, want))
    assert suffix.without_repeats(no_docs).count() == 0 == suffix.repeated_strings(no_docs).count()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=3, max_size=30).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=12, unique=True), st.integers(1, 14), st.data())
def test_least_owner_of_any_strings(runs, length, data):
    owner = np.array(data.draw(st.lists(st.integers(0, 9), min_size=len(runs), max_size=len(runs))))
    at = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    found = suffix.least_owner(np.frombuffer(b"".join(runs), np.uint8), at, owner, length)
    least = {}
    for r, o in zip(runs, owner.tolist(), strict=True):
        for i in range(len(r) - length + 1):
            least[r[i : i + length]] = min(o, least.get(r[i : i + length], o))
    for r, a in zip(runs, at, strict=False):
        for i in range(len(r) - length + 1):
            assert found[a + i] == least[r[i : i + length]]


def exact_neighbours(vectors, k=10):
    usable = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = min(usable.get(i, v), v)
    out = {}
    for q, v in usable.items():
        if q % 100 == 0:
            near = [(float(np.sqrt(np.square(np.array(w) - np.array(v)).sum())), i) for i, w in usable.items() if i != q and len(w) == len(v)]
            out[q] = sorted(near)[:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16))
    vectors = [(i, (centres[i % 20] + 0.3 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(1500)]
    vectors += [(i, vectors[0][1]) for i in range(2000, 2030)] + [(i, [1.0, 2.0 + i]) for i in range(2998, 3004)]
    vectors += [(None, vectors[0][1]), (3100, None), (3200, [0.0] * 16), (3300, [None] * 16), (3400, [float("nan")] * 16), (3500, [])]
    vectors += [(3600, [float("inf")] * 16), (3, [9.0] * 16), (100, vectors[100][1])]
    names = "vec_id long, embedding array<float>, rank string, score string"
    table = spark.createDataFrame([(*v, "r", "s") for v in vectors], names)
    how = neighbours.Search(block_rows=400, query_rows=4)
    found = defaultdict(list)
    for r in sorted(neighbours.nearest(table, F.col("vec_id") % 100 == 0, how).collect(), key=lambda r: r.rank):
        assert r.rank == len(found[r.query_id]) + 1
        found[r.query_id].append((r.score, r.vec_id))
    want = exact_neighbours(vectors)
    assert set(found) == set(want)
    hits = sum(len({i for _, i in found[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.97 * sum(map(len, want.values()))
    assert [len(found[q]) for q in want] == [len(want[q]) for q in want]
    # equal vectors: the smallest numbers, at distance 0
    assert found[0] == [(0.0, i) for i in range(2000, 2010)] == want[0]
    exact = {q: dict((i, s) for s, i in near) for q, near in exact_neighbours(vectors, 10**6).items()}
    assert all(s == pytest.approx(exact[q][i], rel=1e-12) for q, near in found.items() for s, i in near)
    assert neighbours.nearest(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_blocks_meet_all_queries_over_many_partitions(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, rng.standard_normal(8).tolist()) for i in range(900)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = neighbours.nearest(table, F.col("vec_id") % 10 == 0, neighbours.Search(block_rows=100, query_rows=10)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(found) == 900 and len({r.query_id for r in found}) == 90


def test_recall_on_the_test_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = queries.QUERIES["op3_nearest_neighbours"](spark, SF).collect()
    want = exact_neighbours([(r.vec_id, r.embedding) for r in table.collect()])
    hits = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in found)
    assert len(found) == sum(map(len, want.values())) and hits >= 0.9 * len(found)


def test_tool_calls(spark):
    calls = [
        (1, 0, "a", "add", '{"y": 2, "x": {"b":1,"a":[1.50, null]}}', ["b"]),
        (1, 2, "b", "add", '{"x": {}, "z": 1}', ["nobody"]),
        (1, 3, "b", "add", '{"x": {}, "y": 1}', None),
        (1, 4, "c", "sub", "{}", ["a", "b", "a"]),
        (2, 0, "p", "add", "[1]", ["q"]), (2, 1, "q", "add", None, ["p"]), (2, 2, "r", "add", '{"x": {}, "y": "1"}', ["q"]),
        (2, 3, None, "add", '{"x": {}, "y": 1}', []), (None, None, "a", None, "nope", None), (2, 4, "s", "add", '{"x": {}, "y": 1}', ["s"]),
    ]
    results = [(1, 1, "a", "three\n\"é\""), (1, 5, "a", "later"), (1, 6, "ghost", "boo"), (2, 9, "r", None), (1, 7, None, "nobody's")]
    schemas = [("add", "x", "object", True), ("add", "y", "integer", True), ("add", "w", "string", False), (None, "x", "string", True)]
    found = toolcalls.link_calls(
        spark.createDataFrame([(*c, "k") for c in calls], toolcalls.CALLS + ", row string"),
        spark.createDataFrame(results, toolcalls.RESULTS), spark.createDataFrame(schemas, toolcalls.SCHEMAS),
    ).collect()
    rows = {(r.conv_id, r.turn, r.call_id): r for r in found}
    assert len(found) == len(rows) == len(calls) + 2
    a = rows[1, 0, "a"]
    assert (a.status, a.result_turn, a.rank, a.hop, a.errors) == ("linked", 1, 2, 1, "")
    assert a.json == '{"arguments":{"x":{"a":[1.5,null],"b":1},"y":2},"id":"a","name":"add","result":"three\\n\\"é\\""}'
    assert json.loads(a.json)["result"] == 'three\n"é"'
    b = rows[1, 2, "b"]
    assert (b.status, b.rank, b.hop, b.errors) == ("no result", 2, 0, "y: missing; z: not a parameter")
    assert rows[1, 3, "b"].status == "repeated" and rows[1, 3, "b"].errors == ""
    assert rows[1, 4, "c"].errors == "tool: unknown sub" and (rows[1, 4, "c"].rank, rows[1, 4, "c"].hop) == (4, 0)
    assert [(rows[2, t, c].rank, rows[2, t, c].hop) for t, c in ((0, "p"), (1, "q"), (2, "r"), (4, "s"))] == [(-1, -1)] * 4
    assert rows[2, 0, "p"].errors == rows[2, 1, "q"].errors == "arguments: no object"
    assert rows[2, 2, "r"].errors == "y: no integer" and rows[2, 2, "r"].json.endswith('"result":null}')
    assert rows[2, 3, None].status == "no result" and rows[2, 3, None].rank == 3
    assert rows[None, None, "a"].errors == "arguments: no object; tool: unknown null"
    assert rows[1, 6, "ghost"].status == "orphan" and rows[1, 6, "ghost"].json == '{"id":"ghost","result":"boo"}'
    talk = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert toolcalls.conversation_calls(talk).count() == 0


def test_turns_that_are_no_call_or_result_are_left_out_and_said_to_be(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, None, "n"), (1, 4, "tool", "t")]
    found = toolcalls.conversation_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.turn, r.result_turn, r.status) for r in found] == [(1, 2, "linked")]
    assert "give no row" in queries.op8_tool_call_linking.__doc__ and "left out" in toolcalls.turns_as_calls.__doc__


def test_order_of_calls_is_topological(spark):
    rnd = random.Random(11)
    after = {i: [f"n{j}" for j in rnd.sample(range(40), 2) if (j * 7) % 40 < (i * 7) % 40] for i in range(40)}
    calls = [(9, i, f"n{i}", "t", "{}", after[i]) for i in range(40)]
    empty = spark.createDataFrame([], toolcalls.RESULTS), spark.createDataFrame([], toolcalls.SCHEMAS)
    found = toolcalls.link_calls(spark.createDataFrame(calls, toolcalls.CALLS), *empty).collect()
    order = [r.call_id for r in sorted(found, key=lambda r: (r.rank, r.hop, r.turn))]
    assert all(order.index(n) < order.index(f"n{i}") for i, names in after.items() for n in names)


def test_a_cycle_in_a_long_conversation_ends_after_few_rounds(spark, monkeypatch):
    """Two calls that wait for each other, what waits for them, a chain that runs backwards, and 400 others."""
    calls = [(1, i, f"n{i}", "t", "{}", [f"n{i - 1}"]) for i in range(400)]
    calls[50], calls[51] = (1, 50, "n50", "t", "{}", ["n51"]), (1, 51, "n51", "t", "{}", ["n50"])
    calls += [(2, i, f"m{i}", "t", "{}", [f"m{i + 1}"]) for i in range(6)]
    written = []
    old = toolcalls._written
    monkeypatch.setattr(toolcalls, "_written", lambda df: written.append(1) or old(df))
    empty = spark.createDataFrame([], toolcalls.RESULTS), spark.createDataFrame([], toolcalls.SCHEMAS)
    rows = [(*c[:5], [] if c[2] in ("n52", "n60") else c[5]) for c in calls]
    found = {(r.conv_id, r.turn): (r.rank, r.hop) for r in toolcalls.link_calls(spark.createDataFrame(rows, toolcalls.CALLS), *empty).collect()}
    assert found == {(1, i): (-1, -1) if i in (50, 51) else (i, 0) for i in range(400)} | {(2, i): (5, 5 - i) for i in range(6)}
    assert len(written) <= 20


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_its_sql(spark, name):
    found = queries.QUERIES[name](spark, SF).toPandas()
    assert difference(found, database(SF).execute(oracle.ORACLE[name]).df()) == ""


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_strings", "personal_data", "sequences"]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = {r.doc_id for r in quality.quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()}
    rows = [r for r in rows if r[0] in kept]
    rows = [r for r, (_, c) in zip(rows, linked_by(rows), strict=True) if r[0] == c]
    texts = {r[0]: (kept.decode("utf-8", "ignore") if gone else r[1]) for r, (_, gone, _, kept) in zip(rows, repeats_of(rows), strict=True)}
    texts = {i: t for i, t in texts.items() if t}
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in found} == set(texts)
    code = bpe.Encoder(bpe.tokenizer_of_json(public_tokenizers.path("byte_bpe_50k.json")))
    sizes = Counter()
    for r in found:
        sizes[r.doc_id] += r.length
    private = re.compile(r"[0-9@]")
    plain = [i for i, t in texts.items() if not private.search(t)]
    assert len(plain) > 100 and all(sizes[i] == len(code.encode([texts[i]])[0]) // 4 + 1 for i in plain)


def test_all_rows_of_the_pipeline(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = {r.doc_id for r in quality.quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()}
    rows = [r for r in rows if r[0] in kept]
    rows = [r for r, (_, c) in zip(rows, linked_by(rows), strict=True) if r[0] == c]
    texts = [(r[0], kept.decode("utf-8", "ignore") if gone else r[1]) for r, (_, gone, _, kept) in zip(rows, repeats_of(rows), strict=True)]
    table = spark.createDataFrame([t for t in texts if t[1]], "doc_id long, text string")
    code = bpe.Encoder(bpe.tokenizer_of_json(public_tokenizers.path("byte_bpe_50k.json")))
    clean = pseudonyms.pseudonyms(table, queries.PSEUDONYM_KEY).collect()
    assert sum(r.n_replaced > 0 for r in clean) > 0
    want = []
    for r in clean:
        ids = np.frombuffer(code.encode([r.text])[0] + bytes(4), "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(min(first, len(ids)), len(ids), 2048), len(ids)]
        want += [(r.doc_id, n, a, b - a, crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    found = corpus_pipeline.run(spark, SF).collect()
    assert sorted(tuple(r)[:5] for r in found) == sorted(want)
    filled = Counter()
    for r in sorted(found, key=lambda r: r.offset):
        assert filled[r.sequence_id] == r.offset
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048


def test_stages_return_the_columns_of_documents(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS
        assert out.dtypes == docs.select(*corpus_pipeline.COLUMNS).dtypes
