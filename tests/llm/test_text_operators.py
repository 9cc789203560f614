"""Quality rules, languages, LM scoring, pseudonyms, tokens and packing against plain Python."""

import gc
import hashlib
import math
import re
from collections import Counter
from types import SimpleNamespace
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hindsight.llm import bpe, language, lm, packing, pseudonyms, quality, wordlm
from hindsight.llm.arrays import bytes_of
from hindsight.llm.queries import PSEUDONYM_KEY, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = st.lists(st.text(st.sampled_from("ab é\n\t 漢#'s1!"), max_size=40), min_size=1, max_size=6)


def measures(text):
    words = WORD.findall(text)
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(runs)
    lines = Counter(line for line in text.split("\n") if WORD.search(line))
    covered = {i + k for i, r in enumerate(runs) if many[r] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(n - 1 for n in lines.values()), len(covered)
    )


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_measures_of_any_texts(texts):
    import pyarrow as pa

    found = quality.measure_texts(*bytes_of(pa.array(texts, pa.string())))
    assert list(zip(*[found[m].tolist() for m in quality.MEASURES], strict=True)) == [measures(t) for t in texts]


def test_quality_rules(docs, no_docs, rows):
    found = quality.quality_rules(docs).collect()
    assert sorted(map(str, (r[:6] for r in found))) == sorted(str((r[0], *measures(r[1] or ""))) for r in rows)
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.host_kept)
    assert quality.quality_rules(no_docs).count() == 0
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in found if r.kept)


def test_hosts_are_judged_by_shrunken_shares(spark):
    rows = [("bad", i < 90) for i in range(100)] + [("small", True)] + [(f"fine{h}", i < 5) for h in range(30) for i in range(100)] + [(None, True)]
    found = {r.host: r for r in quality.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean"), "host", quality.Rules()).collect()}
    shares = [r.failing / r.documents for r in found.values()]
    mean = sum(shares) / len(shares)
    spread = sum((s - mean) ** 2 for s in shares) / len(shares)
    weight = max(1.0, mean * (1 - mean) / spread - 1)
    assert found["small"].shrunk == pytest.approx((1 + mean * weight) / (1 + weight))
    assert None not in found and not found["bad"].host_kept and all(r.host_kept for h, r in found.items() if h.startswith("fine"))


def test_languages(spark, docs, no_docs):
    speech = {"xx": "abba baba abab bab ", "yy": "cddc dcdc cdcd dcd ", "zz": "éffe féfé efef fef "}
    rows = [(i, text * (1 + i % 9), lang) for i, (lang, text) in enumerate(list(speech.items()) * 60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language.identify(table).collect()}
    for i, _, lang in rows:
        assert found[i].held_out == (crc32(str(i).encode()) % 4 == 2)
        assert found[i].lang_pred == lang and 0 <= found[i].score <= 1
    odd = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(odd) == docs.count() and {(r.lang_pred, r.score) for r in odd} == {("und", 0.0)}
    assert language.identify(no_docs).count() == 0
    some = language.learn(table)
    odd = {r.doc_id: r for r in language.classify(spark.createDataFrame([(1, None), (2, "12 !"), (3, "abba bab")], "doc_id long, text string"), some, reject=False).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3)] == ["und", "und", "xx"]
    # a margin that no text has rejects all
    assert {r.lang_pred for r in language.classify(table, some, language.Settings(narrow=2.0)).collect()} == {"und"}


def test_what_letters_are():
    """Letters with their marks; numbers, signs and marks alone are none."""
    none = ["", "12 !", "\u00b2", "\u00bd \u00bd", "\u2167", "_", "\u0301 \u093f"]
    assert [language.letters(t) for t in none] == [b""] * len(none)
    assert language.letters("  Ab1c_D\u00b2 ") == b"ab c d"
    for word in ("\u0939\u093f\u0928\u094d\u0926\u0940", "\u0e20\u0e32\u0e29\u0e32\u0e44\u0e17\u0e22", "cafe\u0301"):
        assert language.letters(f"{word}, {word}") == f"{word} {word}".encode()


def test_texts_and_languages_of_a_learned_model(spark):
    """Every language is learned; copies fill no places; every row has what plain Python finds for its text."""
    alphabet = [chr(0x4E00 + i) for i in range(900)]
    rows = [(i, " ".join(alphabet[3 * lang] + alphabet[3 * lang + i % 3] for _ in range(30)), f"l{lang:03d}") for i, lang in enumerate(list(range(300)) * 3)]
    rows += [(5000 + i, "copied text that is short", "copies") for i in range(300)] + [(6000 + i, f"others say {'abcdefghij'[i % 10]} word {'xyz'[i % 3] * 9}", "copies") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    some = language.learn(table)
    assert {lang for lang, _ in some} == {r[2] for r in rows}
    own = dict(some)["copies"]
    assert own.count(b"copied") == 1 and own.count(b"others") == 30
    few = language.learn(table.where("lang IN ('copies', 'l001', 'l002')"))
    odd = [(1, None), (2, "\u00b2"), (3, "copied text " * 40_000), (4, rows[1][1]), (4, rows[1][1]), (5, ""), (None, "others say x")]
    found = language.classify(spark.createDataFrame(odd, "doc_id long, text string"), few, reject=False).collect()
    known = language.Classifier(few, language.Settings())
    want = [(i, *known.predict(t)[:2]) for i, t in odd]
    assert sorted(map(str, [(r.doc_id, r.lang_pred, r.score) for r in found])) == sorted(map(str, want))
    assert [w[1] for w in want] == ["und", "und", "copies", "l001", "l001", "und", "copies"]


def test_learning_is_bounded(spark):
    table = spark.createDataFrame([("xx", "ab c" * 3000 + str(i)) for i in range(50)], "lang string, text string")
    (name, raw), = language.learn(table, language.Settings(dictionary_bytes=5000, sample_texts=4))
    assert name == "xx" and 0 < len(raw) <= 5000


def model(texts):
    """Counts of all orders, and the loss of a symbol after three others."""
    seen = [Counter() for _ in range(lm.ORDER + 1)]
    for t in texts:
        s = [lm.START] * 3 + [int(lm.CLASSES[b]) for b in t.encode()]
        for i in range(3, len(s)):
            for k in range(lm.ORDER + 1):
                seen[k][tuple(s[i + 1 - k : i + 1])] += 1
    context = [Counter() for _ in range(lm.ORDER + 1)]
    for k in range(1, lm.ORDER + 1):
        for g, n in seen[k].items():
            context[k][g[:-1]] += n

    def loss(gram):
        share = 1 / lm.SYMBOLS
        for k in range(1, lm.ORDER + 1):
            g = gram[-k:]
            share = (seen[k][g] + lm.STRENGTH * share) / (context[k][g[:-1]] + lm.STRENGTH)
        return round(-math.log2(share) * lm.UNIT)

    return loss


def test_cross_entropy_difference(spark, docs, no_docs, rows):
    rows = [r for r in rows if len(r[1] or "") < 3000]
    few = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    wanted = spark.createDataFrame([(i,) for i in range(0, 60, 3)] + [(5,), (None,), (3,)], "doc_id long")
    target_ids = {i for i in range(0, 60, 3)} | {5}
    target = model([r[1] or "" for r in rows if r[0] in target_ids])
    rest = model([r[1] or "" for r in rows if r[0] not in target_ids])
    found = lm.cross_entropy_difference(few, wanted).collect()
    want = []
    for r in rows:
        s = [lm.START] * 3 + [int(lm.CLASSES[b]) for b in (r[1] or "").encode()]
        grams = [tuple(s[i : i + 4]) for i in range(len(s) - 3)]
        sums = [sum(map(m, grams)) for m in (target, rest)]
        want.append((r[0], len(grams), *[x / (max(1, len(grams)) * lm.UNIT) for x in (*sums, sums[1] - sums[0])]))
    by = lambda r: (r[0] is None, r[0] or 0, r[1])
    for a, b in zip(sorted(map(tuple, found), key=by), sorted(want, key=by), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-4)
    assert lm.cross_entropy_difference(no_docs, wanted).count() == 0
    assert lm.cross_entropy_difference(docs, wanted.limit(0)).count() == docs.count()


def word_tokens(text):
    return re.findall("[\u3000-\U0010ffff]|[A-Za-z0-9\x80-\u2fff]+|[^\x20\x09-\x0D]", text)


def word_losses(rows, target_ids):
    """(doc_id, events, losses) of each row by counting all others."""
    read = [["", *t, ""] if (t := word_tokens(r[1] or "")) else [] for r in rows]
    vocabulary = {w for t in read for w in t}
    of = [r[0] in target_ids for r in rows]
    one, two = [[Counter() for _ in range(2)] for _ in range(2)]
    for t, m in zip(read, of, strict=True):
        one[m].update(t[1:])
        two[m].update(zip(t, t[1:]))
    total = [sum(c.values()) for c in one]
    out = []
    for r, t, m in zip(rows, read, of, strict=True):
        losses = []
        for model in (True, False):
            own, own2 = (Counter(t[1:]), Counter(zip(t, t[1:]))) if m == model else (Counter(), Counter())
            n, share = total[model] - sum(own.values()), wordlm.STRENGTH / len(vocabulary)
            c, c2 = one[model], two[model]
            bits = [
                -math.log2((c[b] - own[b] + share) / (n + 8)) - math.log2((c2[a, b] - own2[a, b] + share) / (c[a] - own[a] + 8)) for a, b in zip(t, t[1:])
            ]
            losses.append(sum(bits) / 2 / max(1, len(bits)))
        out.append((r[0], max(0, len(t) - 1), *losses, losses[1] - losses[0]))
    return out


@pytest.mark.parametrize("how", [wordlm.Routes(), wordlm.Routes(1, 2), wordlm.Routes(1, 2, 40)])
def test_word_models(spark, docs, no_docs, rows, how):
    odd = ["漢字漢 é1 É1 7 8, a\x01b", "x\u00a0y z", "Stopped stopped STOPPED 12 13", "漢字 é1 É1 8 8", "ab\u3000c\U0001f389d"] * 3
    rows = [r[:2] for r in rows if len(r[1] or "") < 3000] + [(500 + i, t) for i, t in enumerate(odd)]
    few = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target_ids = {*range(0, 60, 3), 5, 500, 501, 502}
    wanted = spark.createDataFrame([(i,) for i in [*target_ids, 3, None]], "doc_id long")
    found = wordlm.cross_entropy_difference(few, wanted, how).collect()
    by = lambda r: (r[0] is None, r[0] or 0, r[1])
    for a, b in zip(sorted(map(tuple, found), key=by), sorted(word_losses(rows, target_ids), key=by), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-4)
    assert wordlm.cross_entropy_difference(no_docs, wanted, how).count() == 0
    assert wordlm.cross_entropy_difference(docs, wanted.limit(0), how).count() == docs.count()


def test_lm_query_tells_words_and_letters_apart(spark, tmp_path):
    rows = [(i, "ÀÀ 12 Ab" if i % 2 else "ÉÉ 34 aB") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.doc_id: r.score for r in QUERIES["op5_lm_scoring"](spark, str(tmp_path)).collect()}
    assert len(found) == 40 and all((found[i] > 1) == (i % 2 == 1) and abs(found[i]) > 1 for i in found)


def test_pseudonyms(spark, docs, no_docs):
    texts = [
        "card 4785380592391139, 4785-3805 9239 1139; bad 4785380592391138", "+1 (569) 555-6633 or 569-555-6633; 169-555-6633",
        "10.0.0.1. 256.1.1.1 1.2.3.4.5 01.2.3.4", "2024-02-29, 29.02.2024 02/29/2024 2023-02-29 1999-13-01", "123-45-6789 000-12-1234",
        "john.Doe99@example.co.uk.", "GB82 WEST 1234 5698 7654 32 DE89370400440532013001", None, "", "5 @ é", "2024-02-29 10.0.0.1",
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pseudonyms.pseudonyms(table, PSEUDONYM_KEY)
    new = {r.doc_id: r for r in out.collect()}
    assert [new[i].n_replaced for i in range(11)] == [2, 2, 1, 3, 1, 1, 1, 0, 0, 0, 2]
    shape = lambda t: t and re.sub("[0-9]+", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", t)))
    for i, t in enumerate(texts):
        assert shape(new[i].text) == shape(t)
        assert (new[i].text == t) == (new[i].n_replaced == 0)
    first, second = new[0].text[5:21], new[0].text[23:42]
    digits = [int(c) for c in reversed(first)]
    assert re.sub(r"\D", "", second) == first and first != "4785380592391139"
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert new[1].text[3:17].translate(str.maketrans("", "", "() -")) == new[1].text[21:33].replace("-", "")
    year, month, day = new[3].text[:10].split("-")
    assert new[3].text[12:33] == f"{day}.{month}.{year} {month}/{day}/{year}"[:21]
    assert new[10].text.split()[0] == new[3].text[:10] and new[10].text.split()[1] == new[2].text.split(". ")[0]
    iban = new[6].text[:27].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert {r.doc_id: r.text for r in pseudonyms.reveal(out, PSEUDONYM_KEY).collect()} == dict(enumerate(texts))
    assert pseudonyms.pseudonyms(table, "another key").where("doc_id = 0").first().text != new[0].text
    assert pseudonyms.pseudonyms(no_docs, "k").count() == 0
    clean = pseudonyms.with_pseudonyms(docs, "k")
    assert clean.columns == docs.columns and sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))


def test_pseudonyms_of_numbers_that_are_not_assigned(spark):
    texts = [
        "233.254.104.120", "0.0.0.0", "255.255.255.255", "224.0.0.1", "223.1.2.3", "1.0.0.0", "+1 (017) 555-7713", "+1 (132) 555-1352", "(569) 055-6633",
        "+1 169-155-6633", "+1 (569) 555-6633", "900-70-1234", "666-12-3456", "123-00-4567", "123-45-0000", "999-00-0000", "667-12-3456", "665-12-3456",
        "256.1.1.1", "000-12-1234", "169-555-6633",
    ]
    table = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(texts)], "doc_id long, text string")
    for key in ("k", "l", "m"):
        out = pseudonyms.pseudonyms(table, key)
        new = {r.doc_id: r for r in out.collect()}
        assert [new[i].n_replaced for i in range(len(texts))] == [1] * 18 + [0] * 3
        for i, t in enumerate(texts[:18]):
            assert new[i].text != f"x {t} y" and re.sub("[0-9]+", "0", new[i].text) == re.sub("[0-9]+", "0", f"x {t} y")
        assert {r.doc_id: r.text for r in pseudonyms.reveal(out, key).collect()} == {i: f"x {t} y" for i, t in enumerate(texts)}


def test_cards_and_ibans_beside_other_numbers(spark):
    card, iban = "4785380592391139", "BE68539007547034"
    parts = {
        "% 123": card, "% 12/27": card, "12 %": card, "% 2024-02-29": card, "% 569-555-6633": card, "1 % 5 77": card, "% 1": "4785 3805 9239 1139",
        "1234 %": "4785 3805 9239 1139", "% 12/28": "4785 3805 9239 1139", "% 1234": "3782 822463 10005", "% 12-27": "47853805 92391139",
        "% 2024": iban, "% ABC": iban, "% ABCD": "BE68 5390 0754 7034", "% 2024-02-29": "BE68 5390 0754 7034",
    }
    texts = [(f.replace("%", v), v) for f, v in parts.items()]
    twice = ["4785 3805 9239 1139 4785 3805 9239 1139", f"{card} {card}", f"{iban} GB82 WEST 1234 5698 7654 32"]
    table = spark.createDataFrame(list(enumerate([t for t, _ in texts] + twice)), "doc_id long, text string")
    out = pseudonyms.pseudonyms(table, "k")
    new = {r.doc_id: r for r in out.collect()}
    for i, (t, v) in enumerate(texts):
        assert v not in new[i].text and new[i].n_replaced >= 1, t
        assert re.sub("[0-9A-Z]", "0", new[i].text) == re.sub("[0-9A-Z]", "0", t)
    assert [new[len(texts) + i].n_replaced for i in range(3)] == [2, 2, 2]
    assert new[0].text.endswith(" 123") and new[0].text[:16] == new[2].text[3:]
    # groups that are no card with all of them stay
    wide = spark.createDataFrame([(0, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17"), (1, "4785380592391138 123"), (2, "7 " * 5000)], "doc_id long, text string")
    assert {r.n_replaced for r in pseudonyms.pseudonyms(wide.where("doc_id < 2"), "k").collect()} == {0}
    assert pseudonyms.pseudonyms(wide, "k").count() == 3


def test_feistel_is_a_permutation(spark):
    pairs = spark.range(189 * 773).select(F.array((F.col("id") % 189).cast("int"), F.floor(F.col("id") / 189).cast("int")).alias("v"))
    bases = F.array(F.lit(189), F.lit(773))
    moved = pairs.select("v", pseudonyms.feistel(F.col("v"), bases, "k", "t").alias("w"))
    assert moved.select("w").distinct().count() == 189 * 773
    assert moved.where(pseudonyms.feistel(F.col("w"), bases, "k", "t", back=True) != F.col("v")).count() == 0


@pytest.fixture(scope="module")
def tokenizers():
    ranks = bpe.tokenizer_of_ranks(RANKS, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    return bpe.Encoder(ranks), bpe.token_bytes(ranks), other, bpe.Encoder(bpe.tokenizer_of_json(JSON))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abc'stre  \n\t\x85\x1c é漢🎉<|endoftext|>019.\0"), max_size=50) | st.text(max_size=30), max_size=5))
def test_encoders_give_what_whole_texts_give(tokenizers, texts):
    ranks, table, other, json = tokenizers
    for t, a, b in zip(texts, ranks.encode(texts), json.encode(texts), strict=True):
        ids = np.frombuffer(a, "<u4").tolist()
        assert ids == other.encode_ordinary(t)
        assert np.frombuffer(b, "<u4").tolist() == json.tokenizer.encode(t, add_special_tokens=False).ids
        assert bpe.decode(ids, table) == t.encode()
        begin, end = bpe.character_spans(np.array(ids, dtype=np.int64), table)
        for i, x, y in zip(ids, begin, end, strict=True):
            assert table[i] in t[x:y].encode() and y > x
        if ids:
            assert begin[0] == 0 and end[-1] == len(t) and (begin[1:] <= end[:-1]).all()


def test_a_full_cache_starts_anew(tokenizers, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 40)
    code = bpe.Encoder(tokenizers[0].tokenizer)
    texts = [" ".join(f"w{i * 7 % 50}x{j}" for j in range(30)) for i in range(20)]
    for t in texts + texts:
        assert np.frombuffer(code.encode([t])[0], "<u4").tolist() == tokenizers[2].encode_ordinary(t)
        assert len(code.kept) <= 80


def test_no_word_is_encoded_twice_in_a_call(tokenizers, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 40)
    code, made = bpe.Encoder(tokenizers[3].tokenizer), Counter()
    model = code.model
    code.model = SimpleNamespace(tokenize=lambda name: made.update([name]) or model.tokenize(name))
    texts = [" ".join(f"{'abcdefgh'[(i + j) % 8]}{'stuvwxyz'[j % 8]}ing{'.,'[j % 2]}" for j in range(30)) for i in range(30)]
    for t in texts:
        made.clear()
        assert np.frombuffer(code.encode([t])[0], "<u4").tolist() == code.tokenizer.encode(t, add_special_tokens=False).ids
        assert max(made.values(), default=0) <= 1
    assert gc.isenabled()


def test_round_trips(docs, no_docs, rows, tokenizers):
    want = []
    for r in rows:
        ids = tokenizers[2].encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    found = bpe.round_trips(docs, RANKS, public_tokenizers.PATTERN)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert bpe.round_trips(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    back = bpe.decode_ids(bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(str((r[0], r[1] or "")) for r in rows)


def test_packing(docs, no_docs, rows, tokenizers):
    how = packing.Packing(capacity=256, partition_pieces=40)
    found = packing.pack(docs, JSON, how=how).collect()
    filled = {}
    for r in sorted(found, key=lambda r: r.offset):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 256
    want = []
    for doc in rows:
        ids = np.frombuffer(tokenizers[3].encode([doc[1] or ""])[0] + bytes(4), "<u4")
        first = len(ids) % 256 or 256
        cuts = [0, *range(min(first, len(ids)), len(ids), 256), len(ids)]
        want += [(doc[0], n, a, b - a, crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(str(tuple(r)[:5]) for r in found) == sorted(map(str, want))
    bound = packing.lower_bound(np.bincount([r.length for r in found], minlength=257), 256)
    assert bound <= len(filled) <= bound + 3
    assert packing.pack(no_docs, JSON).count() == 0


def test_deals_do_not_mix(spark):
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 100, 3000).tolist() + rng.integers(40, 60, 1000).tolist()
    items = spark.createDataFrame(list(enumerate(sizes)), "row long, length long")
    found = packing.pack_items(items, packing.Packing(capacity=100, partition_pieces=300)).collect()
    assert sorted(r.row for r in found) == list(range(4000))
    filled = Counter()
    for r in sorted(found, key=lambda r: r.offset):
        assert filled[r.sequence_id] == r.offset
        filled[r.sequence_id] += sizes[r.row]
    assert max(filled.values()) <= 100


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_bounds_and_bins(sizes):
    sizes = np.array(sizes, dtype=np.int64)
    sequence, offset = packing.best_fit_decreasing(sizes, 12)
    filled = Counter()
    for i in np.argsort(offset, kind="stable"):
        assert filled[sequence[i]] == offset[i]
        filled[sequence[i]] += int(sizes[i])
    assert all(v <= 12 for v in filled.values())

    def least(rest, rooms):
        """The fewest sequences, by trying everything."""
        if not rest:
            return len(rooms)
        out = least(rest[1:], [*rooms, 12 - rest[0]])
        for i, r in enumerate(rooms):
            if r >= rest[0] and r not in rooms[:i]:
                out = min(out, least(rest[1:], [*rooms[:i], r - rest[0], *rooms[i + 1 :]]))
        return out

    best = least(sorted(sizes.tolist(), reverse=True), [])
    assert packing.lower_bound(np.bincount(sizes, minlength=13), 12) <= best <= len(filled)
