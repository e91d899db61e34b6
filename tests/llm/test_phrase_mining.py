import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chaintally.llm import common, phrase_mining as pm
from conftest import TESTDATA
from llm_cases import AWKWARD, awkward, by_name, duck, table

UPPER = {c: c + 32 for c in range(65, 91)}
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def counts(docs):
    """f and n per language of (lang, text) rows."""
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    return f, n


def brute(docs, support=30, top=2000):
    out, (f, n) = [], counts(docs)
    for lang, found in f.items():
        a = {p: c for p, c in found.items() if len(p) > 1 and c >= support}
        best = {p: min((2_000_000 * c // (found[p[:k]] + found[p[k:]]), k) for k in range(1, len(p))) for p, c in a.items()}
        covered = {p[i:i + g] for p, c in a.items() for g in range(2, len(p)) for i in range(len(p) - g + 1) if 100 * c >= 80 * a[p[i:i + g]]}
        rows = sorted((-best[p][0], -c, " ".join(p).encode(), p) for p, c in a.items() if p not in covered)[:top]
        out += [(lang, i, " ".join(p), a[p], found[p[:best[p][1]]], found[p[best[p][1]:]], n[lang], best[p][0]) for i, (*_, p) in enumerate(rows, 1)]
    return sorted(out, key=repr)


def rows(rng, n=60):
    """Texts over few words, with every separator, blanks in a row, and pieces that end a text or run on."""
    marks = [" "] * 12 + ["  ", "\t", ". ", ",", ";", ":", "!", "?", "\n", "\x0b", "\f", "\r"]
    return [(i, "".join(rng.choice(["New", "york", "CITY", "é", "of", "ÉA", "x#", "漢"]) + rng.choice(marks) for _ in range(rng.randrange(0, 120))),
             rng.choice(["en", "de", None, "und", ""])) for i in range(n)]


@pytest.mark.parametrize("shard,slice_size,together", [(64_000_000, 1 << 22, 100), (700, 1 << 22, 7), (150, 37, 1 << 20)])
def test_equals_brute_force_whatever_the_shards(spark, monkeypatch, shard, slice_size, together):
    monkeypatch.setattr(pm, "SHARD", shard)
    monkeypatch.setattr(pm, "TOGETHER", together)
    monkeypatch.setattr(common, "SLICE", slice_size)
    monkeypatch.setattr(common.slices, "__defaults__", (slice_size,))
    docs = rows(random.Random(shard)) + AWKWARD
    got = pm.collocations(awkward(spark, docs))
    assert table(got, *COLUMNS) == brute([(r[2], r[1]) for r in docs])


def test_empty_tables_and_texts(spark):
    assert table(pm.digest(awkward(spark, []))) == []
    assert table(pm.digest(awkward(spark, [(1, None, "en"), (2, "", None), (3, " \t.,", "en")]))) == []


def test_query_equals_sql_and_brute_force(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    got = pm.digest(docs)
    assert by_name(got) == duck(pm.SQL, documents=docs) and got.count() > 200
    assert table(got, *COLUMNS) == brute([tuple(r) for r in docs.select("lang", "text").collect()])


def test_the_filter_misses_no_candidate_and_the_bound_no_frequent_phrase(spark, monkeypatch):
    # a saturated filter and one shard per text: everything is let through, and sums decide
    monkeypatch.setattr(pm, "BITS", 16)
    monkeypatch.setattr(pm, "SPREAD", 1)
    monkeypatch.setattr(pm, "SHARD", 1)
    docs = rows(random.Random(5), 40)
    found, totals = pm.frequent(awkward(spark, docs), 7)
    f, n = counts([(r[2], r[1]) for r in docs])
    assert table(found, "lang", "phrase", "f") == sorted(((lang, " ".join(p), c) for lang in f for p, c in f[lang].items() if c >= 7), key=repr)
    assert table(totals) == sorted(((lang, c) for lang, c in n.items() if c), key=repr)


def test_totals_beyond_64_bits_stay_exact(spark):
    big = 4 * 10**18
    found = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 3)], "lang string, phrase string, size int, f bigint")
    row = pm.scored(found).first()
    assert row["score"] == 2_000_000 * big // (2 * big + 4) == 999_999
    longer = spark.createDataFrame([("en", "a b", 2, big, 1, 1, 1), ("en", "a b c", 3, big // 100 * 80, 1, 1, 1), ("en", "b c", 2, big, 1, 1, 1), ("de", "b c", 2, 5, 1, 1, 1)],
                                   "lang string, phrase string, size int, a bigint, l bigint, r bigint, score bigint")
    assert sorted((r["lang"], r["phrase"]) for r in pm.uncovered(longer).collect()) == [("de", "b c"), ("en", "a b c")]


def test_the_largest_language_of_a_shard_is_grown_when_the_others_are_gone(monkeypatch):
    text, held, grow = b"a b c d " * 500, [], pm.grow
    rows_ = [("de", 1, text), ("en", 1, text * 9), ("es", 1, text * 2), ("fr", 1, text)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows_)], names=["lang", "weight", "data"])
    shard, = (s for s, _ in pm.shards(rows_))
    monkeypatch.setattr(pm, "shards", lambda _: [(shard, dict.fromkeys(("de", "en", "es", "fr"), 10**6))])

    def watched(run, *rest):
        held.append((len(run), sum(len(x) for runs in shard.runs.values() for x in runs)))
        yield from grow(run, *rest)

    monkeypatch.setattr(pm, "grow", watched)
    found = list(pm.mine(30)([batch]))
    assert len(held) == 4 and max(held) == held[-1] and held[-1][1] == 0 and sum(b.num_rows for b in found) > 4


def test_one_long_text_is_mined_in_bounded_shards(monkeypatch):
    monkeypatch.setattr(pm, "SHARD", 100_000)
    monkeypatch.setattr(common.slices, "__defaults__", (20_000,))
    rng = random.Random(2)
    half = " ".join(rng.choice("abcdefg") for _ in range(200_000))
    text = (half + " " * 300_000 + half).encode()  # words that are neighbours across several slices of blanks
    found = list(pm.shards([("de", 400_000, b" " * 400_000), ("en", len(text), text)]))
    assert len(found) > 5 and max(s.total for s, _ in found) < 130_000
    total = Counter()
    for shard, _ in found:
        known = list(shard.numbers)
        for columns, n in pm.grow(np.concatenate(shard.runs.get("en", [np.zeros(1, np.int32)])), shard.lead.get("en", 0), len(known), lambda c, _: np.ones(len(c[0]), bool)):
            total.update({tuple(known[c[i]] for c in columns): int(n[i]) for i in range(len(n))})
    w = text.split()
    want = Counter(tuple(w[i:i + size]) for size in range(1, 5) for i in range(len(w) - size + 1))
    assert +total == want


def test_a_shard_is_grown_in_place(monkeypatch):
    monkeypatch.setattr(pm, "TOGETHER", 20_000)
    rng, n = random.Random(3), 2_000_000
    text = " ".join(rng.choices([f"w{i}" for i in range(2_000)], k=n)).encode()
    small, large = (s for t in (text[:1000], text) for s, _ in pm.shards([("en", len(t), t)]))
    held = [small, large]
    monkeypatch.setattr(pm, "shards", lambda _: [(held.pop(0), {"en": len(text)})])
    del small, large
    list(pm.mine(30)([]))  # pyarrow imports what it needs at first use
    tracemalloc.start()
    found = sum(b.num_rows for b in pm.mine(30)([]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 2_000 and peak < 3 * n  # the run has four bytes to a word: no copy of it, and no number beside it


def test_texts_reach_python_in_short_batches_and_the_setting_is_put_back(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    monkeypatch.setattr(pm, "stored", lambda df, name="t", stored=pm.stored: seen.append((name, spark.conf.get(key, None))) or stored(df, name))
    before = spark.conf.get(key, None)
    pm.frequent(awkward(spark, rows(random.Random(1), 20)), 3)
    assert spark.conf.get(key, None) == before
    assert dict(seen)["phrase-local"] == dict(seen)["phrase-counts"] == str(pm.TEXTS)

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["n"])

    with pm.short_batches(spark, 50_000):
        got = spark.range(0, 1000, 1, 1).selectExpr("repeat('x', 1000) AS data").mapInArrow(sizes, "n bigint").collect()
    assert len(got) > 10 and max(r["n"] for r in got) < 100_000


def test_many_distinct_words_end_a_shard(monkeypatch):
    monkeypatch.setattr(common.slices, "__defaults__", (100,))
    w = [f"{'a' if i % 3 else 'b'}{i // 2 if i % 2 else i % 7}" for i in range(3_000)]
    text = " ".join(w).encode()
    whole = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([len(text)]), pa.array([text])], names=["lang", "weight", "data"])
    want = Counter(" ".join(w[i:i + size]) for size in range(1, 5) for i in range(len(w) - size + 1))
    assert len(set(w)) > 1_000 and len(list(pm.shards([("en", len(text), text)]))) == 1
    monkeypatch.setattr(pm, "DISTINCT", 200)
    found = list(pm.shards([("en", len(text), text)]))
    assert len(found) > 4 and max(len(s.numbers) for s, _ in found) < 250
    total = Counter()
    for b in pm.mine(1)([whole]):
        total.update({r["phrase"]: r["n"] for r in b.to_pylist() if r["phrase"]})
    assert total == want


@pytest.mark.parametrize("shard,support", [(150, 7), (2_000, 7), (6_000, 40)])
def test_packed_reports_lose_nothing_whatever_their_size(spark, monkeypatch, shard, support):
    for key, value in {"SHARD": shard, "PACK": 300, "FOLD": 400, "DEAL": 3_000, "BATCH": 100, "TOGETHER": 50}.items():
        monkeypatch.setattr(pm, key, value)
    docs = rows(random.Random(shard), 80)
    found, totals = pm.frequent(awkward(spark, docs), support)
    f, n = counts([(r[2], r[1]) for r in docs])
    want = sorted(((lang, " ".join(p), len(p), c) for lang in f for p, c in f[lang].items() if c >= support), key=repr)
    assert len(want) > 20 and table(found, "lang", "phrase", "size", "f") == want
    assert table(totals) == sorted(((lang, c) for lang, c in n.items() if c), key=repr)


def test_the_first_pass_stores_candidates_only_however_many_the_shards(spark, monkeypatch):
    monkeypatch.setattr(pm, "SHARD", 500)  # more shards than the support: every phrase is frequent in its shard
    held = {}
    monkeypatch.setattr(pm, "stored", lambda df, name="t", stored=pm.stored: held.setdefault(name, stored(df, name)))
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(100)) + " new york city", "en") for i in range(40)]
    found, _ = pm.frequent(awkward(spark, docs), 30)
    assert found.count() == held["phrase-local"].count() == 6


def test_a_shard_with_local_support_1_reports_few_bytes_to_a_phrase():
    rng = random.Random(4)
    w = [f"word{rng.randrange(5_000)}" for _ in range(60_000)]
    text = " ".join(w).encode()
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([10**9]), pa.array([text])], names=["lang", "weight", "data"])
    want = Counter(" ".join(w[i:i + size]) for size in range(1, 5) for i in range(len(w) - size + 1))
    hashes = list(pm.mine(30, pm.as_hashes(30, 8))([batch]))
    assert sum(b.nbytes for b in hashes) < 4 * len(want)
    together = pm.fold_hashes([pm.unpack_hashes(d) for b in hashes for d in b.column("data").to_pylist()])
    assert len(together) == len(want) and int((together & np.uint64((1 << pm.COUNT) - 1)).sum()) == sum(min(c, (1 << pm.COUNT) - 1) for c in want.values())

    class Everything:
        value = np.full(1 << 13, 255, np.uint8)

    texts = [b for b in pm.count(Everything, 16, 8)([batch])]
    assert sum(b.nbytes for b in texts) < 16 * len(want)
    parts = pm.fold_texts([pm.unpack_texts(d) for b in texts for d in b.column("data").to_pylist() if d])
    assert dict(zip(parts["phrase"].to_pylist(), parts["n"].to_pylist())) == want and sum(n for b in texts for n in b.column("n").to_pylist()) == len(w)


@pytest.mark.parametrize("support", [1, 30, (1 << 24) - 1, 1 << 24, 10**12])
def test_counts_of_hashes_reach_any_support(support):
    vocabulary = None, None, np.array([1, 2, 3], np.uint64)
    enough, less, alone = -(-support // 3), support // 5, support
    report = pm.as_hashes(support, 1)
    shards = [b for gains in ([enough, less, 0], [enough, less, 0], [enough, less, alone])
              for b in report("en", vocabulary, [([np.flatnonzero(gains)], np.array(gains, np.int64)[np.flatnonzero(gains)])], 0)]
    found = np.concatenate([b.column("hash").to_numpy() for b in pm.unite(support)(shards)])
    h = pm.phrase_hashes("en", vocabulary[2], [np.array([0, 1, 2])]).astype(np.int64)
    assert set(found) == {h[0], h[2]}
    slack = list(report("en", vocabulary, [([np.array([1])], np.array([less + 1]))], support - less - 1))
    assert pm.unite(support)(slack).__next__().column("hash").to_pylist() == [h[1]]
