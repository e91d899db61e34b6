import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from chaintally.llm import line_ledger as ll
from conftest import TESTDATA
from llm_cases import AWKWARD, LONG, awkward, by_name, duck, table

BLANK = " \t\n\x0b\f\r"
UPPER = {c: c + 32 for c in range(65, 91)}
MANY = [(100 + i, f"{'  ' * i}Shared Line{chr(9) * (i % 3)}\n\n own {i}\nÉ\nshared line\n{'x' * i}", "en") for i in range(10)]


def brute(rows, least=10):
    """doc_id, n_lines, n_dropped, kept_sha256 of (doc_id, text)."""
    keys = [[x.strip(BLANK).translate(UPPER) for x in (text or "").split("\n")] for _, text in rows]
    often = {k for k, n in Counter(k for row in keys for k in set(row)).items() if k and n >= least}
    out = []
    for (doc, text), row in zip(rows, keys):
        kept = [x for x, k in zip((text or "").split("\n"), row) if k not in often]
        out.append((doc, len(row), len(row) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_digest_equals_brute_force(spark):
    rows = AWKWARD + MANY + [(7, LONG, "en")] * 6
    assert table(ll.digest(awkward(spark, rows))) == brute([r[:2] for r in rows])
    assert table(ll.digest(awkward(spark, []))) == []


def test_query_equals_sql_and_brute_force(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    got = ll.digest(docs)
    assert table(got) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert by_name(got) == duck(ll.SQL, documents=docs) and got.filter("n_dropped > 0").count() > 100


def test_sql_bears_awkward_rows(spark):
    rows = [r for r in AWKWARD + MANY if "\x00" not in (r[1] or "")]
    docs = awkward(spark, rows)
    assert by_name(ll.digest(docs)) == duck(ll.SQL, documents=docs.select("doc_id", "text"))


def state(ledger):
    return table(ledger.counts()), table(ledger.frequent())


def test_insertions_and_deletions_are_reversible(spark):
    """On a whole table: parts come and go, and every state is that of a ledger built afresh."""
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").select("doc_id", "text")
    parts = [docs.filter(f"crc32(cast(doc_id AS string)) % 3 = {i}") for i in range(3)]
    first = parts[0].unionByName(parts[1])
    ledger = ll.new_ledger(spark).insert(parts[0]).insert(parts[1])
    fresh = ll.new_ledger(spark).insert(first)
    at_two = state(ledger)
    assert at_two == state(fresh)
    ledger.insert(parts[2])
    assert state(ledger) == state(ll.new_ledger(spark).insert(docs))
    assert table(ledger.clean(docs).select("doc_id", "n_dropped")) == [
        (r[0], r[2]) for r in brute([tuple(r) for r in docs.collect()])]
    ledger.delete(parts[2])
    assert state(ledger) == at_two
    assert table(ledger.clean(first)) == table(fresh.clean(first))
    # the filters still hold every frequent key, and next to nothing else
    n, segments = ledger.batches()[0]["shards"], {r["shard"]: ll.load(r["segments"]) for r in ledger.filters().collect()}
    often = set(at_two[1])
    for k1, k2, _ in at_two[0]:
        inside = ll.holds(segments[k1 & n - 1], [k1], [k2])[0] if k1 & n - 1 in segments else False
        assert inside or (k1, k2) not in often
    assert sum(int((s != 0).sum()) for s in segments.values()) == len(often)
    with pytest.raises(ValueError):
        ledger.delete(parts[2])
    assert state(ledger) == at_two
    again = ll.LineLedger(spark, ledger.path)  # a later session goes on where this one stopped
    assert state(again) == at_two
    with pytest.raises(ValueError):
        ll.LineLedger(spark, ledger.path, least=3)


def test_text_comes_back_with_all_columns(spark):
    docs = awkward(spark, MANY).withColumnRenamed("spans", "n_lines").withColumnRenamed("hit", "n_dropped")
    rows = {r["doc_id"]: r for r in ll.new_ledger(spark).insert(docs).clean(docs).collect()}
    assert rows[103]["text"] == "\n own 3\nxxx" and rows[103]["n_dropped"] == 3 and rows[103]["source"] == "src"
    assert sorted(next(iter(rows.values())).asDict()) == sorted(docs.columns)


def test_filter_of_several_segments():
    rng = np.random.default_rng(3)
    keys = rng.integers(-2**62, 2**62, (40_000, 2))
    segments = ll.load(b"")
    where = list(zip(*(x.tolist() for x in ll.places(keys[:, 0], keys[:, 1]))))
    for w in where:
        segments = ll.put(segments, *w)
    assert 3 <= len(segments) <= 4 and ll.holds(segments, keys[:, 0], keys[:, 1]).all()
    strange = rng.integers(-2**62, 2**62, (20_000, 2))
    assert ll.holds(segments, strange[:, 0], strange[:, 1]).mean() < 0.01
    order = list(range(len(keys)))
    random.Random(1).shuffle(order)
    for i in order[:30_000]:
        ll.take(segments, *where[i])
    left = keys[sorted(order[30_000:])]
    assert ll.holds(segments, left[:, 0], left[:, 1]).all() and int((segments != 0).sum()) == 10_000


def test_a_hot_shard_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(ll, "ROWS", 20)
    docs = awkward(spark, [(i, f"everywhere\n{i}\nmore of {i % 7}", "en") for i in range(300)])
    assert table(ll.digest(docs)) == brute([(i, f"everywhere\n{i}\nmore of {i % 7}") for i in range(300)])
