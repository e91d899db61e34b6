import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from chaintally.llm import suffix_dedup as sd
from conftest import TESTDATA
from llm_cases import AWKWARD, awkward, table


def brute(docs):
    first, out = {}, []
    rank = lambda i: sd.LAST if i is None else i
    docs = [(i, (t or "").encode()) for i, t in docs]
    for i, b in docs:
        for p in range(len(b) - sd.SPAN + 1):
            g = b[p:p + sd.SPAN]
            first[g] = min(first.get(g, sd.LAST), rank(i))
    for i, b in docs:
        edge = np.zeros(len(b) + 1, int)
        for p in range(len(b) - sd.SPAN + 1):
            if first[b[p:p + sd.SPAN]] < rank(i):
                edge[p] += 1
                edge[p + sd.SPAN] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("trial", range(60))
def test_suffix_array_and_prefixes(trial):
    rnd = random.Random(trial)
    bodies = ["".join(rnd.choice("ab" if trial % 2 else "abc\0") for _ in range(rnd.randint(50, 90))).encode() for _ in range(rnd.randint(1, 12))]
    bodies += bodies[:trial % 3] + [b"x" * 60] * (trial % 4)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    text = np.frombuffer(b"".join(bodies), np.uint8)
    suffixes = sorted((b[i:], s + i) for b, s in zip(bodies, starts.tolist()) for i in range(len(b)))
    order = sd.suffix_array(text, starts)
    assert order.tolist() == [p for _, p in suffixes]
    shared = sd.common_prefixes(text, starts, order)
    for k in range(1, len(order)):
        x, y = suffixes[k - 1][0], suffixes[k][0]
        assert shared[k] == next((j for j, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))


def test_equal_windows_have_equal_keys():
    rnd = np.random.default_rng(1)
    window = rnd.integers(97, 101, sd.SPAN, dtype=np.uint8)
    keys = []
    for _ in range(5):
        text = np.concatenate([rnd.integers(97, 101, 30, dtype=np.uint8), window, rnd.integers(97, 101, 30, dtype=np.uint8)])
        keys.append(sd.window_keys(text, np.array([len(text)]))[0][30])
    assert len(set(map(int, keys))) == 1


def passages():
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcde é\n") for _ in range(300)) for _ in range(5)]
    docs = []
    for i in range(60):
        docs.append((i, "".join(rnd.choice(base)[rnd.randint(0, 100):][:rnd.randint(20, 180)] if rnd.random() < .6 else
                                "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 90))) for _ in range(rnd.randint(0, 5)))))
    docs += [(3, docs[5][1]), (7, docs[7][1]), (None, docs[9][1]), (None, docs[9][1] + "q"), (-1, "x" + docs[11][1]), (102, "a" * 500), (103, "a" * 49),
             (104, "a" * 400), (105, "ab" * 300), (106, "b" + "ab" * 200)]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"block": 300}, {"block": 300, "hot": 5, "shard_bytes": 500}])
def test_equals_brute_force(spark, options):
    frame = spark.createDataFrame(passages(), "doc_id long, text string").repartition(4)
    assert table(sd.deduplicate(frame, **{"shard_bytes": 3000, "fewest": 3, **options})) == brute(passages())


def test_awkward_rows_and_files(spark):
    short = [(i, t and t[:3000], lang) for i, t, lang in AWKWARD]
    assert table(sd.digest(awkward(spark, short))) == [r[:5] for r in brute([r[:2] for r in short])]
    assert table(sd.digest(awkward(spark, []))) == []
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    assert table(sd.digest(docs)) == sorted((r[:5] for r in brute([tuple(r) for r in docs.select("doc_id", "text").collect()])), key=repr)


def test_slices_and_wide_runs(monkeypatch):
    texts = [t.encode() for _, t in passages() if t]
    def windows():
        return sorted((n + int(np.searchsorted(s, a + w, side="right")) - 1, int(a + w - s[np.searchsorted(s, a + w, side="right") - 1]), int(k))
                      for n, _, s, key, at, many in sd.regions(texts) for k, a, m in zip(key, at, many) for w in range(m))
    whole = windows()
    monkeypatch.setattr(sd, "TOGETHER", 700)
    monkeypatch.setattr(sd, "WIDTH", 3)
    assert windows() == whole and len(whole) == sum(max(0, len(t) - sd.SPAN + 1) for t in texts)


def test_copies_fold_before_they_are_dealt(spark):
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary()), ("hash", pa.int64())])
    batches = [pa.RecordBatch.from_pylist([{"doc_id": i, "data": b"copy" * 30, "hash": 7} for i in range(x, x + 500)], schema) for x in (900, 200, 5000)]
    found = [r for batch in sd.pack(4)(iter(batches)) for r in batch.to_pylist()]
    ids, hashes, texts = sd.unpack(found)
    assert ids.tolist() == [900, 200] and len(texts) == 2
    docs = [(i, "the same text for all of these documents " * 3) for i in range(300)] + [(i, "short") for i in range(300, 330)] + [(None, "short")]
    docs += [(-5, "the same text for all of these documents and others"), (0, docs[0][1])]
    random.Random(8).shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert table(sd.deduplicate(frame)) == brute(docs)


@pytest.mark.parametrize("hash_of", [lambda data: sd.F.length(data).cast("bigint"), lambda data: sd.F.lit(5).cast("bigint")])
def test_texts_whose_hashes_collide_stay_apart(spark, monkeypatch, hash_of):
    monkeypatch.setattr(sd, "text_hash", hash_of)
    docs = passages() + [(200, "x" * 80), (201, "y" * 80), (202, "x" * 80), (None, "z" * 80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert table(sd.deduplicate(frame, shard_bytes=3000, fewest=3)) == brute(docs)


def test_keys_of_one_region_need_no_suffix_array(monkeypatch):
    rnd, sizes = random.Random(4), []

    class Seen(sd.Block):
        def __init__(self, bodies, docs):
            sizes.append(sum(map(len, bodies)))
            super().__init__(bodies, docs)

    monkeypatch.setattr(sd, "Block", Seen)
    monkeypatch.setattr(sd, "FILL", 400)
    word = lambda n: bytes(rnd.choice(b"abcd") for _ in range(n))
    bodies, found = {k: [word(rnd.randint(50, 99))] for k in range(40)}, []
    for k in range(20, 40):  # the other keys have one region only, in several documents
        bodies[k] += [word(9) + bodies[k][0][5:], bodies[k][0] + word(7)]
    for k in bodies:
        found += [(k, rnd.choice([rnd.randint(0, 9), sd.LAST]), 1000 * k + n, 3 * n, rnd.choice(bodies[k])) for n in range(6)]
    rnd.shuffle(found)
    head = np.array([r[:4] for r in found], np.int64)
    row = (0, sd.REGIONS, sd.squeeze(head), sd.squeeze(np.array([len(r[4]) for r in found], np.int32)), sd.squeeze(b"".join(r[4] for r in found)), b"7")
    got = set()
    for r in sd.compare(sd.BLOCK)(pa.Table.from_batches([sd.rows([row])])).to_pylist():
        assert (r["dest"], r["kind"]) == (7, sd.REMOVED)
        for text, first, last in zip(*(sd.expand(r[c], np.int64).tolist() for c in "abc")):
            got |= {(text, p) for p in range(first, last - sd.SPAN + 1)}
    first = {}
    for key, doc, _, _, body in found:
        for p in range(len(body) - sd.SPAN + 1):
            e = (key, body[p:p + sd.SPAN])
            first[e] = min(first.get(e, doc), doc)
    assert got == {(text, at + p) for key, doc, text, at, body in found for p in range(len(body) - sd.SPAN + 1) if first[key, body[p:p + sd.SPAN]] < doc}
    assert sum(sizes) <= sum(len(b) for k in range(20, 40) for b in bodies[k]) and max(sizes) <= 400


@pytest.mark.parametrize("least", [2, 30, 50, 60])
def test_prefixes_of_long_suffixes_only(least):
    rnd = random.Random(least)
    bodies = [bytes(rnd.choice(b"ab\xff") for _ in range(rnd.randint(1, 90))) for _ in range(9)] + [b"x" * 80] * 3
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    text = np.frombuffer(b"".join(bodies), np.uint8)
    order = sd.suffix_array(text, starts)
    rest = (np.repeat(starts[1:], np.diff(starts)) - np.arange(len(text)))[order]
    assert np.array_equal(sd.common_prefixes(text, starts, order, least), np.where(rest >= least, sd.common_prefixes(text, starts, order), 0))
