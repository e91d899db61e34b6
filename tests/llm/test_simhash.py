import re

import numpy as np
import pytest
import xxhash

from chaintally.llm import simhash
from chaintally.llm.components import components
from conftest import TESTDATA
from llm_cases import AWKWARD, awkward, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points):
    """Smallest index of each point's component."""
    points, label = np.array(points, np.uint64), np.arange(len(points))
    near = np.bitwise_count(points[:, None] ^ points[None]) <= 3
    while True:
        new = np.array([label[near[i]].min() for i in range(len(points))])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("source", ["awkward", "files"])
def test_digest_equals_brute_force(spark, source):
    docs = awkward(spark) if source == "awkward" else spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r["text"]) for r in rows]
    label = brute_components(prints)
    least = {k: min((rows[i]["doc_id"] for i in np.flatnonzero(label == k) if rows[i]["doc_id"] is not None), default=None) for k in set(label)}
    want = [(r["doc_id"], f"{p:016x}", least[k]) for r, p, k in zip(rows, prints, label)]
    assert table(simhash.digest(docs)) == sorted(want, key=repr)


def test_slices_of_a_long_text(monkeypatch):
    text = AWKWARD[6][1]
    monkeypatch.setattr(simhash, "TOGETHER", 1000)
    assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == brute_fingerprint(text)


def planted(n=3000, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n // 30, dtype=np.uint64)
    points = base[rng.integers(0, len(base), n)]
    for _ in range(4):  # up to four bits apart from the base
        points = points ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(points)


@pytest.mark.parametrize("most", [simhash.MOST, 16, 3])
def test_links_connect_what_brute_force_connects(spark, most):
    points = planted(600 if most < simhash.MOST else 3000)
    frame = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    root = np.arange(len(points))
    at = {int(p): i for i, p in enumerate(points.view(np.int64))}
    pairs = simhash.links(frame, most).collect()
    a, b = (np.array([at[r[c]] for r in pairs]) for c in "ab")
    assert (np.bitwise_count(points[a] ^ points[b]) <= 64).all()
    simhash.merge_roots(root, a, b)
    assert root.tolist() == brute_components(points).tolist()


def test_grids_cover_every_three_bits():
    masks = [m & (1 << 64) - 1 for m in simhash.grids()]
    assert len(masks) == 20
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    ex, ey = simhash.embed(x), simhash.embed(y)
    assert (np.bitwise_count(ex ^ ey) <= np.bitwise_count(x ^ y)).all()
    assert np.any([(ex ^ ey) & np.uint64(m) == 0 for m in masks], axis=0).all()


def test_embedding_in_spark_equals_numpy(spark):
    points = planted(90).view(np.int64)
    got = spark.createDataFrame([(int(p),) for p in points], "fp long").select(simhash.embedding(simhash.F.col("fp"))).collect()
    assert [r[0] for r in got] == simhash.embed(points.view(np.uint64)).view(np.int64).tolist()


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 180)}, **{i: 200 for i in range(201, 209)}}


def test_one_of_each_group_stays(spark):
    docs = awkward(spark)
    kept = simhash.keep_one(docs)
    found = simhash.digest(docs)
    assert kept.columns == docs.columns
    groups = {r["component_id"] for r in found.collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=repr) == sorted(groups, key=repr) and len(ids) == len(set(ids))
    assert simhash.keep_one(awkward(spark, [])).count() == 0 and table(simhash.digest(awkward(spark, []))) == []


def test_rows_without_numbers_keep_one(spark):
    docs = awkward(spark, [(None, "the same words again", "en")] * 3 + [(None, "quite another text here", "en")])
    assert sorted(r["text"] for r in simhash.keep_one(docs).collect()) == ["quite another text here", "the same words again"]
