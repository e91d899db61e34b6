import hashlib
import re

import pytest

from chaintally.llm import contamination as co
from conftest import TESTDATA
from llm_cases import AWKWARD, PASSAGE, awkward, by_name, duck, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [(1, PASSAGE), (2, PASSAGE), (3, "plain words"), (4, "ROW"), (5, ""), (6, None), (None, "größe the"), (7, "no such words anywhere at all in the corpus here"), (10, "漢字")]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    mine, hit, found = words(text), set(), set()
    for item, other in items:
        w = words(other)
        n = min(10, len(w))
        windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(mine) - n + 1):
            if tuple(mine[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add("" if item is None else str(item))
    return len(mine), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("most", [co.MOST_WINDOWS, 2])
def test_scan_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(co, "BLOCK", 3 if most == 2 else 10_000)
    docs = awkward(spark)
    found = co.scan(docs, items(spark), most_windows=most).select("doc_id", "n_words", "n_hit", co.F.size("items").alias("n"),
                                                                 co.F.sha2(co.F.concat_ws(",", "items"), 256).alias("h"), "contaminated")
    assert table(found) == sorted(((d, *brute(t, ITEMS)) for d, t, _ in AWKWARD), key=repr)


def test_query_equals_sql(spark):
    docs, bench = (spark.read.parquet(f"{TESTDATA}/sf0.001/{n}.parquet") for n in ("documents", "benchmark"))
    assert by_name(co.digest(docs, bench)) == duck(co.SQL, documents=docs, benchmark=bench)


def test_slices_of_a_long_text(monkeypatch):
    text = AWKWARD[6][1].encode()
    whole = [w for part in co.words_of(text) for w in part]
    monkeypatch.setattr(co.common.slices, "__defaults__", (100,))
    assert [w for part in co.words_of(text) for w in part] == whole


def test_removal(spark):
    docs, bench = awkward(spark), items(spark, [(1, PASSAGE)])
    kept = co.remove_documents(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(AWKWARD) - 2
    cut = {r["doc_id"]: r["text"] for r in co.remove_spans(docs, bench).collect()}
    assert cut[8] == " and more" and cut[9] == "Say: !" and cut[2] is None and cut[1] == AWKWARD[0][1]
    assert co.remove_spans(docs, bench).columns == docs.columns


def test_empty_tables(spark):
    assert table(co.digest(awkward(spark, []), items(spark))) == []
    assert {r[2] for r in table(co.digest(awkward(spark), items(spark, [])))} == {0}
