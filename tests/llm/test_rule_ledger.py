import re
from collections import Counter

from chaintally.llm import rule_ledger as rl
from conftest import TESTDATA
from llm_cases import AWKWARD, LONG, awkward, by_name, duck, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPAM = [(20, "buy now cheap " * 40, "en"), (21, "a b c x a b c", "en"), (22, "a b\nc\ta b\x0bc d", "en"), (23, "l1\nl2\nl1\n\n\nl1 \nl1", "en"), (24, "a a a a", "en")]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {p for i, w in enumerate(windows) if times[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_counts_equal_brute_force(spark):
    for docs in (awkward(spark, AWKWARD + SPAM), spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")):
        want = sorted(((r["doc_id"], *brute(r["text"])) for r in docs.select("doc_id", "text").collect()), key=repr)
        got = rl.digest(docs)
        assert table(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
        assert got.filter("kept AND base_failed").count() == 0
    assert table(rl.digest(awkward(spark, []))) == []


def test_query_equals_sql(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    assert by_name(rl.digest(docs)) == duck(rl.SQL, documents=docs)


def test_equal_hashes_are_compared_as_text(spark, monkeypatch):
    # all windows get the same hash: only the comparison of words is left to tell them apart
    monkeypatch.setattr(rl.F, "xxhash64", lambda *columns: rl.F.coalesce(*[c * 0 for c in [rl.F.lit(0).cast("bigint")]], rl.F.length(columns[0]).cast("bigint")))
    docs = awkward(spark, SPAM + [(30, "q w e r t y u i q w e", "en")])
    got = {r["doc_id"]: r["n_repeat_words"] for r in rl.measure(docs).collect()}
    assert got == {r[0]: brute(r[1])[4] for r in SPAM + [(30, "q w e r t y u i q w e")]}


def test_policies_and_ablation(spark):
    found = rl.ledger(awkward(spark, AWKWARD + SPAM))
    bits = [r["fail_bits"] for r in found.collect()]
    for policy, mask in rl.POLICIES.items():
        assert rl.judge(found, policy).filter("kept").count() == sum(b & mask == 0 for b in bits)
    rows = {(r["policy"], r["rule"]): (r["n_fail"], r["n_only"]) for r in rl.ablation(found).collect()}
    assert rows == {(p, r.name): (sum(b >> i & 1 for b in bits), sum(b & m == 1 << i for b in bits))
                    for p, m in rl.POLICIES.items() for i, r in enumerate(rl.RULES) if m >> i & 1}


def test_long_text_and_plan(spark):
    docs = awkward(spark, [(1, LONG * 5, "en")])
    assert table(rl.digest(docs), "n_words", "n_repeat_words") == [(brute(LONG * 5)[0], brute(LONG * 5)[4])]
    plan = rl.measure(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange hash"))
