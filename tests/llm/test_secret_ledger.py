import dataclasses
import time
import hashlib
import re

from chaintally.llm import secret_ledger as sl
from conftest import TESTDATA
from llm_cases import AWKWARD, awkward, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    return (*[sum(s[3] == k for s in spans) for k in sl.BASE], hashlib.sha256(base.encode()).hexdigest())


def test_digest_equals_brute_force(spark):
    for docs in (awkward(spark), spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = table(sl.digest(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
        assert got == sorted(((d, *brute(t)) for d, t in rows), key=repr)
    assert table(sl.digest(awkward(spark, []))) == []


def test_letters_match_in_ascii_only():
    find = sl.scanner(sl.RULES)
    names = {r.name for r in sl.RULES}
    assert find("\u017fecret=abcdefgh to\u212aen=abcdefgh", names) == []
    assert [s["kind"] for s in find("sEcReT = 'abcdefgh'", names)] == ["assign"]


def test_only_unseen_blobs_and_rules_are_scanned(spark, tmp_path):
    path, schema = str(tmp_path / "ledger"), "doc_id long, text string"
    first = spark.createDataFrame([(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "clean")], schema)
    assert sl.update(first, path).count() == 2
    more = spark.createDataFrame([(4, "token=abcdefgh"), (5, "clean"), (6, "secret: 12345678")], schema)
    assert sl.update(more, path).count() == 3
    assert sl.update(more, path).count() == 3
    raised = tuple(dataclasses.replace(r, version=2, least=9) if r.kind == "assign" else r for r in sl.RULES)
    ledger = sl.update(more, path, raised)
    assert sorted(map(tuple, (r["rules"] for r in ledger.collect() if r["rules"] == ["assign@2"]))) == [("assign@2",)] * 3
    assert table(sl.findings(first.union(more), ledger).selectExpr("doc_id", "size(spans)")) == [(1, 1), (2, 1), (3, 0), (4, 1), (5, 0), (6, 1)]
    assert {r[1] for r in table(sl.findings(more, ledger, raised).selectExpr("doc_id", "size(spans)"))} == {0}


def test_redaction(spark):
    docs = awkward(spark)
    clean = sl.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(AWKWARD)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[11] == f'{sl.MASK}" {sl.MASK}' and texts[2] is None and texts[3] == "" and texts[1] == AWKWARD[0][1]
    assert all(brute(t)[:3] == (0, 0, 0) for t in texts.values())


def test_a_long_run_without_a_blank_is_read_once():
    """A million characters under all rules; a run that a rule enters in vain is not entered again."""
    find, names = sl.scanner(sl.RULES), {r.name for r in sl.RULES}
    token = "eyJ" + "a" * 20 + "." + "b" * 20 + "." + "c" * 20
    for text, want in (("eyJ" * 333_333, 0), (f"{'eyJ' + 'a' * 20}." * 40_000, 13_333), ("token" * 200_000, 0), ("secret" + " " * 990_000, 0),
                       ("-----BEGIN " * 90_000, 0), ("eyJ" * 300_000 + " " + token, 1)):
        began = time.perf_counter()
        assert len(find(text, names)) == want and time.perf_counter() - began < 5
    assert [s["kind"] for s in find(f"x {token};{token}", names)] == ["jwt", "jwt"]


def test_the_ledger_grows_by_unseen_blobs_of_a_whole_table(spark, tmp_path):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").select("doc_id", "text")
    path = str(tmp_path / "ledger")
    half = docs.filter("crc32(cast(doc_id AS string)) % 2 = 0")
    first = sl.digest(half, path).count()
    seen = sl.read_ledger(spark, path).count()
    whole = table(sl.digest(docs, path))
    assert first == half.count() and whole == table(sl.digest(docs))
    ledger = sl.read_ledger(spark, path)
    assert seen < ledger.count() == ledger.select("blob").distinct().count() == docs.select("text").distinct().count()
    sl.digest(docs, path)
    assert sl.read_ledger(spark, path).count() == ledger.count()
