import sentencepiece

import corpus_pipeline as cp
from chaintally.llm import secret_ledger
from chaintally.llm.queries import vocabulary_path
from chaintally.session import stored
from conftest import TESTDATA
from llm_cases import AWKWARD, awkward, table
from test_contamination import brute as leaks
from test_simhash import brute_components, brute_fingerprint

ROOT = f"{TESTDATA}/sf0.001"


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, ROOT))
        assert docs.columns == list(cp.COLUMNS), name
    last = cp.STAGES[-1][1](spark, docs, ROOT)
    assert table(cp.run(spark, ROOT)) == table(last) and last.count() > 100


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    rows = docs.orderBy("doc_id").select("doc_id", "text").collect()
    label = brute_components([brute_fingerprint(r["text"]) for r in rows])
    want = sorted({int(rows[k]["doc_id"]) for k in label.tolist()})
    assert sorted(r["doc_id"] for r in cp.near_duplicates(spark, docs, ROOT).collect()) == want


def test_decontamination_and_secrets_equal_brute_force(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").select("item_id", "text").collect()]
    clean = cp.decontamination(spark, docs, ROOT)
    want = sorted(r["doc_id"] for r in docs.collect() if not leaks(r["text"], bench)[-1])
    assert sorted(r["doc_id"] for r in clean.collect()) == want
    find, names = secret_ledger.scanner(secret_ledger.RULES), {r.name for r in secret_ledger.RULES}
    masked = {r["doc_id"]: r for r in cp.secrets(spark, docs, ROOT).collect()}
    for r in docs.collect():
        new = masked[r["doc_id"]]
        assert new["n_chars"] == len(new["text"]) and (new["text"] == r["text"]) == (not find(r["text"], names))
        assert not find(new["text"], names)


def test_tokens_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path())
    for r in cp.tokens(spark, awkward(spark), ROOT).join(awkward(spark).select("doc_id", "text").distinct(), "doc_id").collect():
        assert r["ids"] == library.encode(r["text"] or "") and r["n_tokens"] == len(r["ids"])


def test_every_stage_bears_awkward_rows_and_empty_tables(spark):
    for name, stage in cp.STAGES:
        assert stage(spark, awkward(spark), ROOT).count() <= len(AWKWARD), name
        assert stage(spark, awkward(spark, []), ROOT).count() == 0, name
