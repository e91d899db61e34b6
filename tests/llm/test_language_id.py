import numpy as np
import pytest

from chaintally.llm import language_id as li, queries
from conftest import TESTDATA
from llm_cases import AWKWARD, awkward, table


@pytest.fixture(scope="module")
def pieces():
    return li.Pieces(queries.vocabulary_path())


@pytest.fixture(scope="module")
def names(pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary_path())
    return {p: k for k, p in enumerate(model.id_to_piece(i) for i in range(model.vocab_size())
                                       if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))}


def enumerate_cuts(word, names, logs):
    total = {0: [[]]}
    if not word:
        return [0.0]
    sums = []
    def walk(i, score):
        if i == len(word):
            sums.append(score)
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in names:
                walk(j, score + logs[names[word[i:j]]])
            elif j == i + 1:
                walk(j, score + li.LOST)
    walk(0, 0.0)
    return sums


def test_forward_sums_all_segmentations(pieces, names):
    rng = np.random.default_rng(1)
    logs = np.log(rng.dirichlet(np.ones(pieces.size), 2)).T
    words = ["▁the", "▁there", "▁Größe", "▁漢\x00x", "▁a", "▁tion"]
    found = li.score_words(pieces, words, logs)
    for w, row in zip(words, found):
        for k in range(2):
            assert np.isclose(row[k], np.logaddexp.reduce(enumerate_cuts(w, names, logs[:, k])))


def test_fitting_raises_the_likelihood(pieces):
    words, counts = ["▁the", "▁there", "▁then", "▁that", "▁tion"], [9, 4, 3, 2, 1]
    at = [float(li.score_words(pieces, words, li.fit(pieces, words, counts, rounds)[:, None])[:, 0] @ counts) for rounds in (0, 1, 2, 5)]
    assert at == sorted(at) and at[0] < at[-1]
    logs = li.fit(pieces, words, counts, 2)
    assert np.isclose(np.exp(logs).sum(), 1)


def test_long_words_do_not_underflow(pieces):
    logs = np.full((pieces.size, 1), -np.log(pieces.size))
    assert np.isfinite(li.score_words(pieces, ["▁" + "ab" * 4000], logs)).all()


def test_held_out_documents(spark):
    root = f"{TESTDATA}/sf0.01"
    rows = queries.op9_language(spark, root).join(spark.read.parquet(f"{root}/documents.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_awkward_rows(spark):
    docs = awkward(spark)
    found = li.predict(docs, queries.vocabulary_path())
    assert found.columns == docs.columns and found.count() == len(AWKWARD)
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found.filter("doc_id IS NOT NULL").collect()}
    assert rows[2] == rows[3] == rows[4] == (li.UNKNOWN, 0.0) and rows[14] == (li.UNKNOWN, 0.0)
    assert {v[0] for v in rows.values()} <= {li.UNKNOWN, "en", "de", "fr", "es", "xx"}
    assert rows[5] == rows[6] == rows[7]


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = awkward(spark, [(1, "some words", None), (2, "more words", None)])
    assert table(li.digest(docs, queries.vocabulary_path()), "lang_pred", "score") == [(li.UNKNOWN, 0.0)] * 2
    assert table(li.digest(awkward(spark, []), queries.vocabulary_path())) == []


def test_held_out_languages_are_not_learned(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    turned = docs.withColumn("lang", li.F.when(li.held_out("doc_id"), "zz").otherwise(li.F.col("lang")))
    path = queries.vocabulary_path()
    assert table(li.digest(docs, path)) == table(li.digest(turned, path))


def test_forgetting_changes_nothing(pieces, monkeypatch):
    logs = np.log(np.random.default_rng(2).dirichlet(np.ones(pieces.size), 2)).T
    texts = [t or "" for _, t, _ in AWKWARD[:6]]
    whole = li.Scorer(pieces, logs).score(texts)
    monkeypatch.setattr(li, "KEPT", 5)
    monkeypatch.setattr(li, "TOGETHER", 5)
    scorer = li.Scorer(pieces, logs)
    assert np.allclose(np.concatenate([scorer.score([t]) for t in texts]), whole)


def test_number_signs_are_no_letters(spark):
    signs = [(i, t, "en") for i, t in enumerate(["½", "²", "①", "Ⅷ", "½ ² ① 12_3 ٣", "½ ª", "漢", "a"], 50)]
    got = {r["doc_id"]: r["lang_pred"] for r in li.digest(awkward(spark, AWKWARD + signs), queries.vocabulary_path()).collect()}
    assert [got[i] == li.UNKNOWN for i in range(50, 58)] == [True] * 5 + [False] * 3


def test_repeated_ids_count_once_in_training(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    one = docs.filter("doc_id = 3")
    many = docs.unionByName(spark.range(50).join(one).drop("id"))
    path = queries.vocabulary_path()
    pieces = li.Pieces(path)
    names, logs = li.train(docs, pieces, most_docs=20)
    again, twice = li.train(many, pieces, most_docs=20)
    assert names == again and np.allclose(logs, twice)
