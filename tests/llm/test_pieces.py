import hashlib
import random
import time

import numpy as np
import pytest
import sentencepiece

from chaintally.llm import pieces
from chaintally.llm.queries import vocabulary_path
from conftest import TESTDATA
from llm_cases import AWKWARD, awkward, table


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path())


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(vocabulary_path())


def same(vocabulary, library, texts):
    encoder = pieces.Encoder(vocabulary)
    for text, words in zip(texts, encoder.encode(texts)):
        want = library.encode(text)
        ids, n, data = pieces.joined(words)
        assert [int(i) for i in ids.split(b",") if i] == want == np.frombuffer(b"".join([w[3] for w in words]), np.int32).tolist(), text[:80]
        assert n == len(want) and data.decode() == library.decode(want) == pieces.decode(vocabulary, want)


def test_equals_the_library(vocabulary, library):
    runs = [c * n + end for c in (" ", "-", "=", "a", "ha", "0", "\n", "▁") for n in range(0, 70, 3) for end in ("", "x")]
    same(vocabulary, library, runs + [t or "" for _, t, _ in AWKWARD] + ["a" * 5000, "abab" * 999, " " * 3000 + "q"])


def test_equals_the_library_on_random_texts(vocabulary, library):
    rnd = random.Random(5)
    sets = ["abc", "ab ", "aehinorst ", "  \n▁a", "-=_*#", "0123456789.", "éèüß漢🙂", "(){};=\n\t ", "haHA!? ", "\x00\x7f́ a"]
    same(vocabulary, library, ["".join(rnd.choice(s) for _ in range(rnd.randint(0, 120))) for s in sets for _ in range(150)])


def test_long_words_equal_the_library(vocabulary, library):
    """Words that are kept in buckets: random, repetitive, in scripts without blanks, and one of a million characters."""
    rnd = random.Random(9)
    sets = ["abcdefghijklmnopqrstuvwxyz", "aab", "etaoin", "ABCDabcd0123+/", "漢字の世界éü", "ha", "=-", "🙂x", "0123456789abcdef"]
    texts = ["".join(rnd.choice(s) for _ in range(n)) for s in sets for n in (1024, 1025, 1500, 20_000)]
    texts += ["x " + "a" * 4000 + "\n▁" + "ab" * 3000, " " * 20_000 + "b" * 2000, "the" * 5000 + "—" * 3000]
    same(vocabulary, library, texts)
    began = time.perf_counter()
    same(vocabulary, library, ["".join(rnd.choice(sets[0]) for _ in range(1_000_000))])
    assert time.perf_counter() - began < 60


def test_short_words_in_buckets_too(vocabulary, library, monkeypatch):
    monkeypatch.setattr(pieces, "LONG", 1)
    rnd = random.Random(6)
    same(vocabulary, library, ["".join(rnd.choice("aehinorst ") for _ in range(rnd.randint(0, 90))) for _ in range(300)]
         + [t or "" for _, t, _ in AWKWARD if len(t or "") < 2000])


def test_forgetting_changes_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 50)
    monkeypatch.setattr(pieces, "TOGETHER", 30)
    same(vocabulary, library, [t or "" for _, t, _ in AWKWARD[:8]])


def test_queries(spark, library):
    for docs in (awkward(spark), spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")):
        want = []
        for r in docs.collect():
            ids = library.encode(r["text"] or "")
            want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
        assert table(pieces.digest(docs, vocabulary_path())) == sorted(want, key=repr)
    docs = awkward(spark)
    encoded = pieces.encode(docs, vocabulary_path())
    assert encoded.columns == docs.columns
    back = pieces.decode_ids(encoded, vocabulary_path()).select("text", "decoded").collect()
    assert len(back) == len(AWKWARD) and all((r["text"] or "").replace("▁", " ") == r["decoded"] for r in back)


def test_empty_table(spark):
    assert table(pieces.digest(awkward(spark, []), vocabulary_path())) == []
    assert pieces.encode(awkward(spark, []), vocabulary_path()).count() == 0


def test_pair_table():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000))
    found = pieces.PairTable(keys[::2], np.arange(len(keys[::2]), dtype=np.int32))(keys)
    assert found[::2].tolist() == list(range(len(keys[::2]))) and set(found[1::2].tolist()) == {-1}
