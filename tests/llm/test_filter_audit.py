import itertools
import re

from chaintally.llm import filter_audit as fa
from chaintally.session import stored
from conftest import TESTDATA
from llm_cases import AWKWARD, LONG, awkward, by_name, duck, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = [(1, 1, 0), (5, 1, 1), (6, 0, 1), (7, 1, 0), (7, 0, None), (12, None, 1), (None, 1, 1), (99, 1, 1)]


def marked(spark, rows=LABELS):
    return spark.createDataFrame([r + ("clash",) for r in rows], "doc_id long, quality int, toxic int, mask string")


def brute(docs, labels):
    """docs: (doc_id, text, lang); every order is applied to the documents one filter after the other."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))

    def fails(d, text):
        text, words = text or "", WORD.findall(text or "")
        return {c for c, hit in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            bool(re.search(r"[#$%&*|]", text)), d is not None and least[text] < d)) if hit}

    failed = [(lang or "", d in good, d in toxic, fails(d, text)) for d, text, lang in docs]
    rows, sums = [], {}
    for part in {f[0] for f in failed}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [f for f in failed if f[0] == part]
            for step, c in enumerate(order, 1):
                gone = [f for f in left if c in f[3]]
                stays = [f for f in left if c not in f[3]]
                late = [f for f in failed if f[0] == part and c in f[3]]
                sums[part, c] = sums.get((part, c), 0) + len(gone)
                rows.append((part, order, step, len(stays), len(gone), len(late) - len(gone), sum(f[3] == {c} for f in late),
                             sum(f[1] for f in gone), sum(f[2] for f in gone)))
                left = stays
    return sorted((*r, sums[r[0], r[1][r[2] - 1]]) for r in rows)


def test_every_order_equals_brute_force(spark):
    # ids that are NULL, repeated and equal for different texts; a text whose copies have several languages and flags
    rows = AWKWARD + [(40, LONG, None), (41, None, "en"), (None, "", "en"), (42, "A a " * 150, ""), (43, "A $ " * 150, "")]
    got = fa.digest(awkward(spark, rows), marked(spark))
    assert sorted(map(tuple, got.collect())) == brute(rows, LABELS)
    assert table(fa.digest(awkward(spark, []), marked(spark))) == []
    bare = fa.digest(awkward(spark, rows), marked(spark, []))
    assert sorted(map(tuple, bare.collect())) == brute(rows, [])


def test_query_equals_sql_and_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{TESTDATA}/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    got = fa.digest(docs, labels)
    assert by_name(got) == duck(fa.SQL, documents=docs, labels=labels)
    want = brute([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert sorted(map(tuple, got.collect())) == want


def test_sql_bears_awkward_rows(spark):
    docs, labels = awkward(spark), marked(spark)
    assert by_name(fa.digest(docs, labels)) == duck(fa.SQL, documents=docs.select("doc_id", "text", "lang"), labels=labels)


def test_recursion_sees_masks_only(spark):
    # a thousand parts: the recursion stays as small as for one
    found = spark.range(3000).selectExpr("concat('p', id % 1000) AS part", "CAST(id * 7 % 32 AS INT) AS mask", "id + 1 AS n", "0L AS good", "0L AS toxic")
    found = stored(found.groupBy("part", "mask").agg(*[fa.F.sum(c).alias(c) for c in ("n", "good", "toxic")]))
    assert fa.steps(found).count() == 32 * 325
    rows = fa.audit(found)
    assert rows.count() == 600_000
    # every order removes the same documents in the end
    assert rows.filter("step = 5").groupBy("part").agg(fa.F.countDistinct("kept").alias("k")).filter("k <> 1").count() == 0
