import pytest

from chaintally.llm import fixity
from conftest import TESTDATA
from llm_cases import by_name, duck, table

PAGES = "page_id long, url string, html string, file int, digest string"


def pages(spark, n=3000):
    rows = [(i, f"http://a/{i}", "<p>é</p>" * (i % 50), 0, "") for i in range(n)]
    return spark.createDataFrame(rows + [(None, None, None, 0, ""), (None, "u", "", 0, ""), (5, "twin", "x", 0, ""), (5, "twin", "x", 0, ""), (7, "t", None, 0, "")], PAGES)


def test_query_equals_sql(spark):
    frame = spark.read.parquet(f"{TESTDATA}/sf0.01/pages.parquet")
    assert by_name(fixity.digest(frame)) == duck(fixity.SQL, pages=frame)


def test_awkward_pages_equal_sql(spark):
    assert by_name(fixity.digest(pages(spark))) == duck(fixity.SQL, pages=pages(spark))


def test_equal_replicas_and_empty_tables(spark):
    found = fixity.records(pages(spark, 50))
    assert fixity.audit(found, found).count() == 0
    assert fixity.audit(fixity.records(pages(spark, 0).limit(0)), fixity.records(pages(spark, 0).limit(0))).count() == 0


def test_whole_file_missing_or_extra(spark):
    one = fixity.records(pages(spark, 2500))
    two = one.filter("file <> 1")
    assert {r["status"] for r in fixity.audit(one, two).collect()} == {"missing"}
    assert fixity.audit(one, two).count() == one.filter("file = 1").count()
    assert {r["status"] for r in fixity.audit(two, one).collect()} == {"extra"}


@pytest.mark.parametrize("page", [0, 1234, 2999])
def test_only_branches_above_damage_are_descended(spark, page):
    one = fixity.records(pages(spark))
    two = one.withColumn("digest", fixity.F.when((fixity.F.col("page_id") == page) & (fixity.F.col("copy") == 1), "rotten").otherwise(fixity.F.col("digest")))
    levels = fixity.depth(one, two)
    ranges = fixity.differing_ranges(fixity.tree(one, levels), fixity.tree(two, levels))
    offset = one.filter((fixity.F.col("page_id") == page) & (fixity.F.col("copy") == 1)).first()
    assert table(ranges) == [(offset["file"], offset["offset"] >> fixity.RANGE)]
    assert [(r["page_id"], r["status"]) for r in fixity.audit(one, two).collect()] == [(page, "altered")]
