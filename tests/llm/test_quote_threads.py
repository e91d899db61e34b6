from chaintally.llm import quote_threads as qt
from conftest import TESTDATA
from llm_cases import by_name, duck, table

SCHEMA = "conv_id long, turn long, role string, text string, body long, depth string, thread string"


def messages(spark, rows):
    return spark.createDataFrame([r + (None, None, None) for r in rows], SCHEMA).repartition(3)


def test_query_equals_sql(spark):
    frame = spark.read.parquet(f"{TESTDATA}/sf0.01/conversations.parquet")
    assert by_name(qt.digest(frame)) == duck(qt.SQL, conversations=frame)


def test_nested_quotes(spark):
    rows = [(1, 0, "a", "Hello there.\nHow are you?"), (1, 1, "b", "> how  are YOU?\nFine."), (1, 2, "c", ">> Hello there.\n> Fine.\nGood."),
            (1, 3, "a", " > Hello there.\nSecond branch."), (1, 4, "b", "> Unknown words.\n>\n> \nNothing linked."),
            (1, 5, "b", "> Good.\n> Hello there.\n> Fine.\nLate."), (2, 0, "a", "> Hello there.\nOther conversation.")]
    found = {(r["conv_id"], r["turn"]): r for r in qt.conversations(messages(spark, rows)).collect()}
    assert {k: (r["reply_to"], r["thread"], r["depth"], r["n_quoted"], r["n_linked"]) for k, r in found.items()} == {
        (1, 0): (None, 0, 0, 0, 0), (1, 1): (0, 0, 1, 1, 1), (1, 2): (1, 0, 2, 1, 1), (1, 3): (0, 0, 1, 1, 1), (1, 4): (None, 4, 0, 1, 0),
        (1, 5): (2, 0, 3, 3, 3), (2, 0): (None, 0, 0, 1, 0)}
    assert found[1, 2]["body"] == "Good." and found[1, 4]["body"] == "Nothing linked."


def test_every_level_is_linked_and_counted(spark):
    rows = [(1, 0, "a", "Hello there.\nHow are you?"), (1, 1, "b", "Fine."), (1, 2, "c", "> Fine.\n>> Hello there.\n>> Lost words.\n>>> How are you?\nGood."),
            (1, 3, "a", ">> Hello there.\nDeeper quotes only."), (1, 4, "b", "> Trimmed.\n>>> Hello there.\n>>> How are you?\n>> Good.\nLevel two is nearer."),
            (1, 5, "b", "> Hello there.\n>> Hello there.\nHello there."), (2, 2, "a", ">> Hello there.\nOther conversation.")]
    found = {(r["conv_id"], r["turn"]): r for r in qt.conversations(messages(spark, rows)).collect()}
    assert {k: (r["reply_to"], r["depth"], r["n_quoted"], r["n_linked"], r["n_nested"], r["n_nested_linked"]) for k, r in found.items()} == {
        (1, 0): (None, 0, 0, 0, 0, 0), (1, 1): (None, 0, 0, 0, 0, 0), (1, 2): (1, 1, 1, 1, 3, 2), (1, 3): (0, 1, 0, 0, 1, 1), (1, 4): (2, 2, 1, 0, 3, 3),
        (1, 5): (0, 1, 1, 1, 1, 1), (2, 2): (None, 0, 0, 0, 1, 0)}


def test_deep_threads_and_block_borders(spark):
    n = 3 * qt.BLOCK // 2
    rows = [(1, t, "a", (f"> line {t - 1}\n" if t else "") + f"line {t}") for t in range(0, n, 97)]
    rows = [(c, t, r, x.replace(f"line {t - 1}", f"line {t - 97}")) for c, t, r, x in rows]
    found = table(qt.conversations(messages(spark, rows)), "turn", "thread", "depth")
    assert found == sorted(((t, 0, k) for k, t in enumerate(range(0, n, 97))), key=repr)


def test_awkward_rows(spark):
    rows = [(None, 0, "a", "> x"), (1, None, "a", "x"), (1, 0, None, None), (1, 1, "a", ""), (1, 2, "a", "x"), (1, 2, "a", "x"), (1, 3, "b", "> x\ny"),
            (1, 3, "b", "> x\ny"), (1, 4, "b", "> y\n" + "z " * 50_000), (1, 5, "b", ">>>\n>\n\n")]
    result = qt.conversations(messages(spark, rows))
    assert result.count() == len(rows) and set(result.columns) >= {"body", "reply_to", "thread", "depth"}
    assert len(result.columns) == len(set(result.columns))
    found = {(r["conv_id"], r["turn"]): (r["reply_to"], r["thread"], r["depth"]) for r in result.collect()}
    assert found == {(None, 0): (None, 0, 0), (1, None): (None, None, 0), (1, 0): (None, 0, 0), (1, 1): (None, 1, 0), (1, 2): (None, 2, 0),
                     (1, 3): (2, 2, 1), (1, 4): (3, 2, 2), (1, 5): (None, 5, 0)}
    assert qt.conversations(messages(spark, [])).count() == 0 and qt.digest(messages(spark, [])).count() == 0


def test_no_python_on_the_path(spark):
    plan = qt.digest(spark.read.parquet(f"{TESTDATA}/sf0.001/conversations.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
