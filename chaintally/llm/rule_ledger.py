"""Quality rules as a ledger of bitmasks, in built-in functions only.

One pass measures every document and evaluates every rule once. The ledger keeps, per document,
the measurements and one failure bit per rule. A policy is a version with a mask of the rules it
enforces: applying it, comparing policies, and asking what each rule alone removes are bitwise
operations on the ledger, without reading a text again.

Words are `[^\\x20\\x09-\\x0D]+`. Repeated three-word windows are found inside the row: a sorted
array of (hash, position) numbers gives the candidates, which are then compared as text.

Defined results: NULL and empty texts have no words, all counts 0, and fail the first rule;
repeated rows and NULL ids are rows like any other; an empty table gives an empty ledger;
other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from chaintally.session import stored

BLANK = " \t\n\x0b\f\r"
BLANKS = r"[\x20\x09-\x0D]+"


def _let(value, body):
    """``body`` of a value that is computed once, whatever the optimiser does with columns."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text):
    bare = F.btrim(text, F.lit(BLANK))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANKS))


def _positions(n):
    """0 … n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _twins(items, same):
    """The elements of a sorted array that are like the one before or behind them."""
    return F.filter(items, lambda x, i: F.coalesce(same(x, F.get(items, i - 1)), F.lit(False))
                    | F.coalesce(same(x, F.get(items, i + 1)), F.lit(False)))


def _repeated_words(words):
    """Words inside three-word windows that occur more than once."""
    n = F.size(words) - 2
    bits = F.ceil(F.log2(n + 1)).cast("int")  # enough for a position
    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1

    def window(p):
        return [F.get(words, p), F.get(words, p + 1), F.get(words, p + 2)]

    keys = F.sort_array(F.transform(_positions(n), lambda p: F.call_function("shiftleft", F.xxhash64(*window(p)), bits)
                                    .bitwiseOR(p.cast("bigint"))))
    maybe = _let(keys, lambda s: F.transform(
        _twins(s, lambda a, b: F.call_function("shiftright", a, bits) == F.call_function("shiftright", b, bits)),
        lambda x: x.bitwiseAND(low).cast("int")))
    sure = _let(maybe, lambda m: F.when(F.size(m) == 0, F.array().cast("array<struct<t:string,p:int>>")).otherwise(_let(
        F.array_sort(F.transform(m, lambda p: F.struct(F.concat_ws(" ", *window(p)).alias("t"), p.alias("p")))),
        lambda s: _twins(s, lambda a, b: a["t"] == b["t"]))))
    return F.size(F.array_distinct(F.flatten(F.transform(
        sure, lambda w: F.array(w["p"], w["p"] + 1, w["p"] + 2)))))


#: What the rules are made of; every one is computed once per document.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")


def measure(docs):
    """``doc_id`` and the measurements of each text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    cut = docs.select("doc_id", text.alias("text"), _words(text).alias("words"), lines.alias("lines"))
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.size("words") < 4, 0).otherwise(_repeated_words(F.col("words"))),
        "n_upper": F.regexp_count("text", F.lit(r"\p{Lu}")),
        "n_letters": F.regexp_count("text", F.lit(r"\p{L}")),
    }
    return cut.select("doc_id", *[c.cast("bigint").alias(k) for k, c in counts.items()])


@dataclass(frozen=True)
class Rule:
    name: str
    #: SQL over the measurements; true where a document fails.
    fails: str


#: The position of a rule is its bit; new rules are added at the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 8 * word_chars"),
    Rule("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("capitals", "n_letters >= 20 AND 100 * n_upper > 60 * n_letters"),
    Rule("few_letters", "100 * n_letters < 40 * word_chars"),
)


def mask(*names, rules=RULES):
    return sum(1 << i for i, r in enumerate(rules) if r.name in names)


BASE = mask("few_words", "repeated_windows")
#: Enforced rules by policy version.
POLICIES = {1: BASE, 2: (1 << len(RULES)) - 1}


def ledger(docs, rules=RULES):
    """Per document the measurements and ``fail_bits``, written once as a table."""
    bits = sum((F.when(F.expr(r.fails), 1 << i).otherwise(0).cast("bigint") for i, r in enumerate(rules)),
               F.lit(0).cast("bigint"))
    return stored(measure(docs).withColumn("fail_bits", bits), "rule-ledger")


def judge(found, policy=2):
    """The ledger with ``kept`` under a policy version."""
    return found.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablation(found, policies=POLICIES, rules=RULES):
    """Per policy and rule: documents that fail it, that only it removes, and that stay without it.

    The ledger is reduced to its distinct bit patterns first, at most two to the number of rules.
    """
    patterns = found.groupBy("fail_bits").agg(F.count("*").alias("n"))
    table = found.sparkSession.createDataFrame(
        [(p, m, r.name, 1 << i) for p, m in policies.items() for i, r in enumerate(rules) if m >> i & 1],
        "policy int, mask bigint, rule string, bit bigint")
    left = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return table.join(F.broadcast(patterns), left.bitwiseAND(F.col("bit")) == F.col("bit"), "left").groupBy(
        "policy", "rule").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_fail"),
        F.coalesce(F.sum(F.when(left == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"))


def digest(docs):
    """One row per document: doc_id, the contract's counts, base_failed, kept, fail_bits."""
    return judge(ledger(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"), "kept", "fail_bits")


#: The same digest in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
       regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
       list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT row, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
twice AS (SELECT row, unnest(list(i)) AS i FROM win GROUP BY row, list_slice(w, i, i + 2) HAVING count(*) > 1),
rep AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY row),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
       CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
       length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_upper,
       length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS n_letters
      FROM d LEFT JOIN rep USING (row)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
   + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
   + (CASE WHEN 100 * n_symbols > 8 * word_chars THEN 4 ELSE 0 END)
   + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
   + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END)
   + (CASE WHEN n_letters >= 20 AND 100 * n_upper > 60 * n_letters THEN 32 ELSE 0 END)
   + (CASE WHEN 100 * n_letters < 40 * word_chars THEN 64 ELSE 0 END) AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed,
       bits = 0 AS kept, CAST(bits AS BIGINT) AS fail_bits FROM f
"""
