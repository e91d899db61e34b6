"""Conversations rebuilt from quotations, in built-in functions only.

Messages carry quoted lines marked by `>` once per level. Every line is parsed into its level
and its normalised text; a message's own lines are level 0. Quoted lines of every level are hashed
and joined to the own lines of earlier messages of the conversation: each finds the latest earlier
message that wrote it. The message that most lines of level 1 point to (the later of equals) is
what a message replies to; if no line of level 1 is linked, the shallowest deeper level with a
linked line decides. ``n_quoted`` and ``n_linked`` count level 1, ``n_nested`` and
``n_nested_linked`` the deeper levels. Reply links give every message its thread and depth by doubling steps, so deep
threads take few rounds, and the quotes are cut from the text.

The latest earlier author of a line is found in blocks of turns: within a block by a window,
across blocks from one row per block, so that no window holds more than a block's messages of
one conversation and line. Nothing pairs all messages that share a line.

Defined results: NULL and empty texts have an empty body and no quotes; lines that are empty
but for marks link nothing; messages without a conversation or turn start their own thread;
repeated turns count as one message when linked; an unlinked message is its own thread at depth
0; an empty table gives an empty result. Result columns replace others of the same name.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from chaintally.session import stored

MARKS = r"^[ \t]*((?:>[ \t]?)+)"
BLOCK = 4096


def lines(messages):
    """conv_id, turn, n (place of the line), level, line (as written), key (hash of the normalised text)."""
    split = messages.select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "raw"))
    marks = F.regexp_extract("raw", MARKS, 1)
    bare = F.when(marks == "", F.col("raw")).otherwise(F.regexp_replace("raw", MARKS, ""))
    plain = F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))
    return split.select("conv_id", "turn", "n", F.regexp_count(marks, F.lit(">")).alias("level"),
                        F.when(plain != "", F.xxhash64(plain)).alias("key"))


def body(text="text"):
    """The text without quoted lines and without line breaks at its ends."""
    own = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~F.rlike(x, F.lit(MARKS)))
    return F.btrim(F.array_join(own, "\n"), F.lit("\n"))


def quoted(messages):
    """Quoted lines with ``found``, the latest earlier turn of the conversation that wrote the line itself."""
    known = lines(messages).filter(F.col("key").isNotNull() & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    # a line's own writing and its quotations at each level are rows of their own
    per_turn = known.groupBy("conv_id", "key", "turn", "level").agg(F.count("*").alias("n_quoted")).withColumn("own", F.col("level") == 0)
    wanted = stored(per_turn.withColumn("block", F.floor(F.col("turn") / BLOCK)), "quoted-lines")
    before = Window.partitionBy("conv_id", "key", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    inside = wanted.withColumn("found", F.max(F.when(F.col("own"), F.col("turn"))).over(before))
    blocks = wanted.groupBy("conv_id", "key", "block").agg(F.max(F.when(F.col("own"), F.col("turn"))).alias("last"))
    earlier = Window.partitionBy("conv_id", "key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "key", "block", F.max("last").over(earlier).alias("carried")).filter("carried IS NOT NULL")
    return inside.filter("level > 0").join(carried, ["conv_id", "key", "block"], "left").select(
        "conv_id", "turn", "level", "n_quoted", F.coalesce("found", "carried").alias("found"))


def replies(messages):
    """conv_id, turn, n_quoted, n_linked, n_nested, n_nested_linked, reply_to for every message that quotes something."""
    votes = quoted(messages).groupBy("conv_id", "turn", "level", "found").agg(F.sum("n_quoted").alias("n"))
    found, first = F.col("found").isNotNull(), F.col("level") == 1

    def total(rows):
        return F.sum(F.when(rows, F.col("n")).otherwise(0))

    return votes.groupBy("conv_id", "turn").agg(
        total(first).alias("n_quoted"), total(first & found).alias("n_linked"), total(~first).alias("n_nested"), total(~first & found).alias("n_nested_linked"),
        F.max(F.when(found, F.struct((-F.col("level")).alias("near"), "n", "found")))["found"].alias("reply_to"))


def threads(links, most_rounds=64):
    """conv_id, turn, thread, depth of all linked messages; every round doubles the steps made."""
    columns = ("conv_id", "turn", "up", "steps")
    first = stored(links.filter("reply_to IS NOT NULL").select(
        "conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("bigint").alias("steps"), F.lit(True).alias("open")), "steps")
    done, open_ = first.filter("NOT open"), first
    for _ in range(most_rounds):
        above = done.unionByName(open_).select("conv_id", F.col("turn").alias("up"), F.col("up").alias("higher"), F.col("steps").alias("more"))
        moved = stored(open_.select(*columns).join(above, ["conv_id", "up"], "left").select(
            "conv_id", "turn", F.coalesce("higher", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.col("higher").isNotNull().alias("open")), "steps")
        # messages that have come to their thread's start take no part in later rounds
        done, open_ = done.unionByName(moved.filter("NOT open")), moved.filter("open")
        if not open_.limit(1).count():
            return done.select("conv_id", "turn", F.col("up").alias("thread"), F.col("steps").alias("depth"))
    raise RuntimeError("reply links are deeper than 2 to the number of rounds")


def conversations(messages):
    """``messages`` with body, reply_to, thread, depth, n_quoted, n_linked, n_nested and n_nested_linked.

    (conv_id, thread, depth, turn) is the order of replies.
    """
    links = stored(replies(messages), "replies")
    linked = links.join(threads(links), ["conv_id", "turn"], "left")
    names = ("reply_to", "thread", "depth", "n_quoted", "n_linked", "n_nested", "n_nested_linked")
    linked = linked.select(F.col("conv_id").alias("__conv"), F.col("turn").alias("__turn"), *[F.col(c).alias(f"__{c}") for c in names])
    own = messages.withColumn("body", body())
    joined = own.join(linked, (own["conv_id"] == F.col("__conv")) & (own["turn"] == F.col("__turn")), "left")
    zero = F.lit(0).cast("bigint")
    return joined.withColumns({
        "reply_to": F.col("__reply_to"), "thread": F.coalesce("__thread", "turn"), "depth": F.coalesce("__depth", zero),
        **{c: F.coalesce(f"__{c}", zero) for c in names[3:]},
    }).drop("__conv", "__turn", *[f"__{c}" for c in names])


def as_mail(messages):
    """Every message with the one before it quoted below, and the one before that at the second level.

    The driver's conversations hold no quotes; this gives them the form of a mailing list.
    """
    def marked(text, marks):
        return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit(marks), x)), "\n")

    def earlier(back):
        return messages.groupBy("conv_id", "turn").agg(F.min("text").alias(f"__text{back}")).select(
            "conv_id", (F.col("turn") + back).alias("turn"), f"__text{back}")

    return messages.join(earlier(1), ["conv_id", "turn"], "left").join(earlier(2), ["conv_id", "turn"], "left").withColumn(
        "text", F.concat_ws("\n\n", "text", F.concat_ws("\n", marked(F.col("__text1"), "> "), marked(F.col("__text2"), ">> ")))
    ).drop("__text1", "__text2")


def digest(messages):
    """conv_id, turn, role, reply_to (-1: none), thread, depth, n_quoted, n_linked, body of the messages in mail form."""
    mail = stored(as_mail(messages.select("conv_id", "turn", "role", "text")), "mail")
    return conversations(mail).select(
        "conv_id", "turn", "role", F.coalesce("reply_to", F.lit(-1)).alias("reply_to"), "thread", "depth", "n_quoted", "n_linked", "body")


#: The same result in DuckDB's SQL, from the messages before they were quoted.
SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
one AS (SELECT conv_id, turn, min(text) AS text FROM m GROUP BY ALL),
l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS raw FROM m),
own AS (SELECT DISTINCT conv_id, turn, lower(trim(regexp_replace(raw, '\s+', ' ', 'g'))) AS line FROM l),
quote AS (SELECT conv_id, turn + 1 AS turn, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g'))) AS line FROM one),
q AS (SELECT quote.conv_id, quote.turn, quote.line, max(own.turn) AS found
      FROM (SELECT conv_id, turn, line, row_number() OVER () AS k FROM quote WHERE line <> '') quote
      SEMI JOIN one ON one.conv_id = quote.conv_id AND one.turn = quote.turn
      LEFT JOIN own ON own.conv_id = quote.conv_id AND own.line = quote.line AND own.turn < quote.turn GROUP BY quote.conv_id, quote.turn, quote.line, k),
v AS (SELECT conv_id, turn, found, count(*) AS n FROM q GROUP BY ALL),
r AS (SELECT conv_id, turn, sum(n) AS n_quoted, sum(CASE WHEN found IS NOT NULL THEN n ELSE 0 END) AS n_linked, arg_max(found, n * 1000000 + found) AS reply_to
      FROM v GROUP BY conv_id, turn),
t AS (SELECT one.conv_id, one.turn, one.turn AS thread, 0 AS depth FROM one LEFT JOIN r USING (conv_id, turn) WHERE r.reply_to IS NULL
      UNION ALL SELECT r.conv_id, r.turn, t.thread, t.depth + 1 FROM r JOIN t ON t.conv_id = r.conv_id AND t.turn = r.reply_to)
SELECT m.conv_id, m.turn, m.role, coalesce(r.reply_to, -1) AS reply_to, t.thread, CAST(t.depth AS BIGINT) AS depth,
       CAST(coalesce(r.n_quoted, 0) AS BIGINT) AS n_quoted, CAST(coalesce(r.n_linked, 0) AS BIGINT) AS n_linked, trim(m.text, chr(10)) AS body
FROM m LEFT JOIN r USING (conv_id, turn) LEFT JOIN t USING (conv_id, turn)
"""
