"""Chat formatting by quotation linking, with DataFrame functions only.

A line's quote level is the number of `>` that it begins with, spaces between them allowed. Successive lines of
one level are a passage. Passages are normalised (A-Z lower-cased, white space collapsed) and hashed, as are each
message's own lines, its own paragraphs and its whole body without quotes. A quoted passage is joined, within
its conversation, to the first message that has the same hash; a passage of several lines that fits nowhere as
a whole goes by its first line. A message answers the latest message that its level-1 passages lead to, and
otherwise none. Conversations come out without quotes, a row for each message, sorted by (conv_id,
thread, turn): thread is the turn that the chain of answers goes back to, and depth how long that chain is. A
message only answers earlier turns, so that it always follows what it answers, and a thread reads in order. The
sort deals ranges to tasks, so that a conversation of any length is written by many.

First messages per hash are found by partial aggregation before any join, so that neither a conversation nor a
passage that fills a third of the table meets in one task, and no two copies are paired; quotes of one passage
that are very many meet its original by broadcast (`spread_join`). A text of any length is parsed in one pass. Chains are followed by
pointer doubling: rounds go by the logarithm of the longest chain, and there are none if nothing is quoted.

Defined results: a null text is an empty body without quotes. Messages with a null conv_id or turn are kept, and
answer none. Repeated (conv_id, turn) are all kept; they answer what the latest link of any of them says.
Quotes of text that no earlier message has, and a message's quotes of itself, link to nothing, and are removed
like all others. Of several originals the earliest turn counts, of several level-1 passages the latest original.
A null role is formatted as `unknown`. An empty table gives an empty one. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.sparkkit import Table, saved, spread_join

MARK = r"^[ \t]*(>[ \t]*)+"


def normalised(text: Column) -> Column:
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(folded, r"[\x20\x09-\x0D]+", " "), r"^ | $", "")


def parse(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each message's body without quotes, its passages as (level, text), and its deepest level."""
    rows = messages.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    quoting = F.col("text").rlike(r"(?m)" + MARK)
    lines = F.split("text", r"\r\n|\n|\r")
    levelled = F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARK, 0), r"[^>]", "")).alias("level"), F.regexp_replace(x, MARK, "").alias("line")))
    whole = F.array(F.struct(F.lit(0).alias("level"), F.col("text").alias("line")))
    # Generators keep arrays as columns: an expression over an array's places would else work it out anew at each.
    rows = rows.select("*", quoting.alias("quoting"), F.explode(F.array(F.when(quoting, levelled).otherwise(whole))).alias("lines"))
    changes = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: (i == 1) | (F.element_at("lines", i)["level"] != F.element_at("lines", F.greatest(i - 1, F.lit(1)))["level"]))
    rows = rows.select("*", F.explode(F.array(changes)).alias("starts"))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("lines") + 1))
    text_of = lambda r: F.array_join(F.transform(F.slice("lines", r["s"], r["e"] - r["s"]), lambda x: x["line"]), "\n")
    passages = F.transform(F.arrays_zip(F.col("starts").alias("s"), ends.alias("e")), lambda r: F.struct(F.element_at("lines", r["s"])["level"].alias("level"), text_of(r).alias("text")))
    rows = rows.select("conv_id", "turn", "role", "text", "quoting", F.explode(F.array(passages)).alias("runs"))
    own = F.array_join(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["text"]), "\n")
    body = F.regexp_replace(F.regexp_replace(own, r"^\s+", ""), r"\s+$", "")
    body = F.when(F.col("quoting"), body).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "role", body.alias("body"), F.filter("runs", lambda r: r["level"] > 0).alias("passages"), F.array_max(F.transform("runs", lambda r: r["level"])).alias("quote_depth"))


def _hash(text: Column) -> Column:
    return F.md5(normalised(text).cast("binary"))


def links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, level, parent): for each passage that has an original, the turn of that."""
    quotes = parsed.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("passages").alias("p"))
    first = F.element_at(F.filter(F.split(F.col("p.text"), "\n"), lambda x: normalised(x) != ""), 1)
    quotes = quotes.filter(normalised(F.col("p.text")) != "").select(
        "conv_id", "turn", F.col("p.level").alias("level"), F.monotonically_increasing_id().alias("nth"),
        F.explode(F.array(F.struct(F.lit(0).alias("way"), _hash(F.col("p.text")).alias("hash")), F.struct(F.lit(1).alias("way"), _hash(first).alias("hash")))).alias("h"),
    )
    quotes = saved(quotes.select("conv_id", "turn", "level", "nth", "h.way", "h.hash"))
    pieces = F.concat(F.array(F.col("body")), F.split("body", r"\n[ \t]*\n"), F.split("body", "\n"))
    units = parsed.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(F.array_distinct(F.transform(F.filter(pieces, lambda x: normalised(x) != ""), _hash))).alias("hash"))
    # The earliest message of each hash, by partial sums; then one row a hash meets the hashes that are quoted.
    firsts = units.groupBy("conv_id", "hash").agg(F.min("turn").alias("parent"))
    firsts = saved(quotes.groupBy("conv_id", "hash").agg(F.count(F.lit(1)).alias("times")).join(firsts, ["conv_id", "hash"]))
    found = spread_join(quotes, firsts, ["conv_id", "hash"], "times").filter(F.col("parent") < F.col("turn"))
    best = found.groupBy("conv_id", "turn", "level", "nth").agg(F.min(F.struct("way", "parent")).alias("b"))
    return best.select("conv_id", "turn", "level", F.col("b.parent").alias("parent"))


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) of messages that answer one, by pointer doubling; parents is a saved table."""
    table = Table(parents.select("conv_id", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth")))
    while True:
        # What each message that is answered answers itself: a row for each, with the number of its answers.
        asked = table.df.groupBy("conv_id", F.col("up").alias("turn")).agg(F.count(F.lit(1)).alias("answers"))
        above = Table(asked.join(table.df, ["conv_id", "turn"]).select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), "answers"))
        if not above.df.limit(1).count():
            above.drop()
            return table.df.select("conv_id", "turn", F.col("up").alias("thread"), "depth")
        jumped = Table(spread_join(table.df, above.df, ["conv_id", "up"], "answers").select("conv_id", "turn", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth")))
        after = Table(jumped.df.unionByName(table.df.join(jumped.df.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")))
        for old in (table, above, jumped):
            old.drop()
        table = after


def conversations(messages: DataFrame, **names: str) -> DataFrame:
    """A row for each message: conv_id, turn, role, body, quote_depth, n_passages, reply_to, thread, depth, formatted."""
    parsed = parse(messages, **names)  # one pass over the text, worked out anew for each use rather than written
    out = parsed.select("conv_id", "turn", "role", "body", "quote_depth", F.size("passages").alias("n_passages"))
    quoted = parsed.filter(F.size("passages") > 0).limit(1).count()
    if quoted:
        parents = saved(links(parsed).filter("level = 1").groupBy("conv_id", "turn").agg(F.max("parent").alias("parent")))
        chains = threads(parents)
        out = out.join(parents.withColumnRenamed("parent", "reply_to"), ["conv_id", "turn"], "left").join(chains, ["conv_id", "turn"], "left")
    else:
        none = F.lit(None).cast(parsed.schema["turn"].dataType)
        out = out.withColumns({"reply_to": none, "thread": none, "depth": F.lit(None).cast("long")})
    out = out.withColumn("thread", F.coalesce("thread", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")))
    out = out.withColumn("__nth", F.monotonically_increasing_id()).orderBy("conv_id", "thread", "turn", "__nth")
    line = F.concat(F.lit("<|"), F.coalesce(F.col("role"), F.lit("unknown")), F.lit("|>\n"), F.col("body"))
    return out.select("conv_id", "turn", "role", "body", "quote_depth", "n_passages", "reply_to", "thread", "depth", line.alias("formatted"))
