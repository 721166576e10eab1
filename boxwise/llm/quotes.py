"""Quotation linking (operator 8), with DataFrame and SQL functions only.

A line's quote level is its number of leading ``>``. Neighbouring lines of one level are a
passage; level 0 is the message's own text, without the line that introduces a quote ("... wrote:").
Quoted passages are hashed in normal form (lower case, single spaces), whole, by paragraph and by
line of at least ``WORDS`` words, and joined to the messages whose own text, paragraph or line has that hash:
to the first such message of the conversation if it came before, else to the first such of
an earlier conversation. The message answered is the one quoted at the lowest level, whole
passages before parts, of those the latest. Links form a forest, as they lead to smaller
(conversation, turn); its roots and depths give the reply order: thread, depth, turn.

Edge cases: null or empty text has no quotes and stays so; a row without conversation or
turn is neither linked nor linked to; repeated rows are kept and linked alike; a quote
without an original counts as unlinked; an empty table gives an empty result; other columns
are carried unless they bear an output's name, which is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.session import materialize

WORDS = 3
#: The words that end an introduction of a quote.
INTRODUCES = "wrote|writes|said|schrieb|a écrit|écrit|escribió"
OUT = ("own_text", "n_quotes", "n_linked", "reply_to_conv", "reply_to_turn", "thread_conv", "thread_turn", "reply_depth")
_MARK = r"^(?:[ \\t]{0,3}>)+"


def _normal(text: str) -> str:
    return rf"trim(lower(regexp_replace({text}, '\\s+', ' ')))"


def _keys(text: str) -> str:
    """Structs (level, hash) of a text: 0 whole, 1 paragraph, 2 line; too short lines are left out."""
    part = lambda level, sep, least: rf"transform(filter(transform(split({text}, '{sep}'), x -> {_normal('x')}), x -> x <> '' and size(split(x, ' ')) >= {least}), x -> struct({level} as level, sha2(x, 256) as h))"
    whole = f"transform(filter(array({_normal(text)}), x -> x <> ''), x -> struct(0 as level, sha2(x, 256) as h))"
    return f"concat({whole}, {part(1, r'\\n\\s*\\n', 1)}, {part(2, r'\\n', WORDS)})"


def passages(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with own_text and quotes: array of (level, body) in order."""
    lines = df.withColumn("_lines", F.expr(rf"split(coalesce({text}, ''), '\\r?\\n')"))
    parsed = lines.withColumn("_parsed", F.expr(rf"transform(_lines, l -> struct(length(regexp_replace(regexp_extract(l, '{_MARK}', 0), '[^>]', '')) as level, regexp_replace(l, '{_MARK}[ \\t]?', '') as body))"))
    starts = parsed.withColumn("_starts", F.expr("filter(sequence(0, size(_parsed) - 1), i -> i = 0 or get(_parsed, i).level <> get(_parsed, i - 1).level)"))
    whole = starts.withColumn("_parts", F.expr(r"transform(_starts, (s, k) -> struct(get(_parsed, s).level as level, array_join(transform(slice(_parsed, s + 1, coalesce(get(_starts, k + 1), size(_parsed)) - s), x -> x.body), '\n') as body))"))
    shorn = whole.withColumn("_parts", F.expr(rf"transform(_parts, (p, k) -> struct(p.level as level, if(coalesce(get(_parts, k + 1).level, 0) > p.level, regexp_replace(p.body, '(?:^|\\n)[^\\n]*(?:{INTRODUCES})[^\\n]*:[ \\t]*\\s*$', ''), p.body) as body))"))
    own = F.expr(rf"if({text} is null, null, array_join(transform(filter(_parts, p -> p.level = 0), p -> p.body), '\n'))")
    quoted = F.expr("filter(_parts, p -> p.level > 0 and trim(p.body) <> '')")
    out = shorn.withColumn("own_text", own).withColumn("quotes", quoted)
    # own text around quotes is trimmed; a message without quotes stays as it is
    trimmed = F.when(F.exists("_parts", lambda p: p.level > 0), F.expr(r"regexp_replace(own_text, '^\\s+|\\s+$', '')")).otherwise(F.col("own_text"))
    return out.withColumn("own_text", trimmed).drop("_lines", "_parsed", "_starts", "_parts")


def links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, quote, level, part, to_conv, to_turn): the original of every quoted passage that has one."""
    known = parsed.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quoted = known.filter(F.size("quotes") > 0).select("conv_id", "turn", F.posexplode("quotes").alias("quote", "q"))
    quoted = materialize(quoted.select("conv_id", "turn", "quote", "q.level", F.explode(F.expr(_keys("q.body"))).alias("k")).select("conv_id", "turn", "quote", "level", F.col("k.level").alias("part"), "k.h").distinct())
    keys = known.select("conv_id", "turn", F.explode(F.expr(f"transform({_keys('own_text')}, x -> x.h)")).alias("h")).join(quoted.select("h").distinct(), "h", "left_semi")
    here = keys.groupBy("conv_id", "h").agg(F.min("turn").alias("here"))
    first = here.groupBy("h").agg(F.min(F.struct("conv_id", F.col("here").alias("turn"))).alias("first"))
    found = quoted.join(here, ["conv_id", "h"], "left").join(first, "h", "left")
    local = F.col("here") < F.col("turn")
    afar = F.col("first.conv_id") < F.col("conv_id")
    found = found.withColumn("to", F.when(local, F.struct("conv_id", F.col("here").alias("turn"))).when(afar, F.col("first"))).filter("to is not null")
    # whole passages before parts, then this conversation, then the latest
    best = F.min_by("to", F.struct("part", (F.col("to.conv_id") != F.col("conv_id")).alias("far"), -F.col("to.turn")))
    return found.groupBy("conv_id", "turn", "quote").agg(F.min("level").alias("level"), F.min("part").alias("part"), best.alias("to")).select("conv_id", "turn", "quote", "level", "part", F.col("to.conv_id").alias("to_conv"), F.col("to.turn").alias("to_turn"))


def threads(replies: DataFrame) -> DataFrame:
    """Root and depth of every reply, by doubling: each round follows the link of the link."""
    now = replies.select("conv_id", "turn", F.col("to_conv").alias("root_conv"), F.col("to_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"))
    now = materialize(now)
    while True:
        up = now.select(F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("root_conv").alias("up_conv"), F.col("root_turn").alias("up_turn"), F.col("depth").alias("more"))
        moved = now.join(up, ["root_conv", "root_turn"], "left")
        after = materialize(moved.select("conv_id", "turn", F.coalesce("up_conv", "root_conv").alias("root_conv"), F.coalesce("up_turn", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("more").isNotNull().alias("on")))
        if after.filter("on").isEmpty():
            return after.drop("on")
        now = after.drop("on")


def conversations(df: DataFrame) -> DataFrame:
    """Messages without quotes, linked to what they answer; all columns of ``df`` are carried."""
    if clash := set(OUT) & set(df.columns):
        raise ValueError(f"columns are named {sorted(clash)} already")
    # stored, as three steps read it and so that no later step takes lines apart again for each of them
    parsed = materialize(passages(df))
    found = materialize(links(parsed))
    per = found.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.min_by(F.struct("to_conv", "to_turn"), F.struct("level", "part", -F.col("to_turn"))).alias("to"))
    per = materialize(per.select("conv_id", "turn", "n_linked", "to.to_conv", "to.to_turn"))
    rooted = per.join(threads(per), ["conv_id", "turn"])
    out = parsed.join(rooted, ["conv_id", "turn"], "left")
    names = [F.col(c) for c in df.columns]
    return out.select(
        *names,
        "own_text",
        F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("to_conv").alias("reply_to_conv"),
        F.col("to_turn").alias("reply_to_turn"),
        F.coalesce("root_conv", "conv_id").alias("thread_conv"),
        F.coalesce("root_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("reply_depth"),
    )
