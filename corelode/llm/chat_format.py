r"""Chat formatting in budgeted windows, by DataFrame functions alone.

A turn is written ``<turn ROLE>\nTEXT</turn>\n``, ROLE percent-encoded. In TEXT each backslash is doubled, then ``<turn`` and
``</turn`` get a backslash after ``<``: no control string is left in it, and dropping the first of each backslash pair
(``\x`` -> ``x``) gives the text back.

Windows: turn tokens are counted, and their prefix sums choose spans of whole turns, each as long as its room allows: ``budget``
less the conversation's system turn and the room for history. A system turn over ``system_budget`` takes from that of history first,
then from that of new turns. A window is the system turn, up to ``history_turns`` turns before the span that fit into ``history``
tokens and into what the budget leaves (closest first, no gaps), and the span. The loss mask holds the assistant texts of the
span; repeated ones are masked out, so each is learned once. Only a single turn, or a system turn, that is over its room by
itself makes a window over the budget, since turns aren't cut; such a window has no history.

Conversations are cut into blocks of `block_turns` turn numbers (prefix sums begin anew in each; the last turns of a block are
copied to the next as history), so no task gathers all of a conversation.

Defined results: null text and role count as empty; rows come by turn, then role and text, null turns first in block
zero; equal rows are all kept; a null conv_id is a conversation; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ASSISTANT, SYSTEM = "assistant", "system"
END = "</turn>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("</turn"), F.lit("<\\/turn")), F.lit("<turn"), F.lit("<\\turn"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def head(role: Column) -> Column:
    return F.concat(F.lit("<turn "), F.url_encode(role), F.lit(">\n"))


def count_tokens(text: Column) -> Column:
    """Words and marks, and four for the turn's own marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + 4


def _placed(blocks: DataFrame, budget: int, system_budget: int, history: int, history_turns: int) -> DataFrame:
    """(conv, block, places): for each turn of `line` (k, tokens, old) the spans that show it, (span, repeated), its own and those after it whose
    history reaches it."""
    system = F.coalesce("sys_tokens", F.lit(0))
    behind = F.greatest(F.lit(0), history - F.greatest(F.lit(0), system - system_budget))
    fresh = F.greatest(F.lit(1), budget - system - behind)
    # The system turn has its room already, so it counts nothing where it stands itself.
    cost = lambda x: F.when((x["k"] == 1) & ~x["old"] & F.coalesce(F.col("sys_block") == F.col("block"), F.lit(False)), F.lit(0)).otherwise(x["tokens"]).cast("long")
    of = F.struct(F.lit(0).alias("span"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("upto"))
    start = F.struct(F.array(of).alias("out"), F.lit(-1).alias("span"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("sum"))

    def step(a: Column, x: Column) -> Column:
        upto = a["sum"] + cost(x)
        new = ~x["old"] & ((a["span"] < 0) | (upto - a["base"] > F.col("fresh")))
        span, base = a["span"] + new.cast("int"), F.when(new, a["sum"]).otherwise(a["base"])
        one = F.struct(F.when(x["old"], F.lit(-1)).otherwise(span).alias("span"), a["sum"].alias("before"), upto.alias("upto"))
        return F.struct(F.concat(a["out"], F.array(one)).alias("out"), span.alias("span"), base.alias("base"), upto.alias("sum"))

    out = blocks.withColumns({"fresh": fresh, "room": F.lit(budget) - system})
    out = out.withColumn("sums", F.aggregate("line", start, step, lambda a: F.slice(a["out"], 2, F.size("line"))))
    begins = F.filter(F.transform("sums", lambda x, i: F.struct(x["span"].alias("span"), x["before"].alias("before"), (i + 1).alias("k"))), lambda x: x["span"] >= 0)
    out = out.withColumn("begins", begins)
    out = out.withColumn("begins", F.filter("begins", lambda x, i: (i == 0) | (F.get("begins", i - 1)["span"] != x["span"])))
    last = F.element_at("sums", -1)["upto"]
    size = lambda x, i: F.coalesce(F.get("begins", i + 1)["before"], last) - x["before"]
    left = lambda x, i: F.greatest(F.lit(0), F.least(F.lit(history), F.col("room") - size(x, i)))
    out = out.withColumn("heads", F.transform("begins", lambda x, i: F.struct(x["span"].alias("span"), x["before"].alias("before"), x["k"].alias("k"), left(x, i).alias("left"))))

    def shown(x: Column, i: Column) -> Column:
        """A span is one turn at least, so those whose history may reach this turn are the next `history_turns`."""
        own = F.filter(F.array(F.struct(x["span"].alias("span"), F.lit(False).alias("repeated"))), lambda p: p["span"] >= 0)
        after = F.filter(F.slice("heads", (x["span"] + 2).cast("int"), F.lit(history_turns)), lambda h: (h["k"] - (i + 1) <= history_turns) & (h["before"] - x["before"] <= h["left"]))
        return F.concat(own, F.transform(after, lambda h: F.struct(h["span"].alias("span"), F.lit(True).alias("repeated"))))

    return out.select("conv", "block", F.transform("sums", shown).alias("places"))


def format_chats(df: DataFrame, budget: int = 1024, system_budget: int = 128, history: int = 256, history_turns: int = 4, block_turns: int = 1024) -> DataFrame:
    """(conv_id, block, span, n_repeated, n_new, tokens, text, loss): loss is an array of (start, length) in code points."""
    if budget - system_budget - history < 1 or history_turns < 0 or block_turns <= history_turns:
        raise ValueError("the budget leaves no room for new turns")
    turns = df.select(F.struct("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("said"))
    turns = turns.select("*", count_tokens(F.col("said")).cast("long").alias("tokens"), F.floor(F.coalesce("turn", F.lit(0)) / block_turns).alias("block"))

    # The system turn: the conversation's first row, where its role says so.
    first = turns.groupBy("conv").agg(F.min(F.struct("turn", "role", "said", "block", "tokens")).alias("f")).where(F.col("f.role") == SYSTEM)
    lead = F.concat(head(F.lit(SYSTEM)), escape(F.col("f.said")), F.lit(END))
    first = first.select("conv", F.col("f.block").alias("sys_block"), F.col("f.tokens").alias("sys_tokens"), lead.alias("sys_written"))

    near = F.pmod(F.coalesce("turn", F.lit(0)), F.lit(block_turns)) >= block_turns - history_turns
    here, ahead = F.struct(F.col("block").alias("block"), F.lit(False).alias("old")), F.struct((F.col("block") + 1).alias("block"), F.lit(True).alias("old"))
    turns = turns.withColumn("__in", F.explode(F.when(near, F.array(here, ahead)).otherwise(F.array(here)))).select("conv", "turn", "role", "said", "tokens", "__in.block", "__in.old")
    by = W.partitionBy("conv", "block").orderBy("turn", "role", "said")
    turns = turns.withColumn("k", F.row_number().over(by))
    # Where turns go is worked out on numbers alone, an array a block, then handed to the block's turns, which are dealt alike.
    light = turns.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("k", "tokens", "old"))).alias("line"))
    light = _placed(light.join(first.select("conv", "sys_block", "sys_tokens"), "conv", "left"), budget, system_budget, history, history_turns)
    turns = turns.join(light, ["conv", "block"]).withColumn("places", F.get("places", F.col("k") - 1))
    written = F.concat(head(F.col("role")), escape(F.col("said")), F.lit(END))
    parts = turns.select("conv", "block", "k", "role", "tokens", F.length(head(F.col("role"))).alias("start"), F.length(written).alias("chars"), written.alias("written"), F.explode("places").alias("p"))

    one = F.struct("k", "p.repeated", "role", "tokens", "start", "chars", "written")
    spans = parts.groupBy("conv", "block", F.col("p.span").alias("span")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    spans = spans.join(first, "conv", "left")
    # Where the first row stands in the window itself, it isn't put before it again.
    own = (F.col("sys_block") == F.col("block")) & (F.get("turns", F.lit(0))["k"] == 1)
    add = F.col("sys_written").isNotNull() & ~own
    system = F.struct(
        F.lit(0).alias("k"), F.lit(True).alias("repeated"), F.lit(SYSTEM).alias("role"), F.col("sys_tokens").alias("tokens"), F.lit(0).alias("start"),
        F.length("sys_written").alias("chars"), F.col("sys_written").alias("written"),
    )
    kept = spans.select("conv.conv_id", "block", "span", F.when(add, F.concat(F.array(system), F.col("turns"))).otherwise(F.col("turns")).alias("turns"))
    ends = kept.withColumn("ends", F.aggregate(F.col("turns"), F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t["chars"]))))
    mask = F.filter(
        F.transform(F.col("turns"), lambda t, i: F.struct(
            (~t["repeated"] & (t["role"] == ASSISTANT)).alias("learn"), (F.get("ends", i) + t["start"]).cast("long").alias("start"), (t["chars"] - t["start"] - len(END)).cast("long").alias("length"))),
        lambda x: x["learn"])
    return ends.select(
        "conv_id", "block", "span",
        F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"),
        F.size(F.filter("turns", lambda t: ~t["repeated"])).alias("n_new"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("tokens"),
        F.array_join(F.transform("turns", lambda t: t["written"]), "").alias("text"),
        F.transform(mask, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows say, parsed from their texts and masks: conv_id, block, span, and the new turns and learned texts in
    order, unescaped."""
    pieces = F.slice(F.filter(F.split("text", END), lambda x: x != ""), F.col("n_repeated") + 1, F.greatest(F.col("n_new"), F.lit(0)))
    cut = lambda p: F.instr(p, ">\n")
    turns = F.transform(pieces, lambda p: F.struct(
        F.url_decode(F.substring(p, F.lit(7), cut(p) - 7)).alias("role"), unescape(F.substring(p, cut(p) + 2, F.length(p))).alias("text")))
    learned = F.transform("loss", lambda x: unescape(F.substring(F.col("text"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    return windows.select("conv_id", "block", "span", F.length("text").cast("long").alias("chars"), turns.alias("turns"), learned.alias("learned"))


def chat_digest(windows: DataFrame) -> DataFrame:
    """One row a conversation, from read_back(). A SHA-256 runs over the whole of its input, so here, and only here, a
    conversation's texts meet in one row."""
    one = F.struct("block", "span", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"), F.array_join("learned", "").alias("learned"))
    d = read_back(windows).groupBy("conv_id").agg(F.sum(F.size("turns")).cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.sort_array(F.collect_list(one)).alias("all"))
    said, learned = F.array_join(F.col("all.said"), ""), F.array_join(F.col("all.learned"), "")
    return d.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars")
