"""Operator 3 [native]: chat formatting in budgeted windows. DataFrame functions only.

Turns of a conversation are rows in order, with prefix sums of their tokens (words). The system turn (a first turn of
role `system`) opens every window and its tokens come off the budget; what is left is the room. Spans are chosen by
prefix sums alone: a turn of more than half the room is a span of its own, all others with their beginnings in one
half of the room, counted along the conversation, and with no such turn between them, form a span. The beginnings lie
within half the room and the last turn adds at most another half, so a span holds no more than the room unless one
turn alone does. Before its span a window repeats up to two turns of history, nearest first, that still fit the
budget. Loss falls on the assistant turns of the span alone (system and history are masked), so each target counts
once however often it is repeated.

Template: `[` role `|` flags `]` text `[/]` for each turn, where flags are `L` (loss), `T` (target turn, no loss) or
`R` (repeated). Inside roles and texts `\\` becomes `\\\\`, `[` becomes `\\(` and `]` becomes `\\)`, so no text can
forge a control string, and unescaping restores every text exactly. Control strings of other templates, such as
`</s>` or `[INST]`, are ordinary text here.

A null text is empty; a null role is an empty role; rows of a conversation order by turn (nulls first), then
role, then text; repeated rows are turns of their own. Rows without conv_id form one conversation (null). Other
columns are not looked at. An empty table gives no rows. A turn's text is copied at most three times on the way (its
own place and twice as history), the system turn once for each window. The digest of a conversation is one string, so
a conversation is one task's work there, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table, written

BUDGET = 256
PLANTED = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("["), F.lit("\\(")), F.lit("]"), F.lit("\\)"))


def unescape(text: Column) -> Column:
    """Undoes escape: split at doubled backslashes, resolve each part, join by single ones."""
    parts = F.split(text, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\("), F.lit("[")), F.lit("\\)"), F.lit("]"))), "\\")


def shown(role: str, flag: Column, text: str) -> Column:
    return F.concat(F.lit("["), escape(F.col(role)), F.lit("|"), flag, F.lit("]"), escape(F.col(text)), F.lit("[/]"))


def spans(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """turns(conv_id, turn, role, text): adds place (from 0), tokens, system_tokens and window, for each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.size(F.split(F.trim(text), r"[\x20\x09-\x0D]+")).cast("long")
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), words.alias("tokens"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("place", F.row_number().over(order) - 1)
    opens = (F.col("place") == 0) & (F.col("role") == "system")
    # the system turn's tokens stand first in the prefix sums: its own when it is there, none otherwise
    rows = rows.withColumn("system_tokens", F.max(F.when(opens, F.col("tokens")).otherwise(0)).over(upto))
    rows = rows.withColumn("begin", F.coalesce(F.sum("tokens").over(before), F.lit(0)) - F.col("system_tokens"))
    half = F.greatest(F.lit(1), F.floor((F.lit(budget) - F.col("system_tokens")) / 2))
    rows = rows.withColumn("cell", F.floor(F.col("begin") / half)).withColumn("large", ~opens & (F.col("tokens") > half))
    previous = F.lag("place").over(order)
    first = F.lag("system_tokens").over(order)  # the turn after the system turn opens no window of its own
    after_system = (F.col("place") == 1) & (first > 0) & (F.col("system_tokens") > 0)
    new = (F.col("large") | F.lag("large").over(order) | (F.col("cell") != F.lag("cell").over(order))) & previous.isNotNull() & ~after_system
    rows = rows.withColumn("new", F.coalesce(new, F.lit(False)).cast("int"))
    return rows.withColumn("window", F.sum("new").over(upto).cast("int")).drop("begin", "cell", "large", "turn")


def windows(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, window, formatted."""
    rows = written(spans(turns, budget), "spans")
    order = Window.partitionBy("conv_id").orderBy("place")
    again = shown("role", F.lit("R"), "text")
    rows = rows.withColumn("own", shown("role", F.when(F.col("role") == "assistant", "L").otherwise("T"), "text")).withColumn("again", F.when((F.col("place") > 0) | (F.col("role") != "system"), again))
    for k in (1, 2):
        rows = rows.withColumn(f"again{k}", F.lag("again", k).over(order)).withColumn(f"tokens{k}", F.lag("tokens", k).over(order))
    begins = (F.col("new") == 1) | (F.col("place") == 0)
    head = F.when(begins, F.struct("place", "again1", "tokens1", "again2", "tokens2", "system_tokens"))
    pieces = F.array_sort(F.collect_list(F.struct("place", "own")))
    found = rows.groupBy("conv_id", "window").agg(F.array_join(F.transform(pieces, lambda p: p["own"]), "").alias("body"), F.sum("tokens").alias("used"), F.min(head).alias("h"))
    room = F.lit(budget) - F.col("used") - F.col("h.system_tokens")
    one = (F.col("window") > 0) & F.col("h.again1").isNotNull() & (F.col("h.tokens1") <= room)
    two = one & F.col("h.again2").isNotNull() & (F.col("h.tokens1") + F.col("h.tokens2") <= room)
    found = found.withColumn("history", F.concat(F.when(two, F.col("h.again2")).otherwise(""), F.when(one, F.col("h.again1")).otherwise("")))
    system = rows.filter((F.col("place") == 0) & (F.col("role") == "system")).select(F.col("conv_id").alias("_conv"), again.alias("system"))
    joined = found.join(system, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("window") > 0), "left")
    return joined.select("conv_id", "window", F.concat(F.coalesce("system", F.lit("")), "history", "body").alias("formatted"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted window: array of role, flag, text."""
    pieces = F.filter(F.split(formatted, r"\[/\]"), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "]", 1)
        flag = F.substring_index(head, "|", -1)
        role = F.substring(head, F.lit(2), F.length(head) - F.length(flag) - 2)
        text = F.substring(p, F.length(head) + 2, F.length(p))
        return F.struct(unescape(role).alias("role"), flag.alias("flag"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def digest(formatted: DataFrame) -> DataFrame:
    """What formatted windows hold: turns, and the text under the loss mask, of each conversation."""
    own = F.filter(parse(F.col("formatted")), lambda t: t["flag"] != "R")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["flag"] == "L"), lambda t: t["text"]), "")
    rows = formatted.select("conv_id", "window", F.length("formatted").cast("long").alias("chars"), own.alias("turns"))
    rows = rows.select("conv_id", "chars", F.struct("window", told.alias("told"), loss.alias("loss")).alias("w"), F.size("turns").cast("long").alias("n"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"), F.sum("n").alias("n_turns"), F.count("*").alias("windows"))
    convs = convs.withColumn("told", F.array_join(F.transform("w", lambda x: x["told"]), "")).withColumn("loss", F.array_join(F.transform("w", lambda x: x["loss"]), ""))
    return convs.select("conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "windows")


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    planted = spark.range(1).select(F.explode(F.array(F.struct(F.lit(-7).cast("long"), F.lit(0).cast("long"), F.lit("user"), F.lit(PLANTED)), F.struct(F.lit(-7).cast("long"), F.lit(1).cast("long"), F.lit("assistant"), F.lit(PLANTED)))).alias("r")).select("r.*")
    return digest(written(windows(rows.union(planted)), "chat"))
