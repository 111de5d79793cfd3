"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns that fit a token budget. Running sums of turn tokens choose the spans:
a conversation that fits is one window; otherwise the number line of tokens is cut in blocks of the budget less system
turn and history (half of what the system turn leaves, at least), and a turn belongs to the block its first token lies
in. A last turn that does not fit beside the others of its block is a span of its own. Every window starts with the
system turn, then repeats as many of the last turns before it as the budget has room for. Loss falls on assistant turns, but not on repeated ones: each target counts once.

Template: `<|im_start|>ROLE newline TEXT <|im_end|> newline` per turn. Control strings (of this and other templates)
inside a role or a text get a backslash after their first character, a backslash becomes two, so the split at the marks
is exact and unescaping gives the text back.

Only DataFrame functions are used. Scale: a turn is moved with its block and, as history, with the few it can be repeated in; a block
holds a bounded number of tokens and so of turns, so no task gathers a conversation to format it, however long it is. Running sums are
made in two steps, inside and over pieces of a conversation. Only reading back for the digests of whole conversations
needs their texts together, as any digest of a whole does.

Tokens are those counted by the caller's tokenizer (`counts`) or, as none runs here, one a byte, the most that any
byte-level tokenizer makes of a text: a window that is not `over_budget` fits. A window exceeds the budget only where a
turn, or the system turn it starts with, is too long for it: turns are never cut.

Cases: null text and null role are empty; turns with equal numbers stand in the order of role and text; a null number
comes first; rows with a null `conv_id` are one conversation; a conversation of a system turn only is one window;
repeated rows are turns; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import whole

#: Tokens of a window, of a block where the system turn fills the budget, kept free for history, and of the marks of a turn
#: (two control tokens and two line feeds).
BUDGET, BLOCK, HISTORY, MARKS = 2048, 512, 256, 4
#: Consecutive turn numbers whose running sums are made together.
PIECE = 64

START, END = "<|im_start|>", "<|im_end|>"
#: The control strings of known templates.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(role: Column, text: Column, counted: Column | None = None) -> Column:
    """What a turn costs at most: a token per byte of what is written, which no byte-level tokenizer exceeds, or what was
    counted for its text if nothing in it is escaped; and the marks."""
    written = F.octet_length(escaped(text))
    if counted is not None:
        written = F.when(written == F.octet_length(text), F.coalesce(counted, written)).otherwise(written)
    return (written + F.octet_length(escaped(role)) + MARKS).cast("long")


def turns(conversations: DataFrame, counts: str | None = None) -> DataFrame:
    """One row per turn: `at` from 1, `start`, the tokens before it, and `is_system`."""
    counted = F.lit(None).cast("long") if counts is None else F.col(f"`{counts}`").cast("long")
    rows = conversations.select("conv_id", "turn", whole("role").alias("role"), whole().alias("text"), counted.alias("counted"))
    rows = rows.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / PIECE).alias("piece"),
                       tokens(F.col("role"), F.col("text"), F.col("counted")).alias("n_tokens"))
    piece = ["conv_id", "piece"]
    inside = Window.partitionBy(*piece).orderBy("turn", "role", "text")
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.row_number().over(inside)).withColumn("before", F.coalesce(F.sum("n_tokens").over(so_far), F.lit(0)))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy(*piece).agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("size")).select(
        F.col("conv_id").alias("_conv"), F.col("piece").alias("_piece"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("size_before"))
    joined = placed.join(pieces, placed["conv_id"].eqNullSafe(pieces["_conv"]) & placed["piece"].eqNullSafe(pieces["_piece"]))
    at = F.col("inside") + F.col("rows_before")
    return joined.select("conv_id", at.alias("at"), "role", "text", "n_tokens", (F.col("before") + F.col("size_before")).alias("start"),
                         ((at == 1) & (F.col("role") == "system")).alias("is_system"))


def windows(conversations: DataFrame, budget: int = BUDGET, block: int = BLOCK, history: int = HISTORY, counts: str | None = None) -> DataFrame:
    """(conv_id, first_at, n_repeated, n_tokens, over_budget, formatted, loss): a row per window in the order of
    `first_at`. `loss` lists (begin, length) in characters of `formatted`; the first `n_repeated` turns stand in
    earlier windows too. `counts` names a column with the number of tokens of each text."""
    if history > block:
        raise ValueError("history may not be longer than a block")
    every = cut_lineage(turns(conversations, counts))
    first = every.filter("is_system").select(F.col("conv_id").alias("_conv"), F.struct("at", "role", "text", "n_tokens").alias("system"))
    # what a conversation has beside its system turn, and how much of it a block may hold: all if all fits, else room for history stays
    held_by = F.coalesce(F.max(F.when(F.col("is_system"), F.col("n_tokens"))), F.lit(0).cast("long"))
    limits = every.groupBy("conv_id").agg(held_by.alias("_system"), F.sum("n_tokens").alias("_total")).withColumn("_free", F.lit(budget) - F.col("_system"))
    width = (F.when(F.col("_free") <= 0, F.lit(block)).when(F.col("_total") <= budget, F.col("_free"))
             .otherwise(F.greatest(F.col("_free") - history, F.ceil(F.col("_free") / 2))).cast("long"))
    limits = cut_lineage(limits.select(F.col("conv_id").alias("_conv"), "_system", "_free", width.alias("_width")))
    every = every.join(limits, every["conv_id"].eqNullSafe(limits["_conv"])).drop("_conv")
    # a system turn is in block 0 and makes that block even if no other turn follows
    begun = F.greatest(F.col("start") - F.col("_system"), F.lit(0))
    own = F.floor(begun / F.col("_width"))
    # what is further back than the budget can hold beside the system turn cannot be repeated
    reach = F.floor((begun + F.greatest(F.col("_free"), F.lit(0))) / F.col("_width"))
    later = F.when(~F.col("is_system") & (reach > own), F.sequence(own + 1, reach)).otherwise(F.array().cast("array<bigint>"))
    dealt = every.select(
        "conv_id", F.explode(F.concat(F.array(F.struct(own.alias("block"), F.lit(True).alias("fresh"))),
                                      F.transform(later, lambda to: F.struct(to.alias("block"), F.lit(False).alias("fresh"))))).alias("to"),
        F.struct("at", "start", "n_tokens", "role", "text", "is_system").alias("turn"))
    held = dealt.groupBy("conv_id", "to.block").agg(
        F.sort_array(F.collect_list(F.when(F.col("to.fresh"), F.col("turn")))).alias("fresh"),
        F.sort_array(F.collect_list(F.when(~F.col("to.fresh"), F.col("turn")))).alias("old")).filter(F.size("fresh") > 0)
    joined = held.join(first, held["conv_id"].eqNullSafe(first["_conv"]), "left").drop("_conv")
    size = lambda column: F.aggregate(column, F.lit(0).cast("long"), lambda total, turn: total + turn["n_tokens"])
    # only the last turn of a block can reach past it; where the budget does not hold it beside the others, it is a span of its own
    beside = F.when(~F.col("fresh")[0]["is_system"], F.col("system.n_tokens"))
    others = F.size("fresh") - F.when(F.col("fresh")[0]["is_system"], 1).otherwise(0)
    cut = (size("fresh") + F.coalesce(beside, F.lit(0)) > budget) & (others > 1)
    joined = joined.withColumn("kept", F.size("fresh") - F.when(cut, 1).otherwise(0))
    short, long = F.slice("fresh", F.lit(1), F.col("kept")), F.slice("fresh", F.col("kept") + 1, F.size("fresh") - F.col("kept"))
    spans = F.filter(F.array(F.struct(short.alias("fresh"), F.col("old").alias("old")),
                             F.struct(long.alias("fresh"), F.concat("old", short).alias("old"))), lambda span: F.size(span["fresh"]) > 0)
    span = joined.select("conv_id", "system", F.explode(spans).alias("span")).select(
        "conv_id", F.col("span.fresh").alias("fresh"), F.col("span.old").alias("old"),
        F.when(~F.col("span.fresh")[0]["is_system"], F.col("system")).alias("system"))
    span = span.withColumn("fixed", size("fresh") + F.coalesce(F.col("system.n_tokens"), F.lit(0)))
    room = F.lit(budget) - F.col("fixed")
    recent = F.filter("old", lambda turn: ~turn["is_system"] & (F.col("fresh")[0]["start"] - turn["start"] <= room))
    span = span.withColumn("old", recent)
    head = F.when(F.col("system").isNotNull(), F.array(F.struct("system.role", "system.text", F.lit(False).alias("target"))))
    as_turns = lambda column, loss: F.transform(column, lambda turn: F.struct(
        turn["role"].alias("role"), turn["text"].alias("text"), (F.lit(loss) & (turn["role"] == "assistant")).alias("target")))
    none = F.array().cast("array<struct<role:string,text:string,target:boolean>>")
    listed = span.select("conv_id", F.col("fresh")[0]["at"].alias("first_at"), (F.col("fixed") + size("old")).alias("n_tokens"),
                         (F.size("old") + F.when(F.col("system").isNotNull(), 1).otherwise(0)).alias("n_repeated"),
                         F.concat(F.coalesce(head, none), as_turns("old", False), as_turns("fresh", True)).alias("turns"))
    opened = F.transform("turns", lambda turn: F.struct(
        F.concat(F.lit(START), escaped(turn["role"]), F.lit("\n")).alias("head"), escaped(turn["text"]).alias("body"), turn["target"].alias("target")))
    pieces = listed.withColumn("pieces", opened)
    tail = F.lit(f"{END}\n")
    length = lambda piece: F.length(piece["head"]) + F.length(piece["body"]) + len(END) + 1
    begin = lambda at: F.aggregate(F.slice("pieces", F.lit(1), at), F.lit(0), lambda total, piece: total + length(piece))
    loss = F.filter(F.transform("pieces", lambda piece, at: F.struct(
        (begin(at) + F.length(piece["head"])).alias("begin"), F.length(piece["body"]).alias("length"), piece["target"].alias("target"))),
        lambda part: part["target"])
    return pieces.select(
        "conv_id", "first_at", "n_repeated", "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"),
        F.array_join(F.transform("pieces", lambda piece: F.concat(piece["head"], piece["body"], tail)), "").alias("formatted"),
        F.transform(loss, lambda part: F.struct(part["begin"].alias("begin"), part["length"].alias("length"))).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows) from the windows alone."""
    marks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda part: part != "")
    fresh = F.slice(marks, F.col("n_repeated") + 1, F.greatest(F.size(marks) - F.col("n_repeated"), F.lit(0)))
    # the first line is the role: a newline inside a role would be read as its end
    told = F.transform(fresh, lambda part: F.concat(unescaped(F.substr(part, F.lit(len(START) + 1))), F.lit("\n")))
    learnt = F.transform("loss", lambda part: unescaped(F.substr(F.col("formatted"), part["begin"] + 1, part["length"])))
    seen = formatted.select("conv_id", "first_at", F.size(fresh).alias("turns"), F.array_join(told, "").alias("told"),
                            F.array_join(learnt, "").alias("learnt"), F.length("formatted").cast("long").alias("chars"))
    joined = seen.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("first_at", "told", "learnt"))).alias("parts"), F.sum("turns").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    whole_text = lambda name: F.array_join(F.transform("parts", lambda part: part[name]), "")
    return joined.select("conv_id", "n_turns", F.sha2(whole_text("told").cast("binary"), 256).alias("turns_sha256"),
                         F.length(whole_text("learnt")).cast("long").alias("loss_chars"),
                         F.sha2(whole_text("learnt").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_windows")
