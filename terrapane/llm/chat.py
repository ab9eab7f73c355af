"""Chat formatting from an event log, in DataFrame operations only.

A log has one row per event: conv_id, seq (order in the log), turn (the message it is about), kind, role, text, and
message, where a turn may have several of its own (0 if the log has no such column). `message` opens a message with its
role and first text, `delta` appends a streamed piece, `edit` replaces the text so far, `regenerate` empties it for new
deltas. Events are folded per message first, so that a conversation that holds much of the log is spread over its
messages, then folded messages are joined in blocks of turns, and only rendered blocks meet per conversation.

`log_of_turns` writes finished conversations as the log that they could have come from: each row is a message, opened by
an event of kind `turn`; what the assistant says is streamed, broken off, regenerated and streamed again, and what
others say is a draft that they edit. So the texts of a formatted table of turns come out of the fold, too.

Defined results: null text and role count as empty; null conv_id is one conversation of its own; events equal in all
columns are replays and count once, but for those of kind `turn`: a message counts as often as it is opened by one;
messages with a null turn come last, and messages of one turn in the order of their rendered role and text; a message
whose log lacks an opening event starts at its first delta, with the last role given; among different events of one seq,
the later by kind, role and text holds; other columns are ignored; an empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template and of others that a text may hold.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
START, END = "<|im_start|>", "<|im_end|>\n"
#: A control string with any number of backslashes after its first character.
_BODY = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])"
BLOCK = 256
PIECES = 8  # deltas of a streamed text
LAST = (1 << 63) - 1  # stands for a null turn and its block


def escape(text: Column) -> Column:
    """Each control string gets one more backslash after its first character, so that none is left and all can be told apart."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _BODY, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _BODY, r"$1$2$3")


def escape_role(role: Column) -> Column:
    """A role stays on one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def log_of_turns(turns: DataFrame, streamed_role: str = "assistant") -> DataFrame:
    """The log of finished conversations (conv_id, turn, role, text): each row is a message of its own, also with a null or repeated turn."""
    key = F.xxhash64(F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    step = F.greatest(F.lit(1), F.ceil(F.length("text") / PIECES)).cast("int")
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), key.alias("message")).withColumn("step", step)
    none = F.lit(None).cast("string")
    event = lambda seq, kind, role, text: F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    draft = F.substring(F.col("text"), F.lit(1), F.col("step"))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / F.col("step")).cast("int") - 1)), lambda i: event(i + 3, "delta", none, F.substring(F.col("text"), i * F.col("step") + 1, F.col("step"))))
    streamed = F.concat(F.array(event(F.lit(0), "turn", F.col("role"), F.lit("")), event(F.lit(1), "delta", none, draft), event(F.lit(2), "regenerate", none, none)), parts)
    edited = F.array(event(F.lit(0), "turn", F.col("role"), draft), event(F.lit(1), "edit", none, F.col("text")))
    return rows.select("conv_id", "turn", "message", F.inline(F.when(F.col("role") == streamed_role, streamed).otherwise(edited)))


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, role, text."""
    if "message" not in events.columns:
        events = events.withColumn("message", F.lit(0).cast("long"))
    rank = F.expr("CASE kind WHEN 'message' THEN 0 WHEN 'turn' THEN 0 WHEN 'edit' THEN 1 WHEN 'regenerate' THEN 2 ELSE 3 END")
    event = F.struct(
        F.coalesce("seq", F.lit(-1)).alias("seq"), rank.alias("rank"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").isNotNull().alias("named")
    )
    opened = F.count_if(F.coalesce(F.col("kind") == "turn", F.lit(False)))
    each = events.groupBy("conv_id", "turn", "message").agg(F.array_sort(F.collect_set(event)).alias("log"), F.greatest(F.lit(1), opened).alias("times"))
    resets = F.filter("log", lambda e: e["rank"] < 3)
    last = F.element_at(F.col("resets"), -1)
    head = F.when(F.size("resets") == 0, F.lit("")).when(last["rank"] == 2, F.lit("")).otherwise(last["text"])
    after = F.filter("log", lambda e: (e["rank"] == 3) & ((F.size("resets") == 0) | (e["seq"] >= last["seq"])))
    named = F.filter("log", lambda e: e["named"])
    role = F.when(F.size(named) > 0, F.element_at(named, -1)["role"]).otherwise(F.lit("")).alias("role")
    folded = each.withColumn("resets", resets).select("conv_id", "turn", role, F.concat(head, F.array_join(F.transform(after, lambda e: e["text"]), "")).alias("text"), "times")
    return folded.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times", "one")


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted, and loss_mask: for each turn, in code points, what to skip, to keep under the loss, and to skip after it."""
    role, text = escape_role(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    trained = F.col("role") == trained_role
    length = F.length(F.col("body")).cast("long")
    rows = messages.select("conv_id", "turn", "role", head.alias("head"), text.alias("body"))
    rows = rows.select(
        "conv_id",
        F.coalesce(F.expr(f"turn div {BLOCK}"), F.lit(LAST)).alias("block"),
        F.coalesce("turn", F.lit(LAST)).alias("turn"),
        F.concat("head", "body", F.lit(END)).alias("piece"),
        F.struct(
            (F.length("head").cast("long") + F.when(trained, 0).otherwise(length)).alias("skip"), F.when(trained, length).otherwise(0).cast("long").alias("keep"), F.lit(len(END)).cast("long").alias("after")
        ).alias("mask"),
    )
    item = F.struct("turn", "piece", "mask")
    blocks = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(item)).alias("items"))
    blocks = blocks.select("conv_id", F.struct("block", F.array_join(F.transform("items", lambda x: x["piece"]), "").alias("piece"), F.transform("items", lambda x: x["mask"]).alias("masks")).alias("part"))
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"), F.flatten(F.transform("parts", lambda p: p["masks"])).alias("loss_mask"))


def format_chats(events: DataFrame, trained_role: str = "assistant") -> DataFrame:
    return render(fold(events), trained_role)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_texts, parsed from formatted and loss_mask alone."""
    pieces = F.transform(F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda p: p != ""), lambda p: F.substring(p, len(START) + 1, 2147483647))
    turn = lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(_after_line(p)).alias("text"))
    kept = F.zip_with("pieces", "loss_mask", lambda p, m: unescape(F.substring(p, (m["skip"] - len(START) + 1).cast("int"), m["keep"].cast("int"))))
    trained = F.filter(F.zip_with("kept", "loss_mask", lambda k, m: F.struct(k.alias("text"), m["keep"].alias("keep"))), lambda x: x["keep"] > 0)
    return (
        formatted.withColumn("pieces", pieces)
        .withColumn("kept", kept)
        .select("conv_id", F.transform("pieces", turn).alias("turns"), F.transform(trained, lambda x: x["text"]).alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"))
    )


def _after_line(piece: Column) -> Column:
    """What follows the first line."""
    return F.substring(piece, F.length(F.substring_index(piece, "\n", 1)) + 2, F.lit(2147483647))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What the query op6 returns, read back from the operator's output."""
    back = read_back(formatted)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
