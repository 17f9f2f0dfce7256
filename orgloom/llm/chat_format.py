"""Chat formatting from an event log (DataFrame functions only).

The log is partitioned by conversation, each message's events are sorted by
sequence and folded into its final text, and the messages are rendered with a
template whose control strings can't occur inside a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The control strings that are escaped inside roles and texts.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def literal(s: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else f"[{c}]" if c not in "[]^\\" else f"\\{c}" for c in s)


def escape(text: Column) -> Column:
    r"""Put one more backslash behind the first character of each control string: ``</s>`` becomes ``<\/s>``."""
    firsts = sorted({c[0] for c in CONTROL})
    out = text
    for f in firsts:
        rests = "|".join(literal(c[1:]) for c in CONTROL if c[0] == f)
        out = F.regexp_replace(out, f"{literal(f)}(\\\\*)({rests})", f"{f}\\\\$1$2")
    return out


def unescape(text: Column) -> Column:
    """Undo :func:`escape`."""
    firsts = sorted({c[0] for c in CONTROL})
    out = text
    for f in firsts:
        rests = "|".join(literal(c[1:]) for c in CONTROL if c[0] == f)
        out = F.regexp_replace(out, f"{literal(f)}\\\\(\\\\*)({rests})", f"{f}$1$2")
    return out


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    parts = F.split(unescape(role), "\\\\\\\\")  # at pairs of backslashes
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text, n_events) of a log.

    ``events`` has conv_id, turn, seq, kind, role and text. A turn's events are
    taken by ``seq``: "message" and "edit" set the text, "regenerate" empties it (its
    own text, if any, opens the new version), "delta" appends, "delete" removes the
    turn; any other or null kind counts as "message". A turn's role is that of
    its last event with a role. Null texts are empty, null sequences come first,
    events of equal sequence follow kind, role and text. A turn whose last
    setting event is "delete" is dropped unless something follows it.
    """
    kind = F.when(F.col("kind").isin("edit", "regenerate", "delta", "delete"), F.col("kind")).otherwise("message")
    step = F.struct("seq", kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    folded = events.repartition("conv_id").groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(step)).alias("log"))
    # what counts starts at the last event that is no delta
    last = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i).otherwise(-1)))
    tail = F.filter("log", lambda e, i: i >= F.col("last"))
    spoken = F.filter("log", lambda e: e["role"].isNotNull())
    deleted = (F.col("last") >= 0) & (F.get("log", F.col("last"))["kind"] == "delete")
    return (
        folded.withColumn("last", last)
        .select("conv_id", "turn", tail.alias("tail"), F.get(spoken, F.size(spoken) - 1)["role"].alias("role"),
                F.size("log").alias("n_events"), F.coalesce(deleted, F.lit(False)).alias("deleted"))
        .filter("NOT deleted OR size(tail) > 1")
        .select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                F.array_join(F.transform("tail", lambda e: F.when(e["kind"] == "delete", "").otherwise(e["text"])), "").alias("text"), "n_events")
    )


def message_events(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log of one "message" event each.

    Rows of one conversation with the same turn stay separate messages: each gets
    a place of its own, after turn, role and text.
    """
    return rows.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("r"), F.xxhash64("text").alias("t"),
                 F.monotonically_increasing_id().alias("n")).alias("turn"),
        F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text",
    )


def format_chats(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans.

    ``formatted`` is ``<|im_start|>role\\ntext<|im_end|>\\n`` per message, with control
    strings in texts and roles escaped. ``loss_spans`` holds (start, length) in code
    points of the texts of ``loss_roles``. A null conv_id is one conversation, null
    texts and roles are empty, repeated rows are repeated messages, an empty log
    gives no rows, further columns are ignored. A conversation is one output value,
    so it has to fit into one row; nothing else is gathered.
    """
    tail = f"{CLOSE}\n"
    turns = fold_events(events).select(
        "conv_id", "turn", F.concat(F.lit(OPEN), _role_out(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"),
        F.col("role").isin(*loss_roles).alias("loss"),
    )
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.select(
        "conv_id", "turn", F.concat("head", "body", F.lit(tail)).alias("piece"), "loss", F.length("body").cast("long").alias("length"),
        (F.sum(F.length("head") + F.length("body") + len(tail)).over(upto) - F.length("body") - len(tail)).alias("start"),
    )
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "piece", "loss", "start", "length"))).alias("parts"))
    return whole.select(
        "conv_id", F.size("parts").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"),
        F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: F.struct(p["start"], p["length"])).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    cut = F.filter(F.split(formatted, literal(OPEN)), lambda p, i: i > 0)
    return F.transform(
        cut,
        lambda p: F.struct(
            _role_in(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2,
                                 F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(CLOSE) - 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
