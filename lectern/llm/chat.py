"""Chat transcripts from event logs: folded into final messages, rendered by a template, and read back.

A log has the rows (conv_id, seq, message, kind, role, text). ``message`` begins a message with its text, ``delta`` adds
text, ``edit`` replaces the text, ``regenerate`` begins it anew, ``delete`` takes the message away. All of it is DataFrame
functions: a log is dealt out by conversation, events are folded message by message in their order, and the finished turns
are put together, because the rendered conversation is one value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ESCAPE = "\\"
#: Kinds of events after which nothing that came before counts.
RESETS = ("message", "edit", "regenerate")


@dataclass(frozen=True)
class Template:
    """Marks of turns: one that opens the turns of each role, a pair around the name of any other role, one that ends a turn.

    All marks and ``reserved`` are control strings. They hold two characters at least, no escape, and none holds the first
    character of any of them at another place: so an occurrence can neither overlap another nor straddle text and mark.
    """

    opens: dict[str, str] = field(default_factory=lambda: {"user": "[INST]", "assistant": "[/INST]", "system": "[SYS]"})
    other: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    end: str = "</s>"
    reserved: tuple[str, ...] = ("<s>",)
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        found, firsts = self.controls(), {c[:1] for c in self.controls()}
        if any(len(c) < 2 or ESCAPE in c or firsts & set(c[1:]) for c in found):
            raise ValueError("control strings must be longer than a character and hold neither escapes nor each other's first characters")
        if any(a != b and b.startswith(a) for a in (*self.opens.values(), self.other[0]) for b in (*self.opens.values(), self.other[0])) or len({*self.opens.values(), self.other[0]}) <= len(self.opens):
            raise ValueError("marks that open turns must not begin like each other")

    def controls(self) -> list[str]:
        return sorted({*self.opens.values(), *self.other, self.end, *self.reserved})


def _java(literal: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", literal)


def escaped(text: Column, template: Template) -> Column:
    """The text with every escape doubled and one set behind the first character of every control string."""
    first = "|".join(f"{_java(c[0])}(?={_java(c[1:])})" for c in template.controls())
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return F.regexp_replace(doubled, f"({first})", "$1\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def messages(log: DataFrame) -> DataFrame:
    """(conv_id, message, position, role, text): the last state of every message that wasn't deleted.

    ``seq`` may be of any type that can be ordered; events of one message with the same ``seq`` go by kind, role and text. The
    position of a message is its first ``seq``; its role is the first that isn't null, else empty. Null texts are empty. Events
    of unknown or null kinds leave the text alone. A message without ``message`` is what its other events make of it. Rows
    with null ids form a conversation, or a message, of their own. Columns beside the six aren't read.
    """
    event = F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    each = log.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("_events"))
    # Places of events in the sorted list: the last that begins the text anew, and the last that deletes it.
    last = lambda *kinds: F.coalesce(F.array_max(F.transform("_events", lambda e, i: F.when(e["kind"].isin(*kinds), i))), F.lit(-1))
    adds = lambda e: F.when(e["kind"].isin("delta", "message", "edit"), e["text"]).otherwise("")
    folded = each.withColumn("_reset", last(*RESETS)).withColumn("_deleted", last("delete")).filter("_deleted < 0 OR _deleted < _reset")
    kept = F.filter("_events", lambda e, i: i >= F.col("_reset"))
    roles = F.filter(F.transform("_events", lambda e: e["role"]), lambda r: r.isNotNull())
    return folded.select(
        "conv_id", "message", F.get(F.col("_events"), F.lit(0))["seq"].alias("position"), F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"),
        F.array_join(F.transform(kept, adds), "").alias("text"),
    )


def rendered(said: DataFrame, template: Template) -> DataFrame:
    """(conv_id, formatted, loss): one row for each conversation of ``messages``.

    Turns go by position, ties by role and text. ``loss`` holds the spans (start, end, byte_start, byte_end) of the texts of
    learned roles in ``formatted``, in code points and in bytes of UTF-8, ends excluded, without marks. Offsets are running
    sums of a window; nothing is appended turn by turn.
    """
    role = F.col("role")
    opened = F.concat(F.lit(template.other[0]), escaped(role, template), F.lit(template.other[1]))
    for name, mark in template.opens.items():
        opened = F.when(role == name, F.lit(mark)).otherwise(opened)
    order = Window.partitionBy("conv_id").orderBy("position", "role", "text", "message")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = lambda f: F.coalesce(F.sum(f("_open") + f("_text") + len(template.end)).over(before), F.lit(0)) + f("_open")
    pieces = said.select("*", opened.alias("_open"), escaped(F.col("text"), template).alias("_text"))
    placed = pieces.select(
        "conv_id", F.row_number().over(order).alias("_at"), F.concat("_open", "_text", F.lit(template.end)).alias("_piece"), role.isin(*template.learned).alias("_learned"),
        size(F.length).alias("start"), F.length("_text").alias("_chars"), size(F.octet_length).alias("byte_start"), F.octet_length("_text").alias("_bytes"),
    )
    span = F.struct("start", (F.col("start") + F.col("_chars")).alias("end"), "byte_start", (F.col("byte_start") + F.col("_bytes")).alias("byte_end"))
    whole = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("_at", "_piece"))).alias("_pieces"), F.sort_array(F.collect_list(F.when(F.col("_learned"), span))).alias("loss")
    )
    return whole.select("conv_id", F.array_join(F.transform("_pieces", lambda p: p["_piece"]), "").alias("formatted"), "loss")


def read_back(formatted: Column, template: Template) -> Column:
    """array<struct<role, text>> of a rendered conversation, unescaped."""
    parts = F.split(formatted, _java(template.end))
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    named, upto = template.other

    def turn(part: Column) -> Column:
        # The first mark that ends a name ends it: names hold none, since they are escaped.
        name = F.substring_index(F.substr(part, F.lit(len(named) + 1)), upto, 1)
        rest = F.substr(part, F.length(name) + len(named) + len(upto) + 1)
        found = F.struct(unescaped(name).alias("role"), unescaped(rest).alias("text"))
        for role, mark in template.opens.items():
            found = F.when(F.startswith(part, F.lit(mark)), F.struct(F.lit(role).alias("role"), unescaped(F.substr(part, F.lit(len(mark) + 1))).alias("text"))).otherwise(found)
        return found

    return F.transform(turns, turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped, one span after another. Spans are cut out by bytes, which takes time in proportion."""
    raw = formatted.cast("binary")
    cut = lambda s: F.substr(raw, (s["byte_start"] + 1).cast("int"), (s["byte_end"] - s["byte_start"]).cast("int")).cast("string")
    return F.array_join(F.transform(loss, lambda s: unescaped(cut(s))), "")


def log_of_turns(turns: DataFrame, draft: int = 40, piece: int = 500) -> DataFrame:
    """A log whose fold gives the rows (conv_id, turn, role, text) back, each as a message of its own, repeated ones too.

    Assistants stream a draft of ``draft`` characters, are asked again and stream the text in deltas of ``piece`` characters; users send the
    draft and edit it; other roles send the whole.
    """
    text = F.coalesce("text", F.lit(""))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / piece).cast("int") - 1, F.lit(0)))
    streamed = F.concat(
        F.array(event("message", F.lit("")), event("delta", F.left(text, F.lit(draft))), event("regenerate", F.lit(""))),
        F.transform(cuts, lambda i: event("delta", F.substr(text, i * piece + 1, F.lit(piece)))),
    )
    sent = F.array(event("message", F.left(text, F.lit(draft))), event("edit", text))
    events = F.when(F.col("role") == "assistant", streamed).when(F.col("role") == "user", sent).otherwise(F.array(event("message", text)))
    # Numbers of rows tell repeated rows apart and decide nothing else: the order of equal turns is that of their texts.
    numbered = turns.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("message"))
    out = numbered.select("conv_id", "turn", "message", "role", F.posexplode(events).alias("_part", "_event"))
    return out.select("conv_id", F.struct("turn", F.col("_part").alias("part")).alias("seq"), "message", F.col("_event.kind").alias("kind"), "role", F.col("_event.text").alias("text"))


def format_chats(log: DataFrame, template: Template | None = None) -> DataFrame:
    """``rendered`` of ``messages``: (conv_id, formatted, loss). An empty log gives no rows.

    The log is dealt out by conversation once, which is all that the fold, the offsets and the rendering need. Where one conversation holds most of a log,
    ``rendered(messages(log))`` folds its messages in many tasks, for a second exchange of all texts.
    """
    return rendered(messages(log.repartition("conv_id")), template or Template())


def digests(log: DataFrame, template: Template | None = None) -> DataFrame:
    """What the rendered conversations say when read back: turns, text under the loss mask, and their lengths.

    The digest of a conversation needs all of it in one value, so a conversation must stay below what a value holds (2 GB).
    """
    template = template or Template()
    found = format_chats(log, template).select("conv_id", "formatted", read_back(F.col("formatted"), template).alias("_turns"), loss_text(F.col("formatted"), F.col("loss")).alias("_loss"))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def sql(turns: str, template: Template | None = None) -> str:
    """DuckDB: what ``digests`` of ``log_of_turns`` says, worked out from the turns themselves."""
    template = template or Template()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    marks = lambda column: f"len({column}) - len(replace({column}, '\\', ''))" + "".join(
        f" + (len({column}) - len(replace({column}, {quoted(c)}, ''))) // {len(c)}" for c in template.controls()
    )
    opens = "CASE role " + " ".join(f"WHEN {quoted(r)} THEN {len(m)}" for r, m in template.opens.items()) + f" ELSE {sum(map(len, template.other))} + len(role) + {marks('role')} END"
    learned = "role IN (" + ", ".join(map(quoted, template.learned)) + ")"
    return f"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {turns}),
sized AS (SELECT *, {opens} + len(text) + {marks('text')} + {len(template.end)} AS size FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER ({learned}), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER ({learned}), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""
