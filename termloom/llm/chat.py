"""Chat logs -> final messages -> formatted conversations with a loss mask.

A log row is an event of a conversation: ``turn`` starts a message, ``delta`` adds to
the newest message of its turn number, ``edit`` and ``regenerate`` replace what that
message says so far (later deltas add to the replacement). Events are folded per turn
number first, which is spread over the cluster even if one conversation holds most
rows; only the folded messages of a conversation meet in one row, as its formatted
text is one value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that start a control string, and how texts and roles write them. The
#: ampersand comes first when escaping and last when undoing it.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


@dataclass(frozen=True)
class Template:
    """Marks of a turn: ``open`` role ``middle`` text ``close``. Each begins with a
    character that ``ESCAPES`` removes from texts, so no text can hold a mark."""

    open: str = "<|turn|>"
    middle: str = "[INST]"
    close: str = "</s>"

    def __post_init__(self):
        if not all(m[:1] in ("<", "[") for m in (self.open, self.middle, self.close)):
            raise ValueError("a mark has to begin with < or [")


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """``(conv_id, turn, seq, role, text)`` of final messages from
    ``(conv_id, seq, event, turn, role, text)``.

    Order is (seq, event, role, text) within a turn number, so repeated rows and ties
    have one result; repeated ``turn`` events are messages of their own. Events before
    a turn number's first ``turn`` event have no message to change and are left out, as
    are those of an unknown kind. Null texts and roles are empty; null ids and turn
    numbers are a group of their own, turn nulls first.
    """
    kinds = F.expr("map('turn', 0, 'delta', 1, 'edit', 2, 'regenerate', 2)")
    rows = events.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.struct(
            F.col("seq").cast("long").alias("seq"),
            F.element_at(kinds, F.col("event")).alias("kind"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("e"),
    ).where("e.kind is not null")
    folded = rows.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list("e")).alias("es"))
    places = "sequence(1, size(es))"
    folded = folded.withColumn("starts", F.expr(f"filter({places}, i -> es[i - 1].kind = 0)")).where("size(starts) > 0")
    folded = folded.withColumn(
        "m",
        F.expr(
            "transform(starts, (s, j) -> slice(es, s, if(j + 1 < size(starts), starts[j + 1], size(es) + 1) - s))"
        ),
    )
    folded = folded.withColumn(
        "m",
        F.expr(
            """transform(m, x -> named_struct(
                 'seq', x[0].seq, 'role', x[0].role,
                 'text', array_join(transform(slice(x, array_max(transform(x, (y, i) -> if(y.kind <> 1, i + 1, 0))), size(x)), y -> y.text), '')))"""
        ),
    )
    return folded.select("conv_id", "turn", F.explode("m").alias("m")).select("conv_id", "turn", "m.*")


def render(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """``(conv_id, formatted, loss_spans)``: one row per conversation, turns in the
    order (turn, seq, role, text). ``loss_spans`` are code point ranges
    (start inclusive, end exclusive) of the assistant texts in ``formatted``."""
    whole = messages.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "seq", "role", "text"))).alias("ts")
    )
    parts = whole.withColumn(
        "ts",
        F.transform(
            "ts",
            lambda t: F.struct(
                F.concat(F.lit(template.open), escape(t.role), F.lit(template.middle)).alias("head"),
                escape(t.text).alias("body"),
                (t.role == "assistant").alias("learnt"),
            ),
        ),
    )
    tail = len(template.close)
    spans = F.expr(
        f"""aggregate(ts, named_struct('at', 0, 'spans', array_repeat(named_struct('start', 0, 'end', 0), 0)),
              (s, t) -> named_struct(
                'at', s.at + char_length(t.head) + char_length(t.body) + {tail},
                'spans', if(t.learnt,
                  concat(s.spans, array(named_struct('start', s.at + char_length(t.head), 'end', s.at + char_length(t.head) + char_length(t.body)))),
                  s.spans))).spans"""
    )
    formatted = F.array_join(F.transform("ts", lambda t: F.concat(t.head, t.body, F.lit(template.close))), "")
    return parts.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Reads ``render``'s output back: ``(conv_id, formatted, turns, loss_text)``, a row for
    each row. Empty roles and texts come back empty; no rows give no rows; time and memory
    grow with the length of a conversation, which is one value. Other columns go."""
    raw = F.filter(F.split("formatted", _literal(template.close)), lambda x: x != "")
    turns = F.transform(
        raw,
        lambda x: F.struct(
            unescape(F.substring_index(F.substr(x, F.lit(len(template.open) + 1)), template.middle, 1)).alias("role"),
            unescape(F.substring_index(x, template.middle, -1)).alias("text"),
        ),
    )
    loss = F.array_join(
        F.transform("loss_spans", lambda s: F.substr("formatted", s.start + 1, s.end - s.start)), ""
    )
    return formatted.select("conv_id", "formatted", turns.alias("turns"), unescape(loss).alias("loss_text"))


def _literal(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def as_events(conversations: DataFrame) -> DataFrame:
    """A finished conversation table as a log: each row starts a message. Repeated rows are
    messages of their own, other columns are left out."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("turn").alias("event"), "turn", "role", "text")


def digests(parsed: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of each parsed conversation, a row for each row; one
    without assistant turns has an empty loss text."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
