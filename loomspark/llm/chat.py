"""Chat formatting: a role machine, a declarative template, and its inverse.

A conversation becomes an array of segments (text, loss flag). Their texts
joined are the formatted conversation; the flagged ones are the loss mask.
Control characters inside roles and texts are escaped with a backslash, so
``read_back`` recovers every turn from the formatted string alone.

Defined results
* null text or role: the empty string; null ``turn`` sorts first; ties in
  ``turn`` go by role, then text; repeated rows are repeated turns.
* a null conversation id is a conversation of its own.
* an order that the machine refuses is still formatted; ``valid_order`` is false.
* empty table: no rows. Columns besides the four named are ignored.

A conversation is one output row, so its turns meet in one task by contract;
conversations are spread by id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """``open`` + label + ``sep`` + text + ``close`` for each turn.

    ``transitions`` maps a state to the roles that may follow it; a role is the
    state after its turn. ``final`` lists the states a conversation may end in.
    """

    open: str = "### "
    sep: str = ": "
    close: str = "</turn>\n"
    labels: dict[str, str] = field(
        default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
    )
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant", "tool"),
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if not (self.open[:1] in ("#", "<") and self.sep[:1] == ":" and self.close[:1] == "<"):
            raise ValueError("markers must begin with the characters that texts escape: # or <, : and <")


#: Each control string above begins with or is cut by one of these.
_CONTROL = r"([\\#<:])"
REFUSED = "refused"


def _escape(c: Column) -> Column:
    return F.regexp_replace(c, _CONTROL, r"\\$1")


def _unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _label(role: Column, t: ChatTemplate) -> Column:
    """A known role's label; any other role after an equals sign, escaped."""
    known = F.create_map(*[F.lit(x) for kv in t.labels.items() for x in kv])
    return F.coalesce(F.element_at(known, role), F.concat(F.lit("="), _escape(role)))


def _role(label: Column, t: ChatTemplate) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in t.labels.items() for x in (v, k)])
    return F.coalesce(F.element_at(known, label), _unescape(F.substring(label, 2, 2**31 - 1)))


def final_state(roles: Column, t: ChatTemplate) -> Column:
    """The machine's state after the last role; ``refused`` is absorbing."""
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, bs in t.transitions.items() for b in bs])
    step = lambda s, r: F.when(F.array_contains(allowed, F.concat(s, F.lit(">"), r)), r).otherwise(F.lit(REFUSED))
    return F.aggregate(roles, F.lit(t.start), step)


def format_chats(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, n_turns, segments, formatted, final_state, valid_order)."""
    t = template or ChatTemplate()
    empty = F.lit("")
    grouped = turns.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
            )
        ).alias("turns")
    )
    segment = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    per_turn = lambda x: F.array(
        segment(F.concat(F.lit(t.open), _label(x["role"], t), F.lit(t.sep)), False),
        F.struct(_escape(x["text"]).alias("text"), x["role"].isin(*t.trained).alias("loss")),
        segment(F.lit(t.close), False),
    )
    return (
        grouped.withColumn("segments", F.flatten(F.transform("turns", per_turn)))
        .withColumn("final_state", final_state(F.transform("turns", lambda x: x["role"]), t))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            "final_state",
            F.col("final_state").isin(*t.final).alias("valid_order"),
        )
    )


def read_back(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The formatted string -> array<struct<role, text>>, escapes undone.

    In a formatted string a bare ``#`` or ``<`` stands only in a marker, so one
    turn is: the opening, label, separator, escaped text, the closing.
    """
    t = template or ChatTemplate()
    # Possessive loops: Java's matcher then keeps no stack frame per character of a long text.
    turn = rf"(?s)\Q{t.open}\E((?:[^\\:]|\\.)*+)\Q{t.sep}\E((?:[^\\<]++|\\.)*+)\Q{t.close}\E"
    labels = F.regexp_extract_all(formatted, F.lit(turn), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(turn), F.lit(2))
    return F.zip_with(labels, texts, lambda a, b: F.struct(_role(a, t).alias("role"), _unescape(b).alias("text")))
