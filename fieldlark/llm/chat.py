"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions alone.

Defined results: turns are ordered by (turn, role, text), nulls first, and repeated rows are turns of their
own; a null text or role is empty; a null conversation id is a conversation. A conversation whose roles leave
the machine is still formatted, with ``valid`` false and ``error_at`` the index of the first turn refused
(the number of turns if it only ends too early). Control strings inside a text or role are escaped by a
backslash and come back on reading. No rows: no conversations. Other columns are not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For each role what precedes and follows its text and whether the text is trained on; "*" is any other role.
#: Control strings begin with "<|", which escaped text never holds. {role} stands for the role.
TEMPLATE = {
    "*": {"before": "<|im_start|>{role}\n", "after": "<|im_end|>\n", "loss": False},
    "assistant": {"before": "<|im_start|>{role}\n", "after": "<|im_end|>\n", "loss": True},
}
#: state -> role -> next state; a conversation starts in "start" and may end in a state of FINAL.
MACHINE = {
    "start": {"system": "ready", "user": "asked"},
    "ready": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked", "tool": "asked"},
}
FINAL = ("answered",)


def escaped(text: Column) -> Column:
    """One more backslash inside each "<", backslashes, "|"."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _named(role: Column) -> Column:
    """A role on one line."""
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unnamed(name: Column) -> Column:
    marked = F.replace(F.replace(F.replace(name, F.lit("\\\\"), F.lit("\\s")), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))
    return unescaped(marked)


def _by_role(role: Column, template: dict, part: str) -> Column:
    out = F.lit(template["*"][part])
    for name, parts in template.items():
        if name != "*":
            out = F.when(role == name, F.lit(parts[part])).otherwise(out)
    return out


def format_chats(turns: DataFrame, template: dict = TEMPLATE, machine: dict = MACHINE, final: tuple = FINAL) -> DataFrame:
    """(conv_id, n_turns, valid, error_at, segments, formatted) of rows (conv_id, turn, role, text).

    ``segments``: array of (text, loss) that end to end make ``formatted``; loss marks what is trained on.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    moves = [(F.concat(F.lit(s), F.lit(" "), F.lit(r)), F.lit(to)) for s, each in machine.items() for r, to in each.items()]

    def step(at: Column, t: Column) -> Column:
        """The next state and how many turns were taken; "" once a turn was refused."""
        move = F.concat(at["state"], F.lit(" "), t["role"])
        to = F.coalesce(*(F.when(move == key, state) for key, state in moves), F.lit(""))
        return F.struct(to.alias("state"), (at["n"] + F.when(to == "", 0).otherwise(1)).alias("n"))

    walk = F.aggregate("turns", F.struct(F.lit("start").alias("state"), F.lit(0).alias("n")), step)

    def segments(t: Column) -> Column:
        role = t["role"]
        before = F.replace(_by_role(role, template, "before"), F.lit("{role}"), _named(role))
        return F.array(
            F.struct(before.alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(t["text"]).alias("text"), _by_role(role, template, "loss").alias("loss")),
            F.struct(_by_role(role, template, "after").alias("text"), F.lit(False).alias("loss")),
        )

    made = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), walk.alias("walk"), F.flatten(F.transform("turns", segments)).alias("segments"))
    valid = F.coalesce(F.col("walk.state").isin(*final), F.lit(False))
    return made.select("conv_id", "n_turns", valid.alias("valid"), F.when(~valid, F.col("walk.n")).alias("error_at"), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_chats(formatted: Column, before: str = "<|im_start|>", after: str = "<|im_end|>\n") -> Column:
    """The turns of a formatted chat: array of (role, text)."""
    parts = F.split(formatted, F.lit("\\Q" + before + "\\E"))
    bodies = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    # The text ends at the turn's last control string; the role ends at its first line's end.
    body = lambda x: F.substr(x, F.lit(1), F.length(x) - len(after))
    return F.transform(bodies, lambda x: F.struct(_unnamed(F.substring_index(x, "\n", 1)).alias("role"), unescaped(F.substr(body(x), F.length(F.substring_index(x, "\n", 1)) + 2)).alias("text")))
