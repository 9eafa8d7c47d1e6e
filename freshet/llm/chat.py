"""Chat formatting: a finite-state machine over roles and a declarative template.

The template names the text around each role's turns. Control strings inside a text are escaped by one backslash after
their first character (each further backslash already there is kept), so the formatted string can be split at its
markers and every text restored exactly. The machine walks the roles of a conversation; the first turn that it does not
allow is reported, and the conversation is formatted all the same.

A conversation is gathered by one shuffle on its id (its formatted text is one string), then folded with built-in
higher-order functions; no Python runs on the executors. Null texts count as empty, a null role as ''. Turns are in the
order of (turn, role, text), null turns first, so ties and repeated rows have one defined result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open and close stand around a turn; heads maps a role to (before, after) its text; other roles are named."""

    open: str = "<s>"
    close: str = "</s>"
    heads: dict = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>"),
            "user": ("[INST]", "[/INST]"),
            "assistant": ("[OUT]", ""),
        }
    )
    other: tuple = ("<<ROLE>>", "<</ROLE>>")
    #: Roles whose texts the loss is taken over.
    learns: tuple = ("assistant",)
    #: state -> role -> next state. A state not listed, or a role not listed for it, is an error.
    moves: dict = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    ends: tuple = ("assistant",)

    def controls(self) -> list[str]:
        found = {self.open, self.close, *self.other, *(x for pair in self.heads.values() for x in pair)} - {""}
        return sorted(found)


LLAMA = Template()


def _by_first(t: Template) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for c in t.controls():
        out.setdefault(c[0], []).append(c[1:])
    return out


def _quote(s: str) -> str:
    return "".join("\\" + c if c in "\\[](){}.*+?^$|/<>-" else c for c in s)


def escape(text: Column, t: Template = LLAMA) -> Column:
    """No control string is left in the result; unescape() gives the text back."""
    for first, rests in _by_first(t).items():
        text = F.regexp_replace(text, rf"({_quote(first)})(?=\\*+(?:{'|'.join(map(_quote, rests))}))", r"$1\\")
    return text


def unescape(text: Column, t: Template = LLAMA) -> Column:
    for first, rests in _by_first(t).items():
        text = F.regexp_replace(text, rf"(?<={_quote(first)})\\(?=\\*+(?:{'|'.join(map(_quote, rests))}))", "")
    return text


def _segments(role: Column, text: Column, t: Template) -> Column:
    """Markup before, the text, markup after; loss only on the text of a role that learns."""

    def seg(s: Column, loss: Column) -> Column:
        return F.struct(s.alias("text"), loss.alias("loss"))

    before, after = F.concat(F.lit(t.open + t.other[0]), escape(role, t), F.lit(t.other[1])), F.lit(t.close)
    head, tail = None, None
    for name, (a, b) in t.heads.items():
        head = (F.when if head is None else head.when)(role == name, F.lit(t.open + a))
        tail = (F.when if tail is None else tail.when)(role == name, F.lit(b + t.close))
    if head is not None:
        before, after = head.otherwise(before), tail.otherwise(after)
    return F.array(seg(before, F.lit(False)), seg(escape(text, t), role.isin(*t.learns)), seg(after, F.lit(False)))


def _machine(roles: Column, t: Template) -> Column:
    """struct(state, bad): the last state and the first position (from 0) that was not allowed, or null."""
    zero = F.struct(F.lit("start").alias("state"), F.lit(0).alias("k"), F.lit(None).cast("int").alias("bad"))

    def step(a: Column, role: Column) -> Column:
        nxt = F.lit(None).cast("string")
        for state, by in t.moves.items():
            for name, to in by.items():
                nxt = F.when((a["state"] == state) & (role == name), F.lit(to)).otherwise(nxt)
        return F.struct(
            F.coalesce(nxt, role).alias("state"),
            (a["k"] + 1).alias("k"),
            F.coalesce(a["bad"], F.when(nxt.isNull(), a["k"])).alias("bad"),
        )

    return F.aggregate(roles, zero, step)


def format_chats(
    rows: DataFrame, template: Template = LLAMA, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row for each conversation: conv, n_turns, segments (text, loss), formatted, valid, first_bad_turn.

    valid: the machine allowed every turn and ended in one of its end states.
    """
    one = F.struct(
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    got = rows.groupBy(F.col(f"`{conv}`").alias("conv")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    got = got.select("conv", F.size("turns").cast("long").alias("n_turns"), F.transform("turns", lambda x: x["role"]).alias("roles"), F.flatten(F.transform("turns", lambda x: _segments(x["role"], x["text"], template))).alias("segments"))
    got = got.withColumn("fsm", _machine(F.col("roles"), template))
    return got.select(
        F.col("conv").alias(conv),
        "n_turns",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("fsm.bad").isNull() & F.col("fsm.state").isin(*template.ends)).alias("valid"),
        F.col("fsm.bad").alias("first_bad_turn"),
    )


def read_back(formatted: Column, t: Template = LLAMA) -> Column:
    """array<struct<role, text>> from a formatted string alone."""

    def one(part: Column) -> Column:
        body = F.substr(part, F.lit(len(t.open) + 1))

        def inner(a: str, b: str) -> Column:
            return F.substr(body, F.lit(len(a) + 1), F.length(body) - len(a) - len(b))

        named = F.split(F.substr(body, F.lit(len(t.other[0]) + 1)), _quote(t.other[1]), 2)
        out = F.struct(unescape(F.get(named, F.lit(0)), t).alias("role"), unescape(F.get(named, F.lit(1)), t).alias("text"))
        for name, (a, b) in t.heads.items():
            out = F.when(F.startswith(body, F.lit(a)), F.struct(F.lit(name).alias("role"), unescape(inner(a, b), t).alias("text"))).otherwise(out)
        return out

    parts = F.split(formatted, _quote(t.close))
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), one)


def digest(chats: DataFrame, template: Template = LLAMA, conv: str = "conv_id") -> DataFrame:
    """Digests made from the output only: turns out of the formatted string, loss out of the flagged segments."""
    turns = F.array_join(F.transform(read_back(F.col("formatted"), template), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    got = chats.select("*", turns.alias("__turns"), loss.alias("__loss"))
    return got.select(
        conv,
        F.size(read_back(F.col("formatted"), template)).cast("long").alias("n_turns"),
        F.sha2(F.encode("__turns", "UTF-8"), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("__loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "first_bad_turn",
    )
