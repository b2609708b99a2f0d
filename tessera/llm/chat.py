"""Chat formatting, with DataFrame functions only.

A declarative template names the roles, the text before and after a turn, the roles whose texts are learned, the escapes and
the transitions of a finite-state machine over roles. Formatting emits segments (text, loss) per conversation: the opening of a
turn, its escaped text and its closing. Only the texts of learned roles carry the loss flag. The machine's state is the role
of the last turn, so an order is valid if its first role, every neighbouring pair and its last role are allowed.

Escapes replace the characters that control strings are made of by references that hold none of them, `&` first; undoing them
in reverse order restores every text, whatever it holds.

Defined results: turns are ordered by (turn, role, text), null turns first, so ties and repeated rows have one order and all
are kept; null texts and roles are empty; unknown roles are formatted like the others, without loss, and make the order invalid;
rows with a null conversation id are one conversation; an empty table gives an empty result; other columns are ignored.
A conversation is one row of the result, so its turns meet in one task: rows are shuffled once, by conversation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    opening: str = '<turn role="'
    opened: str = '">'
    closing: str = "</turn>\n"
    learned: tuple[str, ...] = ("assistant",)
    #: What may follow a role; "" is the start.
    transitions: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)
    #: In the order in which they are applied; they undo from last to first.
    escapes: tuple[tuple[str, str], ...] = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    for plain, coded in template.escapes:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, template: Template = DEFAULT) -> Column:
    for plain, coded in reversed(template.escapes):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _allowed(before: Column, after: Column, template: Template) -> Column:
    ok = F.lit(False)
    for role, following in template.transitions.items():
        ok = ok | ((before == role) & after.isin(*following))
    return ok


def format_chats(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, n_turns, valid, first_error (turn's place from 0, null if none),
    segments array<struct<text, loss>>, formatted."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    roles = F.col("roles")
    before = F.concat(F.array(F.lit("")), F.slice(roles, 1, F.size(roles) - 1))
    wrong = F.zip_with(before, roles, lambda a, b: ~_allowed(a, b, template))

    def segments(t: Column) -> Column:
        marker = F.concat(F.lit(template.opening), escape(t["role"], template), F.lit(template.opened))
        parts = ((marker, F.lit(False)), (escape(t["text"], template), t["role"].isin(*template.learned)), (F.lit(template.closing), F.lit(False)))
        return F.array(*[F.struct(x.alias("text"), loss.alias("loss")) for x, loss in parts])

    checked = (
        grouped.withColumn("roles", F.transform("turns", lambda t: t["role"]))
        .withColumn("_wrong", F.array_position(wrong, F.lit(True)))
        .withColumn("_ended", F.element_at("roles", -1).isin(*template.final))
        .withColumn("segments", F.flatten(F.transform("turns", segments)))
    )
    n = F.size("turns").cast("long")
    return checked.select(
        "conv_id",
        n.alias("n_turns"),
        ((F.col("_wrong") == 0) & F.col("_ended")).alias("valid"),
        F.when(F.col("_wrong") > 0, F.col("_wrong") - 1).when(~F.col("_ended"), n).alias("first_error"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns array<struct<role, text>> of a formatted conversation."""
    pieces = F.split(formatted, "\\Q" + template.closing + "\\E", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(template.opening) + 1))
        role = F.substring_index(body, template.opened, 1)
        text = F.substr(body, F.length(role) + len(template.opened) + 1)
        return F.struct(unescape(role, template).alias("role"), unescape(text, template).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: Template = DEFAULT) -> Column:
    """All text under the loss mask, unescaped."""
    learned = F.filter(segments, lambda s: s["loss"])
    return unescape(F.array_join(F.transform(learned, lambda s: s["text"]), ""), template)
