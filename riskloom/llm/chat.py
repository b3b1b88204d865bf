"""Chat formatting with a finite-state machine over roles, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import scanned, stretches


@dataclass(frozen=True)
class Template:
    """How turns are written and in which order roles may follow each other.

    ``moves`` lists for each state (the last role, or ``start``) the roles that may come next; a conversation is valid
    if every turn is such a move and it ends in an ``ends`` state. Texts of ``loss_roles`` are learnt from.
    """

    opens: str = "<|im_start|>"
    closes: str = "<|im_end|>\n"
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"),
        "tool": ("assistant", "tool")})
    ends: tuple[str, ...] = ("assistant",)
    loss_roles: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column) -> Column:
    r"""One more backslash between ``<`` and ``|``, so no control string is left; ``unescape`` takes it away."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def valid_order(roles: Column, template: Template = CHATML) -> Column:
    """Whether the machine takes every role of the array and stops in an end state."""
    pairs = [(f"{a}>{b}", b) for a, to in template.moves.items() for b in to]
    moves = F.create_map(*[F.lit(x) for p in pairs for x in p])
    last = F.aggregate(roles, F.lit("start"), lambda s, r: F.coalesce(F.element_at(moves, F.concat(s, F.lit(">"), r)), F.lit("")))
    return last.isin(*template.ends)


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, valid, segments (text, loss) in order, formatted, loss_spans (code points of ``formatted``, end exclusive).

    Rows of a conversation are ordered by turn, then role, then text; null turns come first. A null role or text is
    empty; rows without conv_id form one conversation; repeated rows stay. Conversations that break the order are
    formatted too, with ``valid`` false. Control strings in texts are escaped. Other columns are dropped. A conversation
    is one row of the result, so its turns meet in one group.
    """
    rows = turns.select("conv_id", F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                            F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    told = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        def one(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        return F.array(one(F.concat(F.lit(template.opens), _role_out(t["role"]), F.lit("\n")), F.lit(False)),
                       one(escape(t["text"]), t["role"].isin(*template.loss_roles)), one(F.lit(template.closes), F.lit(False)))

    cut = told.select("conv_id", valid_order(F.transform("turns", lambda t: t["role"]), template).alias("valid"),
                      F.flatten(F.transform("turns", segments)).alias("segments"))
    def place(at: Column, s: Column) -> tuple[Column, Column, Column]:
        end = at + F.length(s["text"])
        return end, s["loss"], F.struct(at.alias("start"), end.alias("end"))

    return cut.select("conv_id", "valid", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                      scanned(F.col("segments"), F.lit(0).cast("bigint"), "struct<start:bigint,end:bigint>", place).alias("loss_spans"))


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    mark = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in template.opens)
    parts = F.split(formatted, mark, -1)
    parts = F.slice(parts, F.lit(2), F.size(parts))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(template.closes))
        return F.struct(_role_in(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def learnt_text(formatted: Column, loss_spans: Column) -> Column:
    """The text under the loss mask, unescaped span by span."""
    return F.array_join(F.transform(stretches(formatted, loss_spans), unescape), "")
