"""Chat formatting: roles checked by a finite-state machine, text segments with a loss flag each, all in column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What marks a turn, which roles are learned, and which role may follow which.

    ``before_role`` + role + ``after_role`` + text + ``after_text`` is one turn. ``mark`` starts every control
    string and is escaped inside texts and roles. ``moves`` maps a state and a role to the next state.
    """

    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    after_text: str = "<|im_end|>\n"
    mark: str = "<|"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    ends: tuple[str, ...] = ("user", "assistant")

    def __post_init__(self):
        controls = (self.before_role, self.after_text)
        if len(self.mark) < 2 or self.mark[0] in self.mark[1:] or "&" in self.mark or not all(c.startswith(self.mark) for c in controls):
            raise ValueError("control strings start with the mark, whose first character occurs once in it")
        if not self.after_role or "&" in self.after_role or self.before_role in self.after_text or self.before_role in self.after_role:
            raise ValueError("a turn must be told from its parts")


CHATML = Template()
_REFUSED = "refused"


def escape(text: Column, template: Template = CHATML) -> Column:
    """Text in which no control string can start: ``&`` becomes ``&amp;``, then the first character of the mark ``&lt;``."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit(template.mark), F.lit("&lt;" + template.mark[1:]))


def unescape(text: Column, template: Template = CHATML) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;" + template.mark[1:]), F.lit(template.mark)), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column, template: Template) -> Column:
    return F.replace(escape(role, template), F.lit(template.after_role), F.lit("&nl;"))


def _unescape_role(role: Column, template: Template) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit(template.after_role)), template)


def final_state(roles: Column, template: Template = CHATML) -> Column:
    """State after all roles; a role that may not follow leads to ``refused`` for good."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    return F.aggregate(roles, F.lit(template.start), lambda state, role: F.coalesce(
        F.try_element_at(moves, F.concat(state, F.lit("\n"), role)), F.lit(_REFUSED)))


def format_chats(turns: DataFrame, template: Template = CHATML, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id``, ``valid``, ``segments`` (text, loss) and ``formatted``, their concatenation.

    A conversation is one value, so its rows meet in one task; nothing else does. Rows are ordered by turn, null
    turns first; rows of the same turn by role, then text, and repeated rows are kept. Null text and null role are
    empty. All null ``conv_id`` make one conversation. A conversation whose roles the template refuses is formatted
    all the same with ``valid`` false. No rows give no rows. Other columns are ignored.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                 F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("row"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))

    def parts(t: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(template.before_role), _escape_role(t["role"], template), F.lit(template.after_role)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), t["role"].isin(*template.learned).alias("loss")),
            F.struct(F.lit(template.after_text).alias("text"), F.lit(False).alias("loss")))

    state = final_state(F.transform("turns", lambda t: t["role"]), template)
    out = chats.select("conv_id", state.isin(*template.ends).alias("valid"), F.flatten(F.transform("turns", parts)).alias("segments"))
    return out.select("conv_id", "valid", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    pieces = F.slice(F.split(formatted, r"\Q" + template.before_role + r"\E"), F.lit(2), F.size(F.split(formatted, r"\Q" + template.before_role + r"\E")))

    def turn(piece: Column) -> Column:
        at = F.instr(piece, template.after_role)
        body = F.substr(piece, at + len(template.after_role), F.length(piece) - at - F.lit(len(template.after_role) + len(template.after_text) - 1))
        return F.struct(_unescape_role(F.substr(piece, F.lit(1), at - 1), template).alias("role"), unescape(body, template).alias("text"))

    return F.transform(pieces, turn)


def learned_text(segments: Column, template: Template = CHATML) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
