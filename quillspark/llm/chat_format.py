"""Chat formatting: a role automaton checks turn order, a declarative template emits segments.

Everything is DataFrame functions. A conversation is one output row, so its turns have to
meet in one row; they are sorted inside that row's array, nothing else is grouped.

Defined results: null text is empty text; null role is the empty role and, like any role the
template does not name, is never under loss and makes the conversation invalid; rows of equal
turn are ordered by role, then text; repeated rows are kept; a null conv_id is a conversation of
its own; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import literal_rows, table


@dataclass(frozen=True)
class ChatTemplate:
    """Marks around turns, the roles under loss, and which role may follow which.

    `escapes` maps each character that the marks are made of to a backslash code; the
    backslash itself comes first. A text without these characters cannot contain a mark.
    `moves` maps a state ("" at the start) to the roles allowed next; `final` lists the
    states in which a conversation may end.
    """

    turn_open: str = "### "
    after_role: str = ": "
    turn_close: str = " </turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    final: tuple[str, ...] = ("assistant",)

    def escape(self, text: Column) -> Column:
        for raw, code in self.escapes:
            text = F.replace(text, F.lit(raw), F.lit(code))
        return text

    def unescape(self, text: Column) -> Column:
        for raw, code in reversed(self.escapes):
            text = F.replace(text, F.lit(code), F.lit(raw))
        return text


def _automaton(template: ChatTemplate, roles: Column) -> Column:
    """Index of the first turn whose role may not follow, -1 if all may; with the last state."""
    moves = F.create_map(*[
        x for state, after in template.moves.items() for x in (F.lit(state), F.array(*map(F.lit, after)))
    ])
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))

    def step(acc: Column, role: Column) -> Column:
        allowed = F.coalesce(F.array_contains(F.element_at(moves, acc["state"]), role), F.lit(False))
        return F.struct(
            role.alias("state"),
            (acc["at"] + 1).alias("at"),
            F.when(acc["bad"] >= 0, acc["bad"]).when(allowed, F.lit(-1)).otherwise(acc["at"]).alias("bad"),
        )

    return F.aggregate(roles, start, step)


def format_conversations(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, segments (text, loss), formatted, first_bad_turn, valid: one row a conversation."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    gathered = (
        turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct(
            F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"), "role", "text"))).alias("turns"))
    )
    emitted = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(template.turn_open), template.escape(t["role"]), F.lit(template.after_role)).alias("text"),
                 F.lit(False).alias("loss")),
        F.struct(template.escape(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
        F.struct(F.lit(template.turn_close).alias("text"), F.lit(False).alias("loss")),
    )))
    run = _automaton(template, F.transform("turns", lambda t: t["role"]))
    return (
        gathered.select("conv_id", emitted.alias("segments"), run.alias("run"))
        .select(
            "conv_id", "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            F.col("run.bad").cast("long").alias("first_bad_turn"),
            ((F.col("run.bad") < 0) & F.col("run.state").isin(*template.final)).alias("valid"),
        )
    )


def parse_formatted(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """Turns (role, text) read back from formatted text, the marks found in it and texts unescaped."""
    pieces = F.split(formatted, _quoted(template.turn_close))
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def one(piece: Column) -> Column:
        cut = F.instr(piece, template.after_role)
        opened, after = len(template.turn_open), len(template.after_role)
        return F.struct(
            template.unescape(F.substring(piece, F.lit(opened + 1), cut - F.lit(opened + 1))).alias("role"),
            template.unescape(F.substring(piece, cut + F.lit(after), F.length(piece))).alias("text"),
        )

    return F.transform(turns, one)


def _quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"


#: A conversation whose texts hold the template's own marks.
PROBE = ((0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = ChatTemplate()
    probe = literal_rows(spark, [(-7, *row) for row in PROBE], "conv_id turn role text").withColumns({
        "conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    done = format_conversations(turns, template).withColumn("turns", parse_formatted(F.col("formatted"), template))
    nl = F.lit("\n")
    lossy = F.array_join(F.transform(
        F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], nl, t["text"], nl)), ""), 256).alias("turns_sha256"),
        F.length(lossy).cast("long").alias("loss_chars"),
        F.sha2(lossy, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "first_bad_turn", "valid",
    )


#: DuckDB SQL for op1: the digests straight from the rows, the automaton as a lag over turns.
OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *,
    row_number() OVER w - 1 AS pos,
    lag(role, 1, '') OVER w AS before,
    role || chr(10) || text || chr(10) AS turn_text,
    4 + 2 + 9 + len(role) + len(role) - len(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', ''))
      + len(text) + len(text) - len(replace(replace(replace(replace(text, '\', ''), '#', ''), '<', ''), ':', '')) AS chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), judged AS (
  SELECT *, CASE before WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
    WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END AS fits
  FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(turn_text, '' ORDER BY pos)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  CAST(coalesce(min(pos) FILTER (WHERE NOT fits), -1) AS BIGINT) AS first_bad_turn,
  bool_and(fits) AND arg_max(role, pos) = 'assistant' AS valid
FROM judged GROUP BY conv_id
"""
