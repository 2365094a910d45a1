"""Chat formatting by a declarative template and a finite-state machine over roles.

Every conversation becomes a list of segments with a loss flag each.  Texts are escaped so that
no control string of the template can occur in them, and the escape can be undone.  Everything is
built from DataFrame functions: rows are escaped where they are read, then gathered by
conversation, whose length bounds what one row holds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A turn is ``begin`` role ``middle`` text ``end``.  ``transitions`` maps a state and the next
    role to the next state; a conversation is valid if it ends in one of ``accepting``."""

    begin: str = "<s>[INST] "
    middle: str = " [/INST]\n"
    end: str = "</s>\n"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("assistant",)
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )

    def escaped(self, text: Column) -> Column:
        """Double the escape character, then set one after the first character of each control."""
        text = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        for control in self.controls:
            text = F.replace(text, F.lit(control), F.lit(control[0] + self.escape + control[1:]))
        return text

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\Q" + self.escape + r"\E(.)", "$1")


LOST = "invalid"


def conversations(
    turns: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, segments, formatted, end_state, valid): one row per conversation.

    Turns go by ``turn`` (null first), ties by role, then text; a null role or text is empty.
    Repeated rows are turns of their own and break the order of roles.  Rows without ``conv_id``
    form one conversation without id.  Other columns are not read; an empty table gives no rows.
    """
    kind = F.coalesce(F.col(role), F.lit(""))
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            kind.alias("role"),
            template.escaped(F.coalesce(F.col(text), F.lit(""))).alias("body"),
            F.concat(F.lit(template.begin), template.escaped(kind), F.lit(template.middle)).alias("head"),
            kind.isin(*template.loss_roles).alias("loss"),
        ).alias("t"),
    )
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def part(content: Column, loss: Column) -> Column:
        return F.struct(content.alias("text"), loss.alias("loss"))

    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(part(t["head"], F.lit(False)), part(t["body"], t["loss"]), part(F.lit(template.end), F.lit(False))),
        )
    )
    moves = F.create_map(*[F.lit(x) for (state, seen), to in template.transitions.items() for x in (f"{state}\n{seen}", to)])
    state = F.aggregate(
        "turns", F.lit(template.start), lambda s, t: F.coalesce(F.element_at(moves, F.concat(s, F.lit("\n"), t["role"])), F.lit(LOST))
    )
    made = gathered.select("conv_id", segments.alias("segments"), state.alias("end_state"))
    return made.select(
        "conv_id",
        "segments",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        "end_state",
        F.col("end_state").isin(*template.accepting).alias("valid"),
    )


def read_back(made: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, turns, loss_text, ...): roles and texts parsed from ``formatted``, and the text
    under the loss flags, both unescaped."""
    split = F.split("formatted", r"\Q" + template.begin + r"\E")
    pieces = F.slice(split, F.lit(2), F.size(split) - 1)

    def parsed(piece: Column) -> Column:
        head = F.substring_index(piece, template.middle, 1)
        rest = F.substring(piece, F.length(head) + len(template.middle) + 1, F.length(piece))
        text = F.substring(rest, F.lit(1), F.length(rest) - len(template.end))
        return F.struct(template.unescaped(head).alias("role"), template.unescaped(text).alias("text"))

    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescaped(s["text"]))
    return made.withColumn("turns", F.transform(pieces, parsed)).withColumn("loss_text", F.array_join(learned, ""))


def digests(read: DataFrame) -> DataFrame:
    """The digest columns of conversations that were read back."""
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


#: Two turns whose texts are made of control strings.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(turns: DataFrame) -> DataFrame:
    """``turns`` plus conversation -1: a user, then an assistant row, both saying ``PROBE``."""
    probe = turns.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


_ESCAPED = r"""replace(replace(replace(replace(replace({0}, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"""
SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
made AS (
  SELECT *, {_ESCAPED.format("text")} AS body, {_ESCAPED.format("role")} AS head,
    '/' || CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS mark FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + 24) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(mark, '' ORDER BY turn NULLS FIRST, role, body), '(/s)?(/u/a)+') AS valid
FROM made GROUP BY conv_id"""
