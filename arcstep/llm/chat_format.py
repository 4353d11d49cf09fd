"""Chat formatting with a finite-state machine over roles.

A declarative template gives, for every role, the strings that open and close a
turn and whether its text is learned. A transition table over roles validates
the order of turns. Everything is DataFrame functions: no Python runs on the
executors.

Control strings inside a text are quoted reversibly: after their first character
one backslash is added, also where backslashes already stand there, and reading
back takes one away. Quoted text therefore never holds a control string, so a
formatted conversation splits into its turns without ambiguity.

Defined results for odd input: a null text or role counts as empty; turns are
ordered by (turn, role, text), nulls first, and repeated rows stay repeated
turns; a null conv_id is a conversation of its own; roles that the template does
not know are written with a generic marker and make the order invalid; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcstep.llm.common import table


@dataclass(frozen=True)
class Turn:
    """How the turns of one role are written."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Turn markers by role, the generic markers of other roles, and the role automaton."""

    roles: dict[str, Turn]
    other: tuple[str, str, str]
    transitions: dict[tuple[str, str], str]
    start: str = "start"
    accepting: frozenset[str] = field(default_factory=frozenset)

    def controls(self) -> list[str]:
        """Every control string, longest first."""
        found = {x.strip() for t in self.roles.values() for x in (t.open, t.close)}
        found |= {x.strip() for x in self.other}
        return sorted(found - {""}, key=lambda x: (-len(x), x))

    def __post_init__(self) -> None:
        controls = self.controls()
        for a in controls:
            for b in controls:
                overlap = any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b))) if a != b or k < len(a))
                if b in a[1:] or overlap:
                    raise ValueError(f"control strings {a!r} and {b!r} overlap")

    def quoted_pattern(self) -> str:
        """Groups: the first character, the backslashes after it, the rest of a control string."""
        by_first: dict[str, list[str]] = {}
        for c in self.controls():
            by_first.setdefault(c[0], []).append(re.escape(c[1:]))
        return "|".join(f"(?<={re.escape(f)})(\\\\*)(?=(?:{'|'.join(rest)}))" for f, rest in by_first.items())


#: The default template. An optional system turn, then user and assistant in turn.
CHAT = Template(
    roles={
        "system": Turn("[SYS] ", " [/SYS]"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("<s> ", " </s>", loss=True),
    },
    other=("[ROLE] ", " [/ROLE] ", " [/TURN]"),
    transitions={
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    },
    accepting=frozenset({"assistant"}),
)


def quote(text: Column, template: Template = CHAT) -> Column:
    """Adds one backslash inside every control string, quoted or not."""
    return F.regexp_replace(text, F.lit(template.quoted_pattern()), F.lit("$0\\\\"))


def unquote(text: Column, template: Template = CHAT) -> Column:
    """Takes one backslash out of every quoted control string."""
    by_first: dict[str, list[str]] = {}
    for c in template.controls():
        by_first.setdefault(c[0], []).append(re.escape(c[1:]))
    pattern = "|".join(f"(?<={re.escape(f)})\\\\(?=\\\\*(?:{'|'.join(rest)}))" for f, rest in by_first.items())
    return F.regexp_replace(text, F.lit(pattern), F.lit(""))


def _state(turns: Column, template: Template) -> Column:
    """Runs the role automaton; the state ``invalid`` is never left."""
    table_ = F.create_map(*[F.lit(x) for (s, r), t in template.transitions.items() for x in (f"{s}\n{r}", t)])
    return F.aggregate(
        turns,
        F.lit(template.start),
        lambda state, turn: F.coalesce(table_[F.concat(state, F.lit("\n"), turn["role"])], F.lit("invalid")),
    )


def _segments(turn: Column, template: Template) -> Column:
    """The segments of a turn, struct(text, loss): opening marker, quoted text, closing marker."""
    segment = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    body = quote(turn["text"], template)
    a, b, c = template.other
    chosen = F.array(
        segment(F.concat(F.lit(a), quote(turn["role"], template), F.lit(b)), False), segment(body, False), segment(F.lit(c), False)
    )
    for role, t in template.roles.items():
        own = F.array(segment(F.lit(t.open), False), segment(body, t.loss), segment(F.lit(t.close), False))
        chosen = F.when(turn["role"] == role, own).otherwise(chosen)
    return chosen


def format_conversations(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row a conversation: conv_id, n_turns, valid, final_state, segments, formatted."""
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    conversations = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    out = conversations.withColumn("final_state", _state(F.col("turns"), template)).withColumn(
        "segments", F.flatten(F.transform("turns", lambda t: _segments(t, template)))
    )
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.col("final_state").isin(*template.accepting).alias("valid"),
        "final_state",
        "segments",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
    )


def read_back(formatted: Column, template: Template = CHAT) -> Column:
    """The turns of a formatted conversation, array<struct(role, text, loss)>."""
    markers = {role: (t.open, t.close) for role, t in template.roles.items()}
    a, b, c = template.other
    pattern = "|".join(
        [f"{re.escape(o)}.*?{re.escape(e)}" for o, e in markers.values()] + [f"{re.escape(a)}.*?{re.escape(b)}.*?{re.escape(c)}"]
    )
    found = F.regexp_extract_all(formatted, F.lit(f"(?s){pattern}"), F.lit(0))

    def one(turn: Column) -> Column:
        inner = lambda o, e: turn.substr(F.lit(len(o) + 1), F.length(turn) - len(o) - len(e))
        both = inner(a, c)
        at = F.locate(b, both)
        role = F.substring(both, F.lit(1), at - 1)
        text = F.substring(both, at + len(b), F.length(both))
        make = lambda r, x, loss: F.struct(r.alias("role"), x.alias("text"), F.lit(loss).alias("loss"))
        read = make(unquote(role, template), unquote(text, template), False)
        for r, t in template.roles.items():
            read = F.when(turn.startswith(t.open), make(F.lit(r), unquote(inner(t.open, t.close), template), t.loss)).otherwise(read)
        return read

    return F.transform(found, one)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text and segments."""
    given = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    done = format_conversations(given.unionByName(extra))
    learned = F.filter("segments", lambda s: s["loss"])
    loss_text = F.array_join(F.transform(learned, lambda s: unquote(s["text"])), "")
    read = done.withColumn("read", read_back(F.col("formatted"))).withColumn("loss_text", loss_text)
    turn_text = F.array_join(
        F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(turn_text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "final_state",
    )


def oracle_sql() -> dict[str, str]:
    # The state names the last role as long as every step is allowed.
    steps = " OR ".join(f"(p = '{s}' AND role = '{r}')" for (s, r) in CHAT.transitions)
    markers = "CASE role " + " ".join(f"WHEN '{r}' THEN {len(t.open) + len(t.close)}" for r, t in CHAT.roles.items())
    markers += f" ELSE {sum(map(len, CHAT.other))} + length(role) END"
    quoted = " + ".join(
        f"len(regexp_extract_all(text, '{re.escape(c[0])}\\\\*{re.escape(c[1:])}'))" for c in CHAT.controls()
    )
    return {
        "op3_chat_formatting": f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, coalesce(lag(role) OVER w, 'start') AS p, row_number() OVER w AS rn,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY rn), '') AS loss,
    sum(length(text) + {markers} + {quoted})::BIGINT AS formatted_chars,
    bool_and({steps}) AS allowed, max(CASE WHEN rn = n THEN role END) AS last_role
  FROM s GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars, allowed AND last_role = 'assistant' AS valid,
       CASE WHEN allowed THEN last_role ELSE 'invalid' END AS final_state
FROM g"""
    }


def queries() -> dict:
    return {"op3_chat_formatting": op3_chat_formatting}
