"""Chat formatting, with DataFrame functions alone.

A template says, for each role, how a turn opens and closes and whether its text counts in the loss. Texts are escaped so
that no control string stands in them, which makes the output readable back. A finite-state machine over the roles checks
the order of turns; a conversation that breaks it is formatted too, and marked.

Escaping: the escape sign E becomes E0; in every control string of a text the first character is followed by E1.

Cases: a null text or role is empty; roles that the template doesn't name use its general form; turns sort by turn, then
role, then text, nulls first, and equal rows are turns like others; rows with a null conv_id are one conversation.
A conversation's output is one string, so its turns meet in one task: that is the unit of the format.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "␛"


@dataclass(frozen=True)
class Template:
    """Openings, closings, loss flags, control strings, and the states that each role leads to."""

    opens: dict[str, str]
    closes: dict[str, str]
    loss: tuple[str, ...]
    general_open: tuple[str, str]
    general_close: str
    controls: tuple[str, ...]
    #: state -> role -> state; a turn without an entry breaks the order.
    moves: dict[str, dict[str, str]] = field(default_factory=dict)
    final: tuple[str, ...] = ()


INST = Template(
    opens={"system": "<<SYS>> ", "user": "[INST] ", "assistant": "<s>"},
    closes={"system": " <</SYS>>", "user": " [/INST]", "assistant": "</s>"},
    loss=("assistant",),
    general_open=("[ROLE=", "] "),
    general_close=" [/ROLE]",
    controls=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE=", "[/ROLE]"),
    moves={"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}},
    final=("assistant",),
)


def escape(c: Column, template: Template) -> Column:
    c = F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for x in template.controls:
        c = F.replace(c, F.lit(x), F.lit(x[0] + ESCAPE + "1" + x[1:]))
    return c


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(ESCAPE + "1"), F.lit("")), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _by_role(role: Column, table: dict[str, str], other: Column) -> Column:
    for k, v in table.items():
        other = F.when(role == k, F.lit(v)).otherwise(other)
    return other


def format_chats(turns: DataFrame, template: Template = INST) -> DataFrame:
    """conv_id, segments (array of text and loss flag), valid: whether the turns follow the template's order."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("_turns"))

    def parts(t: Column) -> Column:
        role, text = t["role"], escape(t["text"], template)
        # a name in the general opening is escaped too, and its own end sign with it
        name = F.replace(escape(role, template), F.lit("]"), F.lit(ESCAPE + "2"))
        opening = _by_role(role, template.opens, F.concat(F.lit(template.general_open[0]), name, F.lit(template.general_open[1])))
        closing = _by_role(role, template.closes, F.lit(template.general_close))
        piece = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
        no = F.lit(False)
        return F.array(piece(opening, no), piece(text, role.isin(*template.loss)), piece(closing, no))

    moves = F.create_map(*[F.lit(x) for s, to in template.moves.items() for r, t in to.items() for x in (f"{s} {r}", t)])
    state = F.aggregate("_turns", F.lit("start"), lambda s, t: F.coalesce(F.element_at(moves, F.concat(s, F.lit(" "), t["role"])), F.lit("broken")))
    return chats.select("conv_id", F.flatten(F.transform("_turns", parts)).alias("segments"), state.isin(*template.final).alias("valid"))


def _quote(x: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in " <>" else c for c in x)


def parse_chats(formatted: Column, template: Template = INST) -> Column:
    """The turns (role, text) that a formatted string holds."""
    forms = [f"{_quote(template.opens[r])}.*?{_quote(template.closes[r])}" for r in template.opens]
    forms.append(f"{_quote(template.general_open[0])}.*?{_quote(template.general_close)}")
    found = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(forms)), F.lit(0))

    def turn(x: Column) -> Column:
        head, mid = template.general_open
        name = F.substring_index(F.substr(x, F.lit(len(head) + 1)), mid[0], 1)
        rest = F.substr(x, F.length(name) + len(head) + len(mid) + 1)
        role, text = unescape(F.replace(name, F.lit(ESCAPE + "2"), F.lit("]"))), F.substr(rest, F.lit(1), F.length(rest) - len(template.general_close))
        for r, o in template.opens.items():
            here = F.startswith(x, F.lit(o))
            role = F.when(here, F.lit(r)).otherwise(role)
            text = F.when(here, F.substr(x, F.lit(len(o) + 1), F.length(x) - len(o) - len(template.closes[r]))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(found, turn)


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_chats(turns).withColumn("_f", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    out = out.withColumn("_t", parse_chats(F.col("_f")))
    said = F.array_join(F.transform("_t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return out.select(
        "conv_id", F.size("_t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("_f").cast("long").alias("formatted_chars"), "valid",
    )


_ESCAPED = "replace(text, '␛', '␛0')"
for _x in INST.controls:
    _ESCAPED = f"replace({_ESCAPED}, '{_x}', '{_x[0]}␛1{_x[1:]}')"
OP6_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
wide AS (SELECT *, length({_ESCAPED}) + CASE role WHEN 'assistant' THEN 7 WHEN 'user' THEN 15 ELSE 17 END AS n,
  lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars,
  bool_and((before || ' ' || role) IN ('start system', 'start user', 'system user', 'user assistant', 'assistant user') AND (back > 1 OR role = 'assistant')) AS valid
FROM wide GROUP BY conv_id
"""
