"""Chat formatting by a grammar round trip, in DataFrame functions only.

Grammar: conversation := turn*; turn := "<s>" head text "</s>"; head := "[INST]" (user), "[/INST]"
(assistant), "[SYS]" (system) or "[ROLE]" role "[/ROLE]" (any other role). A text or role holds no
control string. The parser is deterministic: it cuts at "</s>", reads the head, refuses any control
string left in a text, and takes one "~" out of every escaped control string.

Formatting renders the texts as they are, parses the result, compares the recovered turns with the
source, and renders anew with one more level of escapes until both are identical. An escape puts a
"~" behind the first character of every control string, and of every control string that already
holds "~"; a second round is therefore always identical, which is checked, never assumed.

Defined results: null role or text is empty; turns are ordered by turn (null last), ties by role and
text; repeated rows are turns of their own; a null conv_id is one conversation; no row, no
conversation. A conversation is one row of the result, so one conversation must fit a row; many
conversations never meet in one value. Columns besides the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADS = {"user": "[INST]", "assistant": "[/INST]", "system": "[SYS]"}
OPEN, CLOSE, ROLE_OPEN, ROLE_CLOSE = "<s>", "</s>", "[ROLE]", "[/ROLE]"
#: What follows the first character of a control string.
_REST = r"/?(?:s>|INST\]|SYS\]|ROLE\])"
CONTROL = rf"[<\[]{_REST}"
#: Rounds of escaping after which a conversation that still differs is an error.
ROUNDS = 2


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(~*{_REST})", "$1~$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])~(~*{_REST})", "$1$2")


def _head(role: Column) -> Column:
    out = None
    for name, mark in HEADS.items():
        out = F.when(role == name, F.lit(mark)) if out is None else out.when(role == name, F.lit(mark))
    return out.otherwise(F.concat(F.lit(ROLE_OPEN), role, F.lit(ROLE_CLOSE)))


def rendered(turns: Column, level: int) -> Column:
    """The conversation as text, with `level` rounds of escapes."""

    def one(t: Column) -> Column:
        role, text = t["role"], t["text"]
        for _ in range(level):
            role, text = escaped(role), escaped(text)
        return F.concat(F.lit(OPEN), _head(role), text, F.lit(CLOSE))

    return F.array_join(F.transform(turns, one), "")


def parsed(formatted: Column) -> Column:
    """array<struct<role, text, start, length>>: the turns, and where each text, as escaped, stands in
    `formatted` (characters, from 0). A piece that breaks the grammar gives null role and text."""
    pieces = F.split(formatted, CLOSE, -1)
    named = r"(?s)^<s>(\[INST\]|\[/INST\]|\[SYS\]|\[ROLE\](.*?)\[/ROLE\])(.*)$"

    def one(piece: Column) -> Column:
        head, other, body = (F.regexp_extract(piece, named, i) for i in (1, 2, 3))
        role = None
        for name, mark in HEADS.items():
            role = F.when(head == mark, F.lit(name)) if role is None else role.when(head == mark, F.lit(name))
        bad = (head == "") | other.rlike(CONTROL) | body.rlike(CONTROL)
        return F.struct(
            F.when(~bad, role.otherwise(unescaped(other))).alias("role"),
            F.when(~bad, unescaped(body)).alias("text"),
            F.char_length(body).cast("long").alias("length"),
            F.char_length(piece).cast("long").alias("whole"),
        )

    raw = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), one)
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<role:string,text:string,start:bigint,length:bigint>>").alias("turns"))

    def step(acc: Column, t: Column) -> Column:
        end = acc["end"] + t["whole"]
        turn = F.struct(t["role"].alias("role"), t["text"].alias("text"), (end - t["length"]).alias("start"), t["length"].alias("length"))
        return F.struct((end + len(CLOSE)).alias("end"), F.concat(acc["turns"], F.array(turn)).alias("turns"))

    turns = F.aggregate(raw, zero, step, lambda acc: acc["turns"])
    return F.when(F.element_at(pieces, -1) == "", turns)  # text behind the last turn breaks the grammar


def _same(recovered: Column, turns: Column) -> Column:
    pair = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    return F.coalesce(F.transform(recovered, pair) == F.transform(turns, pair), F.lit(False))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, level (rounds of escapes), turns (as parsed back from `formatted`, with the
    place of each text) and loss_spans (start, length in characters of `formatted`: assistant texts)."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.isnull("turn").alias("last"), "turn", "role", "text"))).alias("source"))
    out = out.withColumn("formatted", rendered(F.col("source"), 0)).withColumn("level", F.lit(0))
    for level in range(1, ROUNDS + 1):
        out = out.withColumn("same", _same(parsed(F.col("formatted")), F.col("source")))
        if level == ROUNDS:
            break
        out = out.withColumn("level", F.when(F.col("same"), F.col("level")).otherwise(level)).withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(rendered(F.col("source"), level)))
    out = out.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip"))))
    out = out.withColumn("turns", parsed(F.col("formatted")))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return out.select("conv_id", "formatted", "level", "turns", spans.alias("loss_spans"))


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def digest(formatted: DataFrame) -> DataFrame:
    loss = under_mask(F.col("formatted"), F.col("loss_spans"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


ORACLE_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, case role when 'user' then 6 when 'assistant' then 7 when 'system' then 5
                 else 13 + length(regexp_replace(role, '([<\[])(~*/?(?:s>|INST\]|SYS\]|ROLE\]))', '\1~\2', 'g')) end
            + 7 + length(regexp_replace(text, '([<\[])(~*/?(?:s>|INST\]|SYS\]|ROLE\]))', '\1~\2', 'g')) as chars from c)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls last, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(chars) as bigint) as formatted_chars
from e group by conv_id
"""
