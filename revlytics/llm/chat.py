"""Chat formatting with a grammar round trip.

A conversation becomes one string, a turn after another:

    <s>[INST] role [/INST]text</s>

The grammar is deterministic: a turn ends at the first `</s>`, its role at the first ` [/INST]`. Each turn is rendered with its
content as it is, reparsed, and compared with its source; only a turn that comes back otherwise is escaped, and is reparsed and
compared again. The whole conversation is then reparsed and compared turn by turn. What can't be made identical fails the job.

Escaping puts one backslash after the first character of every control string (those of the template and of other common
ones: `<|`, `</s>`, `[INST]`, `<<SYS>>`), however many backslashes are there already, and unescaping takes one away. So a text
that looks escaped survives too. A turn without control strings stands unchanged.

Everything is a DataFrame expression: one shuffle by conversation carries each text once; a turn's offset is a running sum in
the same partitioning. A formatted conversation is one string, so it must fit a row, as a document must.

Nulls: a null text or role is empty; turns are ordered with null first, ties by role and rendered text; rows without a conversation id are
one conversation with a null id. Repeated rows are turns each. An empty table gives an empty result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlytics.llm.common import at, passing, stage, table

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
_CONTROL = r"(\||/?s>|/?INST\]|/?SYS>>)"
PLAIN, ESCAPED = r"([<\[])(\\*)" + _CONTROL, r"([<\[])\\(\\*)" + _CONTROL
#: Whose texts are trained on.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def chunks(formatted: Column) -> Column:
    """The turns' strings without their ends; null where the string doesn't end with a turn's end."""
    parts = F.split(formatted, CLOSE, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1))


def turn_of(chunk: Column) -> Column:
    """role and text of a turn's string; null for a string that isn't one."""
    head = F.substring_index(chunk, MIDDLE, 1)
    role, text = F.substr(head, F.lit(len(OPEN) + 1)), F.substr(chunk, F.length(head) + len(MIDDLE) + 1)
    fits = chunk.startswith(OPEN) & (F.length(chunk) >= F.length(head) + len(MIDDLE))
    return F.when(fits, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))


def parse(formatted: Column) -> Column:
    """array<role, text> of a formatted conversation."""
    return F.transform(chunks(formatted), turn_of)


def _stamp(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def _content(role: Column, text: Column) -> Column:
    """role and text as they are to be rendered: raw where that comes back identical, else escaped, else an error."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    back = lambda r, t: F.coalesce(parse(render(r, t)) == source, F.lit(False))
    pair = lambda r, t: F.struct(r.alias("role"), t.alias("text"))
    wrong = F.raise_error(F.lit("a turn doesn't come back identical from its template")).cast("struct<role:string,text:string>")
    return F.when(back(role, text), pair(role, text)).when(back(escape(role), escape(text)), pair(escape(role), escape(text))).otherwise(wrong)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, turns: array<start, loss_start, loss_end> of code points, one for each turn.

    loss_start to loss_end is the turn's part of the loss mask: the rendered text of an assistant's turn, empty for others.
    """
    role, text = (F.coalesce(at(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(at(conv_col).alias("conv_id"), at(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("as", _content(F.col("role"), F.col("text")))
    rows = rows.select("conv_id", "turn", "role", _stamp(F.col("role"), F.col("text")).alias("source"), F.length("as.text").cast("long").alias("chars"), render(F.col("as.role"), F.col("as.text")).alias("chunk"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "chunk")
    start = F.coalesce(F.sum(F.length("chunk").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    end = F.col("start") + F.length("chunk") - len(CLOSE)
    span = F.struct("start", F.when(F.col("role") == LEARNED, end - F.col("chars")).otherwise(end).alias("loss_start"), end.alias("loss_end"))
    placed = rows.withColumn("start", start).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", span.alias("span"), "chunk", "source"))).alias("t"))
    whole = placed.select("conv_id", F.array_join("t.chunk", "").alias("formatted"), F.col("t.span").alias("turns"), F.col("t.source").alias("sources"))
    came_back = F.transform(parse(F.col("formatted")), lambda x: _stamp(x["role"], x["text"]))
    sure = F.when(F.coalesce(came_back == F.col("sources"), F.lit(False)), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation doesn't come back identical")).cast("string"))
    return whole.select("conv_id", sure.alias("formatted"), "turns")


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns: array<role, text>, learned: array of the unescaped texts under the loss mask; from what `format_chats` wrote.

    Masked texts are cut out of each turn's string by the mask's offsets, so that a long conversation is walked through once.
    """
    cut = lambda c, s: unescape(F.substr(c, (s["loss_start"] - s["start"] + 1).cast("int"), (s["loss_end"] - s["loss_start"]).cast("int")))
    masked = F.filter("turns", lambda s: s["loss_end"] > s["loss_start"])
    of_mask = F.filter(F.zip_with(chunks(F.col("formatted")), "turns", lambda c, s: F.struct(c.alias("c"), s.alias("s"))), lambda x: x["s"]["loss_end"] > x["s"]["loss_start"])
    learned = F.when(F.size(masked) == 0, F.array().cast("array<string>")).otherwise(F.transform(of_mask, lambda x: cut(x["c"], x["s"])))
    return formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), learned.alias("learned"))


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def chat_digests(formatted: DataFrame) -> DataFrame:
    read, said = read_chats(formatted), F.array_join("learned", "")
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), _sha256(turns).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"), _sha256(said).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_chat_round_trip(spark, sf_dir: str) -> DataFrame:
    """All conversations and number -7, whose texts are made of control strings; digests of what was written and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    with passing(spark) as kept:
        written = stage(format_chats(turns.unionByName(hard)), "chats")
        out = stage(chat_digests(written), "chat-digests")
        kept.append(out)
    return out


SQL = rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
     e as (select *, regexp_replace(role, '{PLAIN}', '\1\\\2\3', 'g') as safe_role, regexp_replace(text, '{PLAIN}', '\1\\\2\3', 'g') as safe_text from t)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn nulls first, role, text)) as loss_sha256,
       cast(sum({len(OPEN) + len(MIDDLE) + len(CLOSE)} + length(safe_role) + length(safe_text)) as bigint) as formatted_chars
from e group by conv_id
"""
