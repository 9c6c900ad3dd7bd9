"""Chat formatting by a grammar round trip, with built-in functions only.

Template: each turn is ``### role: text </turn>`` and a line end. ``###`` and ``</turn>`` are control strings: the
parser takes every one it meets as a mark. A turn is rendered plainly and parsed again; if the parser can't read it, or
reads another role or text, its content is escaped (``\\`` to ``\\b``, ``#`` to ``\\h``, ``<`` to ``\\l``, in roles also
``:`` to ``\\c`` and line ends to ``\\n``), which leaves no control string, and is parsed once more. The whole
conversation is then parsed from the output and compared with its source; a difference is an error.

Nulls: role and text are read as empty, a null turn comes first, null conversation ids are one conversation. Rows with
the same turn are ordered by role, then text; repeated rows stay. Other columns are ignored; no rows give no rows.
A conversation is one output row, so it has to fit in memory; its rows are rendered before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, ROLE_END, CLOSE = "### ", ": ", " </turn>\n"
MARKS = ("###", "</turn>")


def escape(text: Column, role: bool = False) -> Column:
    pairs = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")] + ([(":", "\\c"), ("\n", "\\n")] if role else [])
    for plain, coded in pairs:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    pairs = ([("\n", "\\n"), (":", "\\c")] if role else []) + [("<", "\\l"), ("#", "\\h"), ("\\", "\\b")]
    for plain, coded in pairs:
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(ROLE_END), text, F.lit(CLOSE))


def parse_body(body: Column) -> Column:
    """(role, text) of what stands between the opening and the closing mark; null where the grammar has no reading."""
    at = F.instr(body, ROLE_END)
    readable = (at > 0) & ~F.contains(body, F.lit(MARKS[0])) & ~F.contains(body, F.lit(MARKS[1]))
    return F.when(readable, F.struct(unescape(F.substring(body, F.lit(1), at - 1), True).alias("role"), unescape(F.substring(body, at + len(ROLE_END), F.length(body))).alias("text")))


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation, in order; a turn that can't be read is null."""
    bodies = F.slice(F.split(formatted, CLOSE, -1), F.lit(1), F.size(F.split(formatted, CLOSE, -1)) - 1)
    return F.transform(bodies, lambda x: F.when(F.startswith(x, F.lit(OPEN)), parse_body(F.substring(x, F.lit(len(OPEN) + 1), F.length(x)))))


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds ``rendered``, plain if it reads back as it was, else escaped."""
    body = F.concat("role", F.lit(ROLE_END), "text")
    same = F.coalesce(parse_body(body) == F.struct("role", "text"), F.lit(False))
    return turns.withColumn("rendered", F.when(same, render(F.col("role"), F.col("text"))).otherwise(render(escape(F.col("role"), True), escape(F.col("text")))))


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, length of each learnt text in the output), turns (read back)."""
    turns = rows.select(rows[conv].alias("conv_id"), rows[turn].alias("turn"), F.coalesce(rows[role].cast("string"), F.lit("")).alias("role"), F.coalesce(rows[text].cast("string"), F.lit("")).alias("text"))
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.length("rendered").cast("long")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = format_turns(turns).withColumns({"place": F.row_number().over(ordered), "begin": before})
    head = F.length("rendered") - F.length(F.substring_index("rendered", ROLE_END, 1)) - len(ROLE_END) - len(CLOSE)
    span = F.when(F.col("role") == learn, F.struct((F.col("begin") + F.length(F.substring_index("rendered", ROLE_END, 1)) + len(ROLE_END)).alias("start"), head.cast("long").alias("length")))
    whole = (placed.withColumn("span", span).groupBy("conv_id")
             .agg(F.array_sort(F.collect_list(F.struct("place", "rendered", "span", "role", "text"))).alias("all"))
             .select("conv_id", F.array_join(F.transform("all", lambda x: x["rendered"]), "").alias("formatted"),
                     F.filter(F.transform("all", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"),
                     F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source")))
    read = whole.withColumn("turns", parse(F.col("formatted")))
    different = F.raise_error(F.concat(F.lit("round trip differs in conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("array<struct<role:string,text:string>>")
    return read.select("conv_id", "formatted", "loss_spans", F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(different).alias("turns"))
