"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A turn is written ``<s>`` role ``[INST]`` text and a closing mark: ``</s>`` for a turn under the loss mask, ``[/INST]``
for any other. The parser cuts the text behind every closing mark, reads the turns from left to right and unescapes
what it finds. A conversation is first written as it is and parsed again; if the turns recovered differ from the source, its
roles and texts are escaped, and parsed again. Escaping puts one backslash behind the first character of every control
string, however many stand there already, so unescaping (one backslash less) undoes it exactly and no bare control
string is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings.
OPEN, TEXT, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"(<|\[)(\\*)(/?s>|/?INST\])"
_ESCAPED = r"(<|\[)\\(\\*)(/?s>|/?INST\])"
#: The place behind every closing mark.
_AFTER = r"(?<=\[/INST\]|</s>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, _ESCAPED, "$1$2$3")).otherwise(text)


def once(name: str, value: Column) -> Column:
    """A value bound by a generator, so that what reads it does not compute it again."""
    return F.explode(F.array(value)).alias(name)


def render(turns: Column, loss_role: str, escaped: bool) -> Column:
    """Text of an array of (role, text)."""
    own = escape if escaped else (lambda c: c)
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), own(t["role"]), F.lit(TEXT), own(t["text"]), F.when(t["role"] == loss_role, END).otherwise(CLOSE))), "")


def parse(formatted: Column) -> Column:
    """Array of (role, text, loss, role_chars, text_chars, end_chars) that the grammar reads in a formatted conversation.

    A piece that does not begin with ``<s>`` or has no ``[INST]`` is no turn: its role is null, which no source has.
    """
    pieces = F.filter(F.split(formatted, _AFTER), lambda p: p != "")
    marked = F.transform(pieces, lambda p: F.struct(p.alias("p"), F.when(F.startswith(p, F.lit(OPEN)), F.nullif(F.instr(p, TEXT), F.lit(0))).alias("at"), F.endswith(p, F.lit(END)).alias("loss")))

    def cut(x: Column) -> Column:
        p, at, end = x["p"], x["at"], F.when(x["loss"], len(END)).otherwise(len(CLOSE))
        role = F.substring(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        text = F.substring(p, at + len(TEXT), F.length(p) - at - len(TEXT) + 1 - end)
        return F.struct(role.alias("r"), text.alias("t"), x["loss"].alias("loss"), end.alias("end"))

    raw = F.transform(marked, cut)
    return F.transform(raw, lambda x: F.struct(unescape(x["r"]).alias("role"), unescape(x["t"]).alias("text"), x["loss"].alias("loss"), F.length(x["r"]).alias("role_chars"), F.length(x["t"]).alias("text_chars"), x["end"].alias("end_chars")))


def plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def spans(parsed: Column) -> Column:
    """(start, length) in the formatted text of what the loss counts."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("found"))

    def step(acc, t):
        text = acc["at"] + len(OPEN) + t["role_chars"] + len(TEXT)
        one = F.array(F.struct(text.cast("long").alias("start"), t["text_chars"].cast("long").alias("length")))
        return F.struct((text + t["text_chars"] + t["end_chars"]).cast("long").alias("at"), F.when(t["loss"], F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(parsed, start, step, lambda acc: acc["found"])


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conv_id of ``turns`` (conv_id, turn, role, text): formatted, loss_spans, escaped, identical.

    Turns stand by turn, null first; ties by role, then text. A null role or text is empty. Repeated rows are turns
    each. Rows with a null conv_id form one conversation. An empty table gives an empty result; other columns are not
    read. A conversation is one row of the output, so its rows meet in one task; texts of any length are kept whole.
    ``identical`` says that the parser gave the source back; by the escape rule it is always true, and an error is raised
    otherwise.
    """
    blank = F.lit("")
    one = F.struct(F.col("turn").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("sorted")).select("conv_id", once("turns", plain(F.col("sorted"))))
    chats = chats.select("*", once("bare", render(F.col("turns"), loss_role, False)))
    chats = chats.select("*", once("first", parse(F.col("bare"))))
    chats = chats.select("*", once("escaped", ~plain(F.col("first")).eqNullSafe(F.col("turns"))))
    chats = chats.select("conv_id", "turns", "escaped", "first", once("formatted", F.when(F.col("escaped"), render(F.col("turns"), loss_role, True)).otherwise(F.col("bare"))))
    chats = chats.select("*", once("parsed", F.when(F.col("escaped"), parse(F.col("formatted"))).otherwise(F.col("first"))))
    same = ~F.col("escaped") | plain(F.col("parsed")).eqNullSafe(F.col("turns"))
    return chats.select("conv_id", "formatted", spans(F.col("parsed")).alias("loss_spans"), "escaped", F.when(same, True).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip"))).cast("boolean").alias("identical"))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what is read back from the output of :func:`format_chats`: the turns by the parser, the text
    under the loss by ``loss_spans``."""
    rows = formatted.filter("identical").select("conv_id", "formatted", "loss_spans", once("p", parse(F.col("formatted"))))
    all_text = F.array_join(F.transform("p", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    rows = rows.select("conv_id", F.size("p").cast("long").alias("n_turns"), F.sha2(all_text, 256).alias("turns_sha256"), once("loss", F.array_join(under, "")), F.length("formatted").cast("long").alias("formatted_chars"))
    return rows.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def sql(conversations: str) -> str:
    """:func:`digests` of :func:`format_chats` as DuckDB SQL."""
    return rf"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations}),
    c AS (SELECT *, bool_or(regexp_matches(text, '\[/INST\]|</s>') OR regexp_matches(role, '\[INST\]') OR regexp_matches(role || ' ' || text, '[<\[]\\+(/?s>|/?INST\])')) OVER (PARTITION BY conv_id) AS bad FROM t),
    e AS (SELECT *, CASE WHEN bad THEN length(regexp_replace(role, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g')) + length(regexp_replace(text, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g'))
        ELSE length(role) + length(text) END + 9 + CASE WHEN role = 'assistant' THEN 4 ELSE 7 END AS n FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id"""
