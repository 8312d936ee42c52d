"""Chat formatting with typed content parts (operator 5), DataFrame functions only.

A message's content is an array of typed parts. A visitor flattens the parts of a message, in order, into
its text: text parts as they are (escaped), image, audio and document parts as numbered placeholders
``<|image:0|>`` whose references and expanded token counts are recorded beside the text. Turns are joined by
the template; what an assistant says is recorded as loss spans (start, length in code points).

Escaping: a control string opens with ``<`` or ``[``. Inside a text, whatever reads as a control string
after dropping any run of backslashes behind its first character gets one more backslash there:
``</s>`` becomes ``<\\/s>`` and ``<\\/s>`` becomes ``<\\\\/s>``. No control string is left and removing one
backslash restores the text, whatever it was. Text parts that follow each other are joined before they are escaped, so
that a control string can't be put together from parts: every split of a text formats as the whole does. In a
role the mark that ends it, ``|>``, is escaped in the same way.

A message is visited on its own, in its row; only the numbers of its attachments depend on the messages before it (a
running count). Messages then meet per conversation as finished texts.

Defined results: null text is empty, null role is the empty role; null parts are no parts; messages of a conversation are
ordered by turn, null first, ties by role and parts; repeated rows are messages as often as they occur; a null conv_id is a
conversation; a part of an unknown or null type counts as text. An empty table gives no rows. Columns beyond those named are not
read, so extra ones may have any name. A conversation becomes one string, so it must fit in a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: what may follow the first character of a control string
ANGLE, SQUARE = r"/?s>|\|", r"/?INST\]"


@dataclass(frozen=True)
class Template:
    """Marks of a turn; each begins with ``<`` and is a control string."""

    begin: str = "<s>"
    role: str = "<|turn:"
    text: str = "|>"
    end: str = "<|end|>"
    stop: str = "</s>"
    #: expanded tokens: one per image tile of this edge and one more, per second of sound, per page
    image_tile: int = 336
    tokens_per_tile: int = 144
    tokens_per_second: float = 25.0
    tokens_per_page: int = 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<\\*)(?={ANGLE})|(\[\\*)(?={SQUARE})", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<\\*)\\(?={ANGLE})|(\[\\*)\\(?={SQUARE})", "$1$2")


def text_part(text: Column) -> Column:
    """The content of a message that has only text."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null("string").alias("ref"),
                            null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages")))


def part_tokens(part: Column, t: Template) -> Column:
    """Tokens a placeholder stands for; 0 for text."""
    tiles = lambda c: F.greatest(F.ceil(F.coalesce(part[c], F.lit(1)) / F.lit(float(t.image_tile))), F.lit(1))
    return (
        F.when(part["type"] == "image", tiles("width") * tiles("height") * t.tokens_per_tile + 1)
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * t.tokens_per_second))
        .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * t.tokens_per_page)
        .otherwise(0).cast("long")
    )


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin("image", "audio", "document"), F.lit(False))


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), r"(\|\\*)(?=>)", r"$1\\")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(\|\\*)\\(?=>)", "$1"))


def visit(parts: Column, first: Column) -> Column:
    """The flattened text of ``parts`` whose attachments are numbered from ``first``.

    The visitor carries what is finished, the text parts since the last attachment (not escaped yet) and the next number.
    """
    zero = F.struct(F.lit("").alias("done"), F.lit("").alias("run"), first.cast("int").alias("next"))

    def step(at: Column, part: Column) -> Column:
        mark = F.concat(F.lit("<|"), part["type"], F.lit(":"), at["next"].cast("string"), F.lit("|>"))
        return F.when(is_attachment(part), F.struct(F.concat(at["done"], escape(at["run"]), mark).alias("done"), F.lit("").alias("run"), (at["next"] + 1).alias("next"))).otherwise(
            F.struct(at["done"].alias("done"), F.concat(at["run"], F.coalesce(part["text"], F.lit(""))).alias("run"), at["next"].alias("next")))

    return F.aggregate(parts, zero, step, lambda at: F.concat(at["done"], escape(at["run"])))


def format_chats(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """``messages``: conv_id, turn, role, parts (array of PART). One row per conversation:

    conv_id, formatted, loss_spans (array of start, length; 0-based code points of ``formatted``),
    attachments (array of number, type, ref, tokens), n_turns, expanded_tokens (all attachments' tokens).
    """
    t = template
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts"))
    rows = rows.withColumn("_own", F.filter("parts", is_attachment))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "parts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_place": F.row_number().over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_upto": F.sum(F.size("_own")).over(w)})
    first = F.col("_upto") - F.size("_own")
    found = F.transform("_own", lambda p, i: F.struct((first + i).cast("int").alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p, t).alias("tokens")))
    turn = F.struct(F.col("_place").alias("place"), F.concat(F.lit(t.role), escape_role(F.col("role")), F.lit(t.text)).alias("head"),
                    visit(F.col("parts"), first).alias("text"), (F.col("role") == "assistant").alias("loss"), found.alias("found"))
    chats = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    spans0 = F.struct(F.lit(len(t.begin)).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def span(at: Column, x: Column) -> Column:
        start = at["at"] + F.length(x["head"])
        own = F.struct(start.alias("start"), F.length(x["text"]).alias("length"))
        return F.struct((start + F.length(x["text"]) + len(t.end)).alias("at"), F.when(x["loss"], F.concat(at["spans"], F.array(own))).otherwise(at["spans"]).alias("spans"))

    body = F.array_join(F.transform("ts", lambda x: F.concat(x["head"], x["text"], F.lit(t.end))), "")
    found = F.flatten(F.transform("ts", lambda x: x["found"]))
    return chats.select(
        "conv_id",
        F.concat(F.lit(t.begin), body, F.lit(t.stop)).alias("formatted"),
        F.aggregate("ts", spans0, span, lambda x: x["spans"]).alias("loss_spans"),
        found.alias("attachments"),
        F.size("ts").cast("long").alias("n_turns"),
        F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def parse_chats(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Reads ``format_chats`` output back: adds ``turns`` (array of role, text; unescaped, placeholders kept) and ``loss_text``."""
    t = template
    body = F.expr(f"substring(formatted, {len(t.begin) + 1}, length(formatted) - {len(t.begin) + len(t.stop)})")
    pieces = F.split(body, _literal(t.end))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)  # nothing follows the last end

    def turn(x: Column) -> Column:
        cut = F.locate(t.text, x, len(t.role) + 1)
        return F.struct(unescape_role(F.substring(x, F.lit(len(t.role) + 1), cut - 1 - len(t.role))).alias("role"),
                        unescape(F.substring(x, cut + len(t.text), F.length(x))).alias("text"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.withColumns({"turns": F.transform(pieces, turn), "loss_text": loss})


def _literal(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def digest(conversations: DataFrame) -> DataFrame:
    """The rows of query op5: everything is read back from the formatted strings."""
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(own)
    read = parse_chats(format_chats(rows.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
    )


#: the same digests from the table itself; escapes add one character per control string
ORACLE = r"""
with m as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, regexp_replace(regexp_replace(text, '(<\\*)(/?s>|\|)', '\1\\\2', 'g'), '(\[\\*)(/?INST\])', '\1\\\2', 'g') as esc,
    regexp_replace(regexp_replace(regexp_replace(role, '(<\\*)(/?s>|\|)', '\1\\\2', 'g'), '(\[\\*)(/?INST\])', '\1\\\2', 'g'), '(\|\\*)>', '\1\\>', 'g') as esc_role from m
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(16 + length(esc_role) + length(esc)) + 7 as bigint) as formatted_chars, 0::bigint as n_attachments, 0::bigint as expanded_tokens
from e group by conv_id
"""
