"""Chat formatting with a grammar round trip, in DataFrame expressions only.

Template, one turn after the other:

    turn     := "<s>" mark role "\\n" text "</s>"
    mark     := "" | "~"          (~: text is escaped)
    user     := text in "[INST] " ... " [/INST]", other roles as they are

The parser cuts at "<s>", drops the "</s>" that ends a turn, reads the mark
and the role up to the first line break, and takes user texts out of their
brackets.  A turn is rendered plainly first and parsed again; where what comes
back is not what went in, the turn is rendered with control strings escaped
("~" as ~0, "<" as ~1, "[" as ~2, and for roles the line break as ~3).  Then
the conversation is rendered as a whole, parsed again and compared turn by turn
with its source; if any turn differs, all turns are escaped, and that is parsed
and compared as well: a text that would still differ stops the query.  What is
reported is read from the rendered text.

Null text or role counts as empty.  Rows of a conversation are ordered by
turn, a null turn first, then by role and text; repeated rows stay, as
repeated turns.  A null conv_id is a conversation of its own.  A conversation
becomes one rendered string, so it must fit a row, as any document must; very
long texts cost time in proportion.  An empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, OPEN, CLOSE = "<s>", "</s>", "[INST] ", " [/INST]"
#: Roles whose text carries loss.
LOSS = ("assistant",)


def _replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape(c: Column) -> Column:
    return _replaced(c, ("~", "~0"), ("<", "~1"), ("[", "~2"), ("\n", "~3"))


def unescape(c: Column) -> Column:
    return _replaced(c, ("~3", "\n"), ("~2", "["), ("~1", "<"), ("~0", "~"))


def _body(role: Column, text: Column) -> Column:
    return F.when(role == "user", F.concat(F.lit(OPEN), text, F.lit(CLOSE))).otherwise(text)


def plain(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), _body(role, text), F.lit(END))


def escaped(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START + "~"), escape(role), F.lit("\n"), _body(role, escape(text)), F.lit(END))


def parse(rendered: Column) -> Column:
    """Turns of a rendered text: array of (role, text)."""
    parts = F.filter(F.split(rendered, START, -1), lambda p, k: k > 0)

    def turn(part: Column) -> Column:
        # A turn ends with END; anything else is not of this grammar and shows as a different text.
        inner = F.when(F.endswith(part, F.lit(END)), F.substring(part, F.lit(1), F.length(part) - len(END))).otherwise(part)
        marked = F.startswith(inner, F.lit("~"))
        inner = F.when(marked, F.substring(inner, F.lit(2), F.length(inner))).otherwise(inner)
        cut = F.instr(inner, "\n")
        role = F.substring(inner, F.lit(1), F.greatest(cut - 1, F.lit(0)))
        role = F.when(marked, unescape(role)).otherwise(role)
        text = F.substring(inner, cut + 1, F.length(inner))
        text = F.when((role == "user") & F.startswith(text, F.lit(OPEN)) & F.endswith(text, F.lit(CLOSE)), F.substring(text, F.lit(len(OPEN) + 1), F.length(text) - len(OPEN + CLOSE))).otherwise(text)
        return F.struct(role.alias("role"), F.when(marked, unescape(text)).otherwise(text).alias("text"))

    return F.transform(parts, turn)


def render_turns(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with `rendered`: plain where the round trip is exact, else escaped."""
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("as_plain", plain(F.col("role"), F.col("text")))
    # The turn's own text must come back from the grammar alone: it holds no start, no end but the last, and reads as the same role and text.
    back = parse(F.col("as_plain"))
    same = (F.size(back) == 1) & (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text")) & ~F.contains("text", F.lit(END)) & ~F.contains("role", F.lit(END)) & ~F.contains("text", F.lit("[/INST]"))
    # A text that ends like the beginning of a mark could join up with what follows it.
    same &= ~F.rlike("text", F.lit(r"<(/?s?)?\z"))
    return rows.withColumn("rendered", F.when(same, F.col("as_plain")).otherwise(escaped(F.col("role"), F.col("text")))).drop("as_plain")


def format_chat(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted): the whole rendered text of each conversation, which reads back as its turns."""
    rows = render_turns(conversations)
    turns = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), "role", "text", "rendered")))
    # Step by step in columns, so that nothing is rendered or parsed twice.
    out = rows.groupBy("conv_id").agg(turns.alias("turns")).withColumn("formatted", F.array_join("turns.rendered", ""))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    out = out.withColumn("exact", parse(F.col("formatted")) == source)
    out = out.withColumn("formatted", F.when(F.col("exact"), F.col("formatted")).otherwise(F.array_join(F.transform("turns", lambda t: escaped(t["role"], t["text"])), "")))
    lost = F.raise_error(F.concat(F.lit("the turns of a conversation do not come back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("string")
    return out.select("conv_id", F.when(F.col("exact"), F.col("formatted")).when(parse(F.col("formatted")) == source, F.col("formatted")).otherwise(lost).alias("formatted"))


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from each formatted text."""
    read = formatted.select("conv_id", parse(F.col("formatted")).alias("turns"), F.length("formatted").cast("long").alias("formatted_chars"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"].isin(*LOSS)), lambda t: t["text"]), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
