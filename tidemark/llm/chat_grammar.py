"""Chat formatting with a grammar that is parsed back before it is trusted.

::

    conversation = turn*
    turn         = "### " label ": " body "</turn>\\n"
    label        = "User" | "Assistant" | "System" | "Other " name

Each turn is first rendered as it is and parsed again.  If the parser doesn't
recover exactly the role and text, the body conflicts with the grammar and is
escaped: a backslash before each backslash and inside each control string.  The
parser always drops one backslash before any sign, so it needs no flag.  At the
end the whole conversation is parsed and compared with its source once more.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>"
LABELS = {"user": "User", "assistant": "Assistant", "system": "System"}
OTHER = "Other "
#: What opens a turn, as a regular expression.
OPENING = r"### (?:User|Assistant|System|Other [^:\n]*): "


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(out, F.lit("### "), F.lit("#\\## "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def label_of(role: Column) -> Column:
    name = F.replace(F.replace(escape(role), F.lit(":"), F.lit("\\:")), F.lit("\n"), F.lit("\\n"))
    out = F.concat(F.lit(OTHER), F.replace(name, F.lit("\\:"), F.lit("\\.")))
    for raw, shown in LABELS.items():
        out = F.when(role == raw, F.lit(shown)).otherwise(out)
    return out


def _role_of(label: Column) -> Column:
    # In names "\\." is a colon and "\\n" a line end; all else is as in bodies.
    name = F.substr(label, F.lit(len(OTHER) + 1))
    out = F.regexp_replace(F.regexp_replace(name, r"(?<!\\)((?:\\\\)*)\\\.", "$1:"), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    out = unescape(out)
    for raw, shown in LABELS.items():
        out = F.when(label == shown, F.lit(raw)).otherwise(out)
    return out


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit("### "), label_of(role), F.lit(": "), body, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """Array of ``(role, text)``; what isn't a turn gives a null role."""
    closed = F.split(formatted, END + "\n")
    # What follows the last end is empty in a well-formed conversation.
    turns = F.filter(closed, lambda s: s != "")
    opened = F.flatten(F.transform(turns, lambda s: F.split(s, f"(?s)(?<=.)(?={OPENING})")))

    def turn(s: Column) -> Column:
        label = F.regexp_extract(s, r"^### ([^:]*): ", 1)
        return F.struct(
            F.when(s.rlike(f"^{OPENING}"), _role_of(label)).alias("role"),
            unescape(F.substr(s, F.length(label) + 7)).alias("text"),
        )

    return F.transform(opened, turn)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans``, one row per conversation.

    ``loss_spans`` lists (start, length) in code points of the bodies of
    ``loss_role`` in ``formatted``; text under it is still escaped.

    Turns are ordered by (turn, role, text).  Null role or text: empty.  Rows
    with a null ``conv_id`` form one conversation; repeated rows are repeated
    turns; other columns are ignored; an empty table gives no rows.  Raises if a
    conversation, once escaped, still differs from its source.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    source = F.array(F.struct("role", "text"))
    plain = parse(render(F.col("role"), F.col("text"))) == source
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", plain.alias("plain")))).alias("turns"))

    def shown(t: Column) -> Column:
        body = F.when(t.plain, t.text).otherwise(escape(t.text))
        return F.struct(t.role.alias("role"), F.length(body).alias("body_n"), render(t.role, body).alias("s"))

    convs = convs.withColumn("shown", F.transform("turns", shown))
    convs = convs.withColumn("formatted", F.array_join(F.transform("shown", lambda t: t.s), ""))
    recovered = parse(F.col("formatted"))
    given = F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    same = F.when(recovered == given, F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("no round trip: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    ends = F.aggregate(
        F.transform("shown", lambda t: F.struct(t.role.alias("role"), t.body_n.alias("body_n"), F.length(t.s).alias("n"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc.at + t.n).alias("at"),
            F.when(t.role == loss_role, F.concat(acc.spans, F.array(F.struct((acc.at + t.n - t.body_n - len(END) - 1).alias("start"), t.body_n.alias("length"))))).otherwise(acc.spans).alias("spans"),
        ),
    ).spans
    return convs.select("conv_id", same.alias("formatted"), ends.alias("loss_spans"))


def digest(formatted: DataFrame) -> DataFrame:
    """What the output says, read back from it alone."""
    turns = parse(F.col("formatted"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s.start + 1, s.length))), "")
    out = formatted.withColumn("turns", turns).withColumn("loss", loss)
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
