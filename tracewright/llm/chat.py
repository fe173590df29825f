"""Chat formatting: typed content parts, flattened into a template that can be read back. Column expressions only.

A turn is `<|turn|>role<|body|>text<|end|>` and a conversation its turns one after the other. Control strings inside
roles and texts are escaped by a backslash after their first character; where backslashes stand there already, one
more is put in, so that escaping can always be undone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: What may not stand raw in a role or text, besides this template's own marks: first character, rest.
CONTROL = r"(<|\[)(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"(<|\[)\\(\\*)(\||/?s>|/?INST\])"
#: Tokens that an attachment expands to: side of an image patch, tokens of a second of audio and of a page.
PATCH, PER_SECOND, PER_PAGE = 14, 25, 800
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _image(p: Column) -> Column:
    side = lambda n: F.ceil(F.coalesce(n, F.lit(0)) / F.lit(PATCH))
    return side(p["width"]) * side(p["height"])


def _audio(p: Column) -> Column:
    return F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * F.lit(PER_SECOND))


def _document(p: Column) -> Column:
    return (F.coalesce(p["pages"], F.lit(0)) * F.lit(PER_PAGE)).cast("long")


#: The visitor: what each type of attachment expands to. Text is visited by itself.
VISITOR: dict[str, Callable[[Column], Column]] = {"image": _image, "audio": _audio, "document": _document}


def flatten_parts(parts: Column) -> Column:
    """Flattens typed parts (an array of PART) into struct<text, attachments array<struct<place, type, ref, tokens>>>.

    Text parts stand as they are, escaped. Attachments become `<|type:place|>`, placed from 0 in order; their reference
    and the tokens that they expand to are recorded. A null array or part, and a part of an unknown or null type, gives
    nothing; a null text is empty; missing sizes count as 0.
    """
    known = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: F.coalesce(p["type"].isin("text", *VISITOR), F.lit(False)))
    attached = F.filter(known, lambda p: p["type"] != "text")

    def tokens(p: Column) -> Column:
        out = F.lit(0).cast("long")
        for kind, of in VISITOR.items():
            out = F.when(p["type"] == kind, of(p).cast("long")).otherwise(out)
        return out

    shown = F.transform(
        known,
        lambda p, i: F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<|"), p["type"], F.lit(":"), F.size(F.filter(F.slice(known, 1, i), lambda q: q["type"] != "text")).cast("string"), F.lit("|>"))
        ),
    )
    refs = F.transform(attached, lambda p, i: F.struct(i.alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    return F.struct(F.concat_ws("", shown).alias("text"), refs.alias("attachments"))


def text_part(text: Column) -> Column:
    """An array of one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null.alias("ref"), null.alias("width"), null.alias("height"), null.alias("seconds"), null.alias("pages")).cast(PART))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None) -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments) of each conversation.

    rows: a row per turn. parts: a column of typed parts; by default the column `text` as one text part, a null text being
    empty. Turns are ordered by turn (nulls first), then role and parts as they are given, byte by byte, so ties and
    repeated rows have one order and all stay. A null
    role is empty. Rows with a null conv_id make up one conversation. loss_spans: the places (from 1) and lengths, in
    code points, of the assistant's texts in `formatted`. A conversation's turns meet in one row, as its text has to.
    """
    given = parts if parts is not None else text_part(F.col("text"))
    one = rows.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), given.alias("parts")).alias("t"))
    grouped = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("said"))
    flat = grouped.select("conv_id", "said", F.transform("said", lambda t: flatten_parts(t["parts"])).alias("flat"))
    all_turns = flat.select("conv_id", F.zip_with("said", "flat", lambda t, f: F.struct(t["role"].alias("role"), f["text"].alias("text"), f["attachments"].alias("attachments"))).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY))
    shown = F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(END)))
    lengths = all_turns.select("conv_id", "turns", F.concat_ws("", shown).alias("formatted"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.length(head(t)).alias("head"), F.length(t["text"]).alias("n"))).alias("sizes"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        own = F.array(F.struct((acc["at"] + s["head"]).alias("start"), s["n"].alias("length")))
        return F.struct((acc["at"] + s["head"] + s["n"] + len(END)).alias("at"), F.when(s["role"] == "assistant", F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return lengths.select("conv_id", "formatted", F.aggregate("sizes", start, step, lambda acc: acc["spans"]).alias("loss_spans"), F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p, i: i > 0)  # nothing stands before the first mark

    def one(p: Column) -> Column:
        role = F.substring_index(p, BODY, 1)
        rest = F.substr(p, F.length(role) + F.lit(1 + len(BODY)))
        return F.struct(unescape(role).alias("role"), unescape(F.substring_index(rest, END, 1)).alias("text"))

    return F.transform(pieces, one)


def masked_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"], s["length"]))))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what can be read back from formatted conversations: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    joined = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
