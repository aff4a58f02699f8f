"""Chat formatting: turns of typed content parts become one marked-up string per conversation.

A visitor walks each turn's parts in order and flattens them: text is escaped, and images, audio and
documents become numbered placeholders. For each of those it records the reference, the place in the
output and the tokens that the placeholder stands for, by size:

    image     one token for each started patch of 14 x 14 pixels, and one to end it
    audio     one token for each started 40 ms
    document  one header token and, for each page, tokens_per_page

The template is ``<turn role>`` + text + ``</turn>`` + newline. Inside texts and roles the signs that
can start a control string are replaced, so that no text can end or begin a turn: ``\\`` by ``\\e``,
``<`` by ``\\l``, ``>`` by ``\\g`` and ``#`` by ``\\h``. Every backslash of the output begins one of these, which makes
the way back exact. The loss mask covers the text parts of assistant turns, without the placeholders between them.

All of it is DataFrame functions. A conversation is put together from chunks of consecutive turn
numbers, and places are running sums in windows, so that a very long one is sorted and joined in parts
and in time proportional to its length; only its own row holds all of it.

Defined cases: null text, role or part is empty; turns go by number, nulls first, then role and marked-up
text; repeated rows are repeated turns; a null conversation number is a conversation; part types that are
not known become ``<unknown n>`` with no tokens; very long texts and conversations are like any; an
empty table gives no row; other columns are not read, whatever their names.

The driver's table holds texts only. So that every kind of part runs, the query gives turns attachments by a fixed
rule (``sample_parts``); their placeholders stand beside the text and outside of the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

PART = "struct<type:string,text:string,ref:string,width:int,height:int,millis:long,pages:int>"
# fixed values: sign and what stands for it inside texts
ESCAPES = [("\\", "\\e"), ("<", "\\l"), (">", "\\g"), ("#", "\\h")]
CHUNK = 64


def escape(c: Column) -> Column:
    for sign, code in ESCAPES:
        c = F.replace(c, F.lit(sign), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for sign, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(sign))
    return c


def part(kind: str, **fields: Column) -> Column:
    """One part; fields that are not given are null."""
    types = {"text": "string", "ref": "string", "width": "int", "height": "int", "millis": "long", "pages": "int"}
    return F.struct(F.lit(kind).alias("type"), *[fields.get(f, F.lit(None)).cast(t).alias(f) for f, t in types.items()])


def text_part(text: Column) -> Column:
    """An array with one text part."""
    return F.array(part("text", text=text))


def sample_parts(text: Column, ref: Column) -> Column:
    """Typed parts of a turn by the length of its text n, by n modulo 4: text and an image, audio and text, a document between
    the halves of the text, or text alone. The text parts together are the text."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    half = F.floor(n / 2).cast("int")
    image = part("image", ref=F.concat(ref, F.lit(".png")), width=n + 1, height=n % 100 + 1)
    audio = part("audio", ref=F.concat(ref, F.lit(".ogg")), millis=n * 60)
    document = part("document", ref=F.concat(ref, F.lit(".pdf")), pages=n % 7)
    return (
        F.when(n % 4 == 0, F.array(part("text", text=t), image))
        .when(n % 4 == 1, F.array(audio, part("text", text=t)))
        .when(n % 4 == 2, F.array(part("text", text=F.substr(t, F.lit(1), half)), document, part("text", text=F.substr(t, half + 1))))
        .otherwise(text_part(t))
    )


def part_tokens(p: Column, tokens_per_page: int = 500) -> Column:
    patches = F.ceil(F.coalesce(p["width"], F.lit(0)) / 14) * F.ceil(F.coalesce(p["height"], F.lit(0)) / 14)
    return (
        F.when(p["type"] == "image", patches + 1)
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["millis"], F.lit(0)) / 40))
        .when(p["type"] == "document", 1 + F.coalesce(p["pages"], F.lit(0)) * tokens_per_page)
        .otherwise(0)
        .cast("long")
    )


SPANS = "array<struct<at:long,chars:long>>"
SEEN = "array<struct<type:string,ref:string,at:long,tokens:long>>"


def visit(parts: Column) -> Column:
    """Flatten one turn's parts: struct(out string, texts, attachments).

    texts: struct(at, chars) of the text parts in out; attachments: struct(type, ref, at, tokens), at the
    placeholder's place. Places are code points. Numbers count attachments of a turn.
    """

    def step(acc: Column, p: Column) -> Column:
        kind = F.coalesce(p["type"], F.lit("text"))
        is_text = kind == "text"
        name = F.when(kind.isin("image", "audio", "document"), kind).otherwise("unknown")
        mark = F.concat(F.lit("<"), name, F.lit(" "), (F.size(acc["attachments"]) + 1).cast("string"), F.lit(">"))
        body = F.when(is_text, escape(F.coalesce(p["text"], F.lit("")))).otherwise(mark)
        at = F.length(acc["out"]).cast("long")
        seen = F.struct(kind.alias("type"), p["ref"].alias("ref"), at.alias("at"), part_tokens(p).alias("tokens"))
        text = F.struct(at.alias("at"), F.length(body).cast("long").alias("chars"))
        return F.struct(
            F.concat(acc["out"], body).alias("out"),
            F.when(is_text, F.concat(acc["texts"], F.array(text))).otherwise(acc["texts"]).alias("texts"),
            F.when(is_text, acc["attachments"]).otherwise(F.concat(acc["attachments"], F.array(seen))).alias("attachments"),
        )

    zero = F.struct(F.lit("").alias("out"), F.array().cast(SPANS).alias("texts"), F.array().cast(SEEN).alias("attachments"))
    return F.aggregate(F.coalesce(parts, F.array().cast(f"array<{PART}>")), zero, step)


def _moved(spans: Column, by: Column, *fields: str) -> Column:
    return F.transform(spans, lambda s: F.struct(*[(s[f] + by if f == "at" else s[f]).alias(f) for f in fields]))


def _shifted(df: DataFrame, by: Column) -> DataFrame:
    return df.withColumns({"loss": _moved(F.col("loss"), by, "at", "chars"), "seen": _moved(F.col("seen"), by, "type", "ref", "at", "tokens")})


def render(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per turn: conv_id, turn, role, formatted, and its loss spans and attachments (seen), placed in formatted."""
    who = F.coalesce(F.col(role), F.lit(""))
    seen = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"), visit(F.col(parts)).alias("v"))
    head = F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">"))
    loss = F.when(F.col("role") == "assistant", F.col("v.texts")).otherwise(F.array().cast(SPANS))
    out = seen.select("conv_id", "turn", "role", F.concat(head, F.col("v.out"), F.lit("</turn>\n")).alias("formatted"), head.alias("head"), loss.alias("loss"), F.col("v.attachments").alias("seen"))
    return _shifted(out, F.length("head")).drop("head")


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, expanded_tokens.

    loss_spans: struct(at, chars) of the assistant's text parts in formatted, in code points. attachments: struct(type,
    ref, at, tokens), placed alike. expanded_tokens: what all placeholders stand for.
    """
    one = render(turns, conv, turn, role, parts).withColumn("part", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 60))))
    chunk = _together(one, ["conv_id", "part"], ["turn", "role", "formatted"])
    whole = _together(chunk, ["conv_id"], ["part"])
    return whole.select(
        "conv_id",
        "formatted",
        F.col("loss").alias("loss_spans"),
        F.col("seen").alias("attachments"),
        F.aggregate("seen", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("expanded_tokens"),
    )


def _together(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """formatted, loss and seen of the rows of a key in a row, in order."""
    by = Window.partitionBy(*keys).orderBy(*order)
    start = F.coalesce(F.sum(F.length("formatted")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumns({"n": F.row_number().over(by), "start": start})
    got = _shifted(placed, F.col("start")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("n", "formatted", "loss", "seen"))).alias("rs"))
    field = lambda f: F.transform("rs", lambda r: r[f])
    return got.select(*keys, F.concat_ws("", field("formatted")).alias("formatted"), F.flatten(field("loss")).alias("loss"), F.flatten(field("seen")).alias("seen"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role,text>>, without the placeholders.

    No text holds an unescaped sign, so the end mark parts turns, the first '>' ends a turn's head, and
    what else stands between '<' and '>' is a placeholder.
    """
    bodies = F.split(formatted, "</turn>\n")
    bodies = F.slice(bodies, 1, F.greatest(F.size(bodies) - 1, F.lit(0)))
    return F.transform(
        bodies,
        lambda b: F.struct(
            unescape(F.substring_index(F.substring(b, 7, 1 << 30), ">", 1)).alias("role"),
            unescape(F.regexp_replace(F.substr(b, F.instr(b, ">") + 1), "<[^>]*>", "")).alias("text"),
        ),
    )


def under(formatted: Column, spans: Column) -> Column:
    """The texts of formatted under spans, unescaped. The string is laid out in four bytes a code point, so that a span
    is found without a walk from the start."""
    wide = F.array(F.encode(formatted, "UTF-32"))

    def cut(w: Column) -> Column:
        piece = lambda s: F.decode(F.substring(w, (4 * s["at"] + 1).cast("int"), (4 * s["chars"]).cast("int")), "UTF-32")
        return F.transform(spans, lambda s: unescape(piece(s)))

    return F.flatten(F.transform(wide, cut))


def digest(done: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted strings and the loss spans."""
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        done.withColumns({"turns": read_back(F.col("formatted")), "loss_text": F.concat_ws("", under(F.col("formatted"), F.col("loss_spans")))})
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.concat_ws("", said).cast("binary"), 256).alias("turns_sha256"),
            F.length("loss_text").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            F.size("attachments").cast("long").alias("n_attachments"),
            "expanded_tokens",
            F.sha2(F.concat_ws("\n", F.transform("attachments", lambda p: F.concat_ws(" ", p["type"], p["ref"], p["tokens"].cast("string")))).cast("binary"), 256).alias("attachments_sha256"),
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    ref = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    turns = rows.unionByName(extra).withColumn("parts", sample_parts(F.col("text"), ref))
    return digest(conversations(turns))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), p AS (
  SELECT *, length(text)::BIGINT AS n, concat_ws('-', conv_id::VARCHAR, turn::VARCHAR) AS ref,
    replace(replace(replace(replace(text, '\', '\e'), '<', '\l'), '>', '\g'), '#', '\h') AS said,
    replace(replace(replace(replace(role, '\', '\e'), '<', '\l'), '>', '\g'), '#', '\h') AS who FROM t
), e AS (
  SELECT *, CASE n % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' WHEN 2 THEN 'document' END AS kind,
    CASE n % 4 WHEN 0 THEN (n + 1 + 13) // 14 * ((n % 100 + 1 + 13) // 14) + 1 WHEN 1 THEN (n * 60 + 39) // 40 WHEN 2 THEN 1 + n % 7 * 500 ELSE 0 END AS tokens,
    CASE n % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.ogg' WHEN 2 THEN '.pdf' END AS ending,
    '<turn ' || who || '>' || CASE n % 4 WHEN 0 THEN said || '<image 1>' WHEN 1 THEN '<audio 1>' || said WHEN 2 THEN '<document 1>' || said ELSE said END || '</turn>' || chr(10) AS line FROM p
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, line)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, line), '')) AS loss_sha256,
  sum(length(line))::BIGINT AS formatted_chars,
  count(kind)::BIGINT AS n_attachments, sum(tokens)::BIGINT AS expanded_tokens,
  sha256(coalesce(string_agg(kind || ' ' || ref || ending || ' ' || tokens::VARCHAR, chr(10) ORDER BY turn NULLS FIRST, role, line), '')) AS attachments_sha256
FROM e GROUP BY conv_id
"""
