"""Chat formatting with typed content parts and reversible escapes.

Template of a turn: ``<|turn|>role LF content <|end|> LF``. A visitor walks a turn's parts (text, image, audio, document) in
order: text is escaped, any other part becomes a placeholder ``<|image:0|>`` whose number points into the turn's
``attachments`` (kind, number, reference, expanded tokens). Control strings inside texts and roles are replaced by an escape
letter and a number, the escape letter itself first, so unescaping gives back every text. Content of assistant turns
is under the loss mask, placeholders excepted.

Nulls: a null text is empty, a null or unknown part type counts as text, a null role is an empty role, null conv_id is one
conversation, null turns sort first. Ties of turn are put in order of role, then text; repeated rows stay. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import small_batches

ESCAPE = "␛"
#: Strings with a meaning in this or a common other template; their number after the escape letter is their place here + 1.
CONTROL = ("<|", "|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
TURN, END = "<|turn|>", "<|end|>\n"
#: Tokens of one unit (image tile, second of audio, page) of an attachment.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 640}
PART = "type string, text string, ref string, units long"
FACTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit(ESCAPE), F.lit(f"{ESCAPE}0"))
    for i, c in enumerate(CONTROL):
        out = F.replace(out, F.lit(c), F.lit(f"{ESCAPE}{i + 1}"))
    return out


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit(f"{ESCAPE}9"))


def unescape(text: str) -> str:
    """Inverse of ``escaped`` and ``escaped_role``."""
    if ESCAPE not in text:
        return text
    words = (ESCAPE, *CONTROL, "\n")
    return re.sub(f"{ESCAPE}([0-9])", lambda m: words[int(m[1])], text)


def with_text_part(turns: DataFrame) -> DataFrame:
    """A plain ``text`` column as one text part."""
    part = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units"))
    return turns.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn (conv_id, turn, role, parts): ``segment``, ``attachments`` and expanded ``attachment_tokens``.

    A projection only: no row moves, whatever the length of a conversation.
    """
    kind = lambda p: F.when(p["type"].isin(*UNIT_TOKENS), p["type"]).otherwise("text")
    others = F.filter("parts", lambda p: kind(p) != "text")
    per_unit = lambda p: F.coalesce(*[F.when(p["type"] == k, F.lit(v)) for k, v in UNIT_TOKENS.items()])
    attachments = F.transform(
        others,
        lambda p, i: F.struct(p["type"].alias("kind"), i.alias("number"), p["ref"].alias("ref"), (per_unit(p) * F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(1))).cast("long").alias("tokens")),
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    visit = lambda s, p: F.when(kind(p) == "text", F.struct(F.concat(s["out"], escaped(p["text"])).alias("out"), s["n"].alias("n"))).otherwise(
        F.struct(F.concat(s["out"], F.lit("<|"), kind(p), F.lit(":"), s["n"].cast("string"), F.lit("|>")).alias("out"), (s["n"] + 1).alias("n"))
    )
    content = F.aggregate(F.coalesce("parts", F.array().cast(f"array<struct<{PART.replace(' ', ':').replace(',:', ',')}>>")), start, visit, lambda s: s["out"])
    return turns.select(
        "conv_id", "turn", "role",
        F.concat(F.lit(TURN), escaped_role(F.col("role")), F.lit("\n"), content, F.lit(END)).alias("segment"),
        F.coalesce(attachments, F.array()).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def plain_content(segment: Column) -> Column:
    """Content of formatted turns with the escapes undone: what ties are ordered by."""
    out = F.substr(segment, F.locate("\n", segment, len(TURN) + 1) + 1)
    out = F.substr(out, F.lit(1), F.length(out) - len(END))
    for i, c in reversed([*enumerate((ESCAPE, *CONTROL))]):
        out = F.replace(out, F.lit(f"{ESCAPE}{i}"), F.lit(c))
    return out


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and escaped content of one formatted turn."""
    if not (segment.startswith(TURN) and segment.endswith(END)):
        raise ValueError("not a formatted turn")
    role, content = segment[len(TURN) : -len(END)].split("\n", 1)
    return unescape(role), content


_PLACEHOLDER = re.compile(r"<\|[a-z]+:[0-9]+\|>")


def conversation_facts(formatted: DataFrame) -> DataFrame:
    """Read the formatted turns back, one row per conversation.

    Turns are sorted inside hash partitions of conv_id and digested as a stream, so a conversation of any length
    needs the memory of one batch; its digest is one chain by its nature and takes one task.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for b in small_batches(batches):
            for conv, segment in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if now is None or now[0] != conv:
                    if now:
                        done.append(_facts(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, content = parse_segment(segment)
                text = unescape(_PLACEHOLDER.sub("", content))
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += len(segment)
            if len(done) >= 1000:
                yield _batch(done)
                done = []
        if now:
            yield _batch([*done, _facts(now)])

    rows = formatted.select("conv_id", "segment", "turn", "role").repartition("conv_id")
    rows = rows.withColumn("plain", plain_content(F.col("segment")))
    return rows.sortWithinPartitions("conv_id", "turn", "role", "plain", "segment").select("conv_id", "segment").mapInArrow(digest, FACTS)


def _facts(x: list) -> tuple:
    return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
