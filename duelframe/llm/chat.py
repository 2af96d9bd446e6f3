"""Conversations as training texts, by a compiled template, with the spans that are learned.

Rows are dealt out by conversation and sorted by turn; a task renders its conversations as a
stream and writes each in parts of whole turns, so that neither a long conversation nor its
text is ever held. Control strings inside texts are escaped reversibly: ``digests`` reads turns
and marked text back from the stored parts alone.

Turns are ordered null first, then ascending, rows of one turn by role and text. Null roles and
texts are empty. Rows with a null conversation id form one conversation. Repeated rows are
turns of their own. Other columns are left aside, whatever their names. Empty in, empty out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stream
from .templates import Output, Template, escaper

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
escape, unescape = escaper(CONTROLS)
#: Marks every turn; the model learns the assistant's texts.
INSTRUCT = """
{#- users ask between marks, the assistant's text ends in one, other roles are named -#}
{{ '<s>' -}}
{% for m in messages -%}
  {% if m.role == 'user' -%} [INST] {{ m.text | escape }} [/INST]
  {%- elif m.role == 'assistant' -%} {{ ' ' }}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>
  {%- else -%} [ROLE] {{ m.role | escape }} [/ROLE] {{ m.text | escape }}</s>
  {%- endif -%}
{% endfor -%}
"""
FILTERS = {"escape": escape, "trim": str.strip, "lower": str.lower, "upper": str.upper}
TURN = re.compile(r"\[INST\] (.*?) \[/INST\]|\[ROLE\] (.*?) \[/ROLE\] (.*?)</s>| (.*?)</s>", re.S)
#: Characters after which a part ends with its turn.
PART = 1 << 18
PARTS = "conv_id long, part long, formatted string, learned array<struct<start:long,end:long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def format_conversations(conversations: DataFrame, template: str = INSTRUCT, part: int = PART) -> DataFrame:
    """conv_id, part (from 0), formatted, learned: spans of characters in the part, end exclusive.

    A conversation's parts are its formatted text when joined. They come in order, all in one
    partition; only a stored copy has to be sorted again.
    """
    Template(template, FILTERS)  # raises here rather than in a task
    turns = conversations.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def parts(rows: Iterator[tuple]) -> Iterator[tuple]:
        compiled = Template(template, FILTERS)
        for conv_id, own in groupby(rows, key=lambda r: r[0]):
            out, n = Output(), 0
            for _ in compiled.render(({"role": role, "text": text} for _, role, text in own), out):
                if out.size >= part:
                    yield (conv_id, n, *_part(out))
                    n += 1
            if out.pieces or not n:
                yield (conv_id, n, *_part(out))

    return stream(ordered, parts, PARTS)


def _part(out: Output) -> tuple[str, list[dict]]:
    text, spans = out.take()
    return text, [{"start": a, "end": b} for a, b in spans]


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a part that INSTRUCT made."""
    at = 3 if formatted.startswith("<s>") else 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        user, role, other, assistant = m.groups()
        yield ("user", unescape(user)) if user is not None else ("assistant", unescape(assistant)) if assistant is not None else (unescape(role), unescape(other))
        at = m.end()


def digests(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """What INSTRUCT's parts say when read back: turns, learned text and sizes of each conversation.

    in_order: the parts come straight from format_conversations; else they are sorted first.
    """
    parts = formatted.select("conv_id", "part", "formatted", "learned")
    if not in_order:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def read(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, own in groupby(rows, key=lambda r: r[0]):
            turns, loss, n, n_loss, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, _, text, learned in own:
                size += len(text)
                for role, said in read_turns(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for span in learned:
                    said = unescape(text[span["start"] : span["end"]])
                    n_loss += len(said)
                    loss.update(said.encode())
            yield conv_id, n, turns.hexdigest(), n_loss, loss.hexdigest(), size

    return stream(parts, read, DIGESTS)
