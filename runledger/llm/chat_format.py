"""Formatting conversations by a compiled template, with masks of generated text, and reading them back.

Control strings start with `<` or `[`. Texts and roles are escaped so that neither occurs in them, reversibly.
Rows are dealt by conversation and sorted by turn; each conversation streams through the template, and its
output is cut into parts at turn ends, so memory holds one turn and one part whatever a conversation's length.

Defined results: null texts and roles count as empty; rows with null conv_id are one conversation; rows of
equal turn go by role and text; a null turn comes first; a conversation of no rows does not exist; only
conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .chat_template import BEGIN, END, TEXT, compile_template

#: A part ends with the first turn that takes it to this many characters.
PART_CHARS = 100_000

TEMPLATE = (
    "{%- for m in messages -%}"
    "{%- if m.role == 'user' -%}[INST]{{ m.text | escape }}[/INST]"
    "{%- elif m.role == 'assistant' -%}<s>{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{%- else -%}[TURN]{{ m.role | escape }}[TEXT]{{ m.text | escape }}[/TURN]"
    "{%- endif -%}{%- endfor -%}"
)
_TURN = re.compile(r"\[INST\](?P<user>[^\[<]*)\[/INST\]|<s>(?P<assistant>[^\[<]*)</s>|\[TURN\](?P<role>[^\[<]*)\[TEXT\](?P<text>[^\[<]*)\[/TURN\]")

PARTS = "conv_id string, part long, formatted string, spans array<struct<start: long, end: long>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\lb])", lambda m: {"\\": "\\", "l": "<", "b": "["}[m[1]], text)


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of rows with equal keys, across batches; a null key equals a null."""
    rows = (r for b in batches for r in b.astype(object).where(b.notna(), None).itertuples(index=False))
    return itertools.groupby(rows, key=lambda r: getattr(r, key))


def parts_of(messages: Iterator[dict], template: str, part_chars: int = PART_CHARS) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(text, spans): consecutive parts of one conversation's output; spans are code points within the part."""
    render = compile_template(template, {"escape": lambda v: escape(v or "")})
    buffer: list[str] = []
    spans: list[tuple[int, int]] = []
    size, begun, turn_over = 0, None, False

    def watched() -> Iterator[dict]:  # the template asks for a message when it is done with the last but one
        nonlocal turn_over
        for m in messages:
            yield m
            turn_over = True

    for kind, text in render({"messages": watched()}):
        if turn_over and begun is None and size >= part_chars and kind != END and "".join(buffer[-1:]).endswith(("[/INST]", "</s>", "[/TURN]")):
            yield "".join(buffer), spans
            buffer, spans, size = [], [], 0
        turn_over = False if kind == TEXT else turn_over
        if kind == TEXT:
            buffer.append(text)
            size += len(text)
        elif kind == BEGIN:
            begun = size
        else:
            spans.append((begun, size))
            begun = None
    yield "".join(buffer), spans


def format_conversations(rows: DataFrame, template: str = TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part, formatted, spans (of generated text within the part), in the order of parts within each partition."""
    shared.small_batches(rows.sparkSession)

    def formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for conv_id, own in _groups(batches, "conv_id"):
            messages = ({"role": r.role or "", "text": r.text or ""} for r in own)
            for n, (text, spans) in enumerate(parts_of(messages, template, part_chars)):
                made = pd.DataFrame({"conv_id": [conv_id], "part": [n], "formatted": [text]})
                made["spans"] = [[{"start": a, "end": b} for a, b in spans]]
                yield made

    # ids as text: pandas would make floats of ids beside nulls
    dealt = rows.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "role", "text")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(_merged(formatted), PARTS).withColumn("conv_id", F.col("conv_id").cast("long"))


def _merged(make):
    """Small frames put together by the hundred."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = make(batches)
        while some := list(itertools.islice(made, 100)):
            yield pd.concat(some, ignore_index=True)

    return run


def turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, unescaped. Raises ValueError where the output is no sequence of turns."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = m.lastgroup if m.lastgroup != "text" else unescape(m["role"])
        yield role, unescape(m[m.lastgroup])
        at = m.end()


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation, read from the parts that format_conversations made, in their order."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for conv_id, own in _groups(batches, "conv_id"):
            n_turns, loss_chars, chars = 0, 0, 0
            of_turns, of_loss = hashlib.sha256(), hashlib.sha256()
            for p in own:
                chars += len(p.formatted)
                for role, text in turns(p.formatted):
                    n_turns += 1
                    of_turns.update(f"{role}\n{text}\n".encode())
                for s in p.spans:
                    text = unescape(p.formatted[s["start"] : s["end"]])
                    loss_chars += len(text)
                    of_loss.update(text.encode())
            row = [conv_id, n_turns, of_turns.hexdigest(), loss_chars, of_loss.hexdigest(), chars]
            yield pd.DataFrame([row], columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    named = parts.withColumn("conv_id", F.col("conv_id").cast("string"))
    digests = named.mapInPandas(_merged(digest), "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return digests.withColumn("conv_id", F.col("conv_id").cast("long"))


#: A conversation whose texts hold control strings.
PLANTED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(planted)))


#: loss and turn digests from the rows; the lengths added by markers and escapes are counted.
SQL = r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g')) as n_text, length(role) + length(regexp_replace(role, '[^<\[\\]', '', 'g')) as n_role from r)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(n_text + case role when 'user' then 13 when 'assistant' then 7 else n_role + 19 end)::bigint as formatted_chars
from e group by conv_id
"""
