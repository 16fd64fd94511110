"""Conversations as training text, by a compiled template with generation markers.

Control strings begin with ``<`` or ``[``. Inside texts and roles these two and
the backslash are preceded by a backslash, so no text can form a control string
and every text can be read back.

Defined results: a null text is empty, a null role is the empty role; turns are
ordered by (turn, role, text) with nulls first, so ties and repeated rows have a
fixed order and all stay; rows with a null conv_id are one conversation without
an id; an empty table gives an empty table. Only conv_id, turn, role and text
are read. A conversation is rendered as one text and has to fit in a task; how
often a text or a conversation repeats does not matter.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrade.llm.common import map_batches
from skygrade.llm.template import compile_template

#: ``<s>`` opens a turn, ``[INST]`` and ``[/INST]`` enclose its role, ``</s>`` ends it.
TEMPLATE = (
    "{% for m in messages %}{{ '<s>' }}[INST]{{ m.role | escape }}[/INST]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</s>{% endfor %}"
)

SPECIAL = re.compile(r"[\\<\[]")
TURN = re.compile(r"<s>\[INST\]((?:[^\\<\[]|\\.)*)\[/INST\]((?:[^\\<\[]|\\.)*)</s>", re.S)


def escape(text) -> str:
    return SPECIAL.sub(r"\\\g<0>", text or "")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns, at = [], 0
    for m in TURN.finditer(text):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"no turn at character {at}")
    return turns


def gathered(conversations: DataFrame) -> DataFrame:
    """One row per conversation with its turns in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


FORMATTED = "conv_id long, text string, loss array<struct<start:int,end:int>>"
LOSS_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def format_chats(conversations: DataFrame, template=TEMPLATE) -> DataFrame:
    """conv_id, formatted text, and the spans of it under the loss mask (code points, end exclusive)."""
    compile_template(template, {"escape": escape})  # a faulty template fails here, not in a task

    def run(batch):
        render = compile_template(template, {"escape": escape})
        made = [render(messages=turns) for turns in batch.column("turns").to_pylist()]
        spans = [[{"start": a, "end": b} for a, b in found] for _, found in made]
        return [batch.column("conv_id"), pa.array([t for t, _ in made], pa.string()), pa.array(spans, LOSS_TYPE)]

    return map_batches(gathered(conversations), run, FORMATTED)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What reads back from formatted conversations: turns, masked text and sizes, as digests."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def run(batch):
        rows = []
        for text, loss in zip(batch.column("text").to_pylist(), batch.column("loss").to_pylist()):
            turns = read_back(text)
            masked = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
            whole = "".join(f"{role}\n{said}\n" for role, said in turns)
            rows.append((len(turns), sha(whole), len(masked), sha(masked), len(text)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return [batch.column("conv_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))]

    return map_batches(
        formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
