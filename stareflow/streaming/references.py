"""References stripped from an answer while it streams: nothing of a reference is ever shown.

A reference may be split anywhere between chunks, so a key's state is the end of its text that later
chunks can still change: an open bracket pair and the word that it stands in, or the last word. What is
shown, chunk after chunk, is what operators.sequences.without_references() leaves of the whole text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

# Whole references, what is left of broken ones, and white space, all as Spark's expressions have them.
WHOLE = re.compile(r"\[\[(?:(?!\[\[)[^\n])*?\]\]")
BROKEN = re.compile(r"\[\[\S*|\S*\]\]", re.ASCII)
SPACE = " \t\n\r\f\v"

OUT = "stream_id string, seq long, shown string"


def settled_until(text: str) -> int:
    """Up to where no further text can change what is shown: a place behind white space, outside whole references,
    with no pair open before it on its line."""
    whole = [m.span() for m in WHOLE.finditer(text)]
    line = max(text.rfind("\n") + 1, whole[-1][1] if whole else 0)
    open_ = text.rfind("[[", line)
    at = len(text) if open_ < 0 else open_
    while True:
        while at and text[at - 1] not in SPACE:
            at -= 1
        inside = next((s for s, e in whole if s < at < e), None)
        if inside is None:
            return at
        at = inside


def shown(text: str) -> str:
    return BROKEN.sub("", WHOLE.sub("", text))


def fed(held: str, chunk: str, last: bool) -> tuple[str, str]:
    """(shown, held) when a chunk comes; with the last one nothing is held back."""
    text = held + chunk
    at = len(text) if last else settled_until(text)
    return shown(text[:at]), text[at:]


def stripped_stream(chunks: DataFrame) -> DataFrame:
    """chunks(stream_id, seq, text, last) as (stream_id, seq, shown), a row for each chunk. A stream's chunks arrive in
    order of seq; last is true for the end of a stream, which shows what was held back. A null text is empty."""

    def step(key, frames, state):
        held = state.get[0] if state.exists else ""
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for text, last in zip(rows["text"], rows["last"], strict=True):
            said, held = fed(held, text if isinstance(text, str) else "", bool(last))
            out.append(said)
        if len(rows) and bool(rows["last"].iloc[-1]):
            if state.exists:
                state.remove()
        else:
            state.update((held,))
        yield pd.DataFrame({"stream_id": key[0], "seq": rows["seq"].to_numpy(), "shown": out})

    return chunks.groupBy("stream_id").applyInPandasWithState(step, OUT, "held string", "append", GroupStateTimeout.NoTimeout)
