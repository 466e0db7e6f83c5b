"""Chat formatting from an event log: fold events into final messages, then render and mark the loss.

The log is partitioned by conversation and sorted by sequence. A message is built from its events:
``message`` and ``edit`` set its text, ``delta`` appends to it, ``regenerate`` empties it (its later
deltas build it anew), ``delete`` removes it. Messages are folded one by one, so a long conversation
is many small groups; only its rendering, one row of output, needs it whole.

Turns are marked by control strings. Those of ``CONTROLS`` inside roles and texts get a backslash
behind their first character, backslashes are doubled before, so a reader gets back every text.

Cases: null texts and roles are empty; events with equal sequence keep the order of kind, then text;
messages that begin at one sequence are ordered by role, then text; a null conversation id is a
conversation of its own; an event of an unknown kind appends its text; an empty log gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates.
CONTROLS = (OPEN, CLOSE, "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
_ANY = re.compile("|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in sorted(CONTROLS, key=len, reverse=True)))
_BACK = re.compile(r"\\(\\|n|)")


def escape(text: str) -> str:
    return _ANY.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def unescape_role(role: str) -> str:
    return _BACK.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (in code points) of the texts to learn."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{CLOSE}\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line + 1)
        turns.append((unescape_role(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(CLOSE) + 1
    return turns


def fold_events(log: DataFrame) -> DataFrame:
    """Final messages ``conv_id, place, role, text`` of a log ``conv_id, message, seq, kind, role, text``."""
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    folded = log.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("e"))
    resets = F.transform("e", lambda x, i: F.when(x["kind"].isin("message", "edit", "regenerate"), i).otherwise(0))
    pieces = F.filter(F.slice("e", F.array_max(resets) + 1, F.size("e")), lambda x: x["kind"] != "regenerate")
    roles = F.filter("e", lambda x: x["role"].isNotNull())
    return folded.where(~F.exists("e", lambda x: x["kind"] == "delete")).select(
        "conv_id",
        F.col("e")[0]["seq"].alias("place"),
        F.coalesce(F.get(roles, F.lit(0))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("text"),
    )


def format_conversations(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """``conv_id, n_turns, formatted, loss`` (spans to learn) for messages ``conv_id, place, role, text``."""
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    turns = turns.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))
    id_type = dict(messages.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [render(list(zip(r, t)), trained) for r, t in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist())]
            spans = [[{"start": a, "stop": b} for a, b in spans] for _, spans in out]
            columns = [
                batch.column("conv_id"), pa.array([len(x) for x in batch.column("roles").to_pylist()], pa.int64()),
                pa.array([f for f, _ in out], pa.string()), pa.array(spans, pa.list_(pa.struct({"start": pa.int64(), "stop": pa.int64()}))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "formatted", "loss"])

    return turns.mapInArrow(run, f"conv_id {id_type}, n_turns long, formatted string, loss array<struct<start:long,stop:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, roles, texts, loss_texts, formatted_chars`` as a reader of the output sees them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"roles": [], "texts": [], "loss_texts": [], "formatted_chars": []}
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                turns = parse(text)
                out["roles"].append([r for r, _ in turns])
                out["texts"].append([t for _, t in turns])
                out["loss_texts"].append([unescape(text[s["start"] : s["stop"]]) for s in spans])
                out["formatted_chars"].append(len(text))
            kinds = [pa.list_(pa.string())] * 3 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], names=["conv_id", *out])

    id_type = dict(formatted.dtypes)["conv_id"]
    schema = f"conv_id {id_type}, roles array<string>, texts array<string>, loss_texts array<string>, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, schema)


def log_of_turns(rows: DataFrame, piece: int = 512) -> DataFrame:
    """A table of turns (``conv_id, turn, role, text``) as the log that would have written it: each
    row opens a message and streams its text in deltas of ``piece`` characters."""
    text = F.coalesce("text", F.lit(""))
    numbered = rows.select("conv_id", "turn", "role", text.alias("text"), F.monotonically_increasing_id().alias("message"))
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / F.lit(piece)), F.lit(1)).cast("int"))
    events = numbered.select("conv_id", "turn", "role", "text", "message", F.explode(cuts).alias("_n"))
    part = F.when(F.col("_n") == 0, F.lit("")).otherwise(F.col("text").substr((F.col("_n") - 1) * piece + 1, F.lit(piece)))
    kind: Column = F.when(F.col("_n") == 0, "message").otherwise("delta")
    return events.select("conv_id", "message", F.struct("turn", F.col("_n").alias("n")).alias("seq"), kind.alias("kind"), "role", part.alias("text"))
