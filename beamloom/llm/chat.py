"""Chat formatting: schema fingerprints select declarative mappings into canonical turns; turns become marked text.

A record's fingerprint is a hash of its sorted nested field paths ("messages[].role"); fields that no layout knows don't
count. LAYOUTS declares, for each known set of paths, where turns, roles and texts are, and BY_FINGERPRINT finds a layout
by the hash; nothing else in the code knows a layout. Tables whose rows are turns are looked up by their schema's
fingerprint, JSON records each by their own. A record holds some turns of a conversation, the first of which is its
`turn` (0 where there is none), so a conversation of any length never has to be one record.

A turn is formatted as  <|turn|> role <|text|> text <|/turn|>  without the spaces. In roles and texts every backslash is
doubled and every control string (of this template and of other common ones) gets a backslash after its first
character, so no control string is left in them and unescaping (dropping each backslash that isn't doubled) restores
them. Formatting is row by row: a conversation of any length never has to fit in one task's memory. The loss mask is
the span of the escaped text of assistant turns, in code points of the turn's formatted text.

Defined results: a null text or role is empty; turns go by turn number (null first), ties by role and then text;
repeated rows are turns each; null conversation ids are one conversation; records of unknown layout or broken JSON give
one turn-less row each in unknown_records(); very long texts are formatted whole, in batches of bounded size; extra
columns are ignored, also those that clash with another layout's fields: a schema or record that has the fields of more
than one layout takes that with the most fields, the first declared among equals; empty tables give empty results. A
conversation's digest is sequential, so its turns stream through one task, in constant memory.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, new_path, sliced

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|/turn|>"
# Control strings of this and other templates.
CONTROL = (
    TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|startoftext|>",
    "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>",
)
_ESCAPED = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_PARSED = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """paths: the fields that must be there. Either `each` (a list of turns with `role` and `text` fields), or `parts`:
    (role, fields whose non-empty texts are joined by a blank line). key: a field with the conversation's id.
    optional: further fields that may be there; system: a field with a first system turn."""

    name: str
    paths: tuple[str, ...]
    each: str = ""
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)
    system: str = ""


SHARE_ROLES = {"human": "user", "gpt": "assistant"}
LAYOUTS = (
    Layout("turn rows", ("conv_id", "turn", "role", "text"), role="role", text="text"),
    Layout("messages", ("messages[].role", "messages[].content"), each="messages", role="role", text="content"),
    Layout("system and messages", ("system", "messages[].role", "messages[].content"), each="messages", role="role", text="content", system="system"),
    Layout("from and value", ("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value", roles=SHARE_ROLES),
    Layout("prompt and response", ("prompt", "response"), parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt and completion", ("prompt", "completion"), parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("system, prompt and response", ("system", "prompt", "response"), parts=(("user", ("prompt",)), ("assistant", ("response",))), system="system"),
    Layout("instruction", ("instruction", "output"), parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction with input", ("instruction", "input", "output"), parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question and answer", ("question", "answer"), parts=(("user", ("question",)), ("assistant", ("answer",)))),
)
BY_FINGERPRINT = {fingerprint(layout.paths): layout for layout in LAYOUTS}
#: Fields of any layout; others say nothing about turns and are left out of fingerprints.
KNOWN = frozenset(p for layout in LAYOUTS for p in layout.paths)
#: The fields of turn rows that JSON records have for their place instead.
PLACE = frozenset({"conv_id", "turn"})


def layout_of(paths: frozenset[str]) -> Layout | None:
    """The layout of a set of field paths, by its fingerprint."""
    paths &= KNOWN
    if found := BY_FINGERPRINT.get(fingerprint(paths)):
        return found
    mixed = [layout for layout in LAYOUTS if paths.issuperset(layout.paths)]
    return max(mixed, key=lambda layout: len(layout.paths), default=None)


def record_paths(value, prefix: str = "") -> Iterator[str]:
    if isinstance(value, dict) and value:
        for key, inner in value.items():
            yield from record_paths(inner, f"{prefix}.{key}" if prefix else key)
    elif isinstance(value, list) and any(isinstance(x, dict) for x in value):
        for inner in value:
            yield from record_paths(inner, f"{prefix}[]")
    else:
        yield prefix


def schema_paths(kind: T.DataType, prefix: str = "") -> Iterator[str]:
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        yield from schema_paths(kind.elementType, f"{prefix}[]")
    else:
        yield prefix


def table_layout(schema: T.StructType) -> Layout | None:
    return layout_of(frozenset(schema_paths(schema)))


@lru_cache(1024)
def _layout_of_paths(paths: frozenset[str]) -> Layout | None:
    return layout_of(paths)


def record_layout(record) -> Layout | None:
    return _layout_of_paths(frozenset(record_paths(record)) - PLACE) if isinstance(record, dict) else None


def _plain(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def record_turns(record: dict, layout: Layout) -> list[tuple[str, str]]:
    turns = [("system", _plain(record[layout.system]))] if layout.system else []
    if layout.each:
        return turns + [(layout.roles.get(_plain(t.get(layout.role)), _plain(t.get(layout.role))), _plain(t.get(layout.text))) for t in record[layout.each]]
    return turns + [(role, "\n\n".join(x for x in (_plain(record[f]) for f in fields) if x)) for role, fields in layout.parts]


TURNS = "conv_id long, turn long, role string, text string"


def canonical_turns(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) from a table of turn rows."""
    layout = table_layout(table.schema)
    if layout is None or layout.each or layout.parts:
        raise ValueError(f"no layout of turn rows has the fields {sorted(schema_paths(table.schema))}")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return table.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty(layout.role).alias("role"), empty(layout.text).alias("text"))


def _parsed(text: str | None):
    try:
        return json.loads(text or "")
    except ValueError:
        return None


def record_table_turns(records: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) from JSON records (conv_id, record[, turn]) of mixed known layouts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, text, first in zip(*(c.to_pylist() for c in batch.columns)):
                record = _parsed(text)
                if layout := record_layout(record):
                    rows += [(conv_id, None if first is None else first + i, role, body) for i, (role, body) in enumerate(record_turns(record, layout))]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, types)], names=["conv_id", "turn", "role", "text"])

    first = F.col("turn").cast("long") if "turn" in records.columns else F.lit(0).cast("long")
    return records.select(F.col("conv_id").cast("long").alias("conv_id"), "record", first.alias("turn")).mapInArrow(lean(run), TURNS)


def mixed_records(turns: DataFrame, layout: Column) -> DataFrame:
    """(conv_id, turn, record): turns(conv_id, turn, role, text) as JSON records of the layout that each row names.

    A user's turn and the assistant's answer of the next turn number are one record where the layout has parts; single
    turns are, too, as "messages" there, and so are turns whose role is one of SHARE_ROLES' names where the layout is "from
    and value", since reading would rename it. What exporters of several data sets would hand over.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text", layout.alias("layout"))
    for name, where in (("after", F.lead), ("before", F.lag)):
        rows = rows.withColumn(name, where(F.struct("turn", "role", "text")).over(order))
    parts = {x.name: x.parts for x in LAYOUTS if x.parts and all(len(fields) == 1 for _, fields in x.parts)}
    paired = F.col("layout").isin(*parts)
    asks = paired & (F.col("role") == "user") & (F.col("after.role") == "assistant") & (F.col("after.turn") == F.col("turn") + 1)
    told = paired & (F.col("role") == "assistant") & (F.col("before.role") == "user") & (F.col("before.turn") == F.col("turn") - 1)
    record = F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")), {"ignoreNullFields": "false"})
    names = {role: name for name, role in SHARE_ROLES.items()}
    sender = F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("role")], F.col("role"))
    shared = F.to_json(F.struct(F.array(F.struct(sender.alias("from"), F.col("text").alias("value"))).alias("conversations")), {"ignoreNullFields": "false"})
    # a role that this layout gives another meaning when it is read is handed over as a message
    told_apart = ~F.coalesce(F.col("role").isin(*SHARE_ROLES), F.lit(False))
    record = F.when((F.col("layout") == "from and value") & told_apart, shared).otherwise(record)
    for name, ((_, (ask,)), (_, (answer,))) in parts.items():
        pair = F.to_json(F.struct(F.col("text").alias(ask), F.col("after.text").alias(answer)), {"ignoreNullFields": "false"})
        record = F.when((F.col("layout") == name) & F.coalesce(asks, F.lit(False)), pair).otherwise(record)
    return rows.filter(~F.coalesce(told, F.lit(False))).select("conv_id", "turn", record.alias("record"))


def unknown_records(records: DataFrame) -> DataFrame:
    """(conv_id, fingerprint) of JSON records without a known layout; the fingerprint is null for broken ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [(i, _parsed(t)) for i, t in zip(*(c.to_pylist() for c in batch.columns))]
            odd = [(i, fingerprint(record_paths(r)) if isinstance(r, dict) else None) for i, r in parsed if record_layout(r) is None]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in odd], pa.int64()), pa.array([f for _, f in odd], pa.string())], names=["conv_id", "fingerprint"])

    return records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("record")).mapInArrow(run, "conv_id long, fingerprint string")


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end) for each row of turns(conv_id, turn, role, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            formatted, starts, ends = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
                formatted.append(f"{head}{body}{END}")
                masked = role == "assistant"
                starts.append(len(head) if masked else None)
                ends.append(len(head) + len(body) if masked else None)
            columns = [batch.column(0), batch.column(1), pa.array(formatted, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(lean(run, 3), "conv_id long, turn long, formatted string, loss_start long, loss_end long")


def write_formatted(turns: DataFrame, path: str | None = None) -> DataFrame:
    """Formatted turns as a table below path, read back."""
    path = path or new_path(turns.sparkSession, "chat")
    formatted = format_turns(turns)
    formatted.write.option("compression", "zstd").parquet(path)
    return turns.sparkSession.read.schema(formatted.schema).parquet(path)


def in_order(formatted: DataFrame) -> DataFrame:
    """Each conversation's formatted turns together and in order, in one partition."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the formatted turns.

    Turns stream through running hashes, so a long conversation takes no more memory than a short one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        rows: list[tuple] = []

        def close() -> None:
            if state:
                rows.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def emitted() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) if rows else [[]] * 6
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in (part for whole in batches for part in sliced(whole, 2)):
            for conv_id, text, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if now != (conv_id,):
                    close()
                    now, state = (conv_id,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, body = map(unescape, _PARSED.fullmatch(text).groups())
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
                if start is not None:
                    loss = unescape(text[start:end])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(text)
            if len(rows) > 5000:
                yield emitted()
                rows.clear()
        close()
        yield emitted()

    return in_order(formatted).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
