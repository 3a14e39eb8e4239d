"""Chat formatting of records with different layouts, chosen by schema fingerprint.

A record's fingerprint is a hash of its nested field paths.  A mapping states
declaratively which paths hold the turns of one layout; the first mapping whose
paths a fingerprint has is chosen once for that fingerprint.  Turns are written
with a template that marks them and escapes its control strings inside texts,
so the turns and the loss mask can be read back exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.stage import read_table, staged

#: Turns that one record holds at most; a longer conversation is several records.
PART_TURNS = 512
#: Rows of crowded parts that one task numbers.
SLICE_ROWS = 20_000
LEARNT = "assistant"


@dataclass(frozen=True)
class Mapping:
    """``each`` names a list of turns with ``role`` and ``text`` paths inside; ``fields`` lists (role, path) instead."""

    name: str
    each: str | None = None
    role: str | None = None
    text: str | None = None
    roles: dict = field(default_factory=dict)
    fields: tuple = ()

    @property
    def needs(self) -> frozenset:
        if self.each:
            return frozenset((f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"))
        return frozenset(path for _, path in self.fields)

    def turns(self, record: dict) -> list[tuple[str, str]]:
        if self.each:
            rows = record.get(self.each) or []
            found = [(_text(_at(r, self.role)), _text(_at(r, self.text))) for r in rows if isinstance(r, dict)]
        else:
            found = [(role, _text(_at(record, path))) for role, path in self.fields]
        return [(self.roles.get(role, role), text) for role, text in found]


#: Most specific first.
MAPPINGS = (
    Mapping("message_parts", each="messages", role="role", text="content[].text"),
    Mapping("messages", each="messages", role="role", text="content"),
    Mapping("from_value", each="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Mapping("instruction_input", fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction", fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("prompt_response", fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question_answer", fields=(("user", "question"), ("assistant", "answer"))),
)


def _at(value, path: str):
    for step in path.split("."):
        many = step.endswith("[]")
        name = step.removesuffix("[]")
        if isinstance(value, list):
            value = [v.get(name) for v in value if isinstance(v, dict)]
        else:
            value = value.get(name) if isinstance(value, dict) else None
        if many and value is not None and not isinstance(value, list):
            value = [value]
    return value


def _text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "".join(map(_text, value))
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def field_paths(value, prefix: str = "") -> set[str]:
    """The nested field paths of a parsed record; list items share the path ``name[]``."""
    out: set[str] = set()
    if isinstance(value, dict):
        for k, v in value.items():
            path = f"{prefix}.{k}" if prefix else k
            out.add(path)
            out |= field_paths(v, path)
    elif isinstance(value, list):
        for v in value:
            out |= field_paths(v, f"{prefix}[]")
    return out


def fingerprint(paths: set[str]) -> int:
    """A signed 64-bit hash of the set of paths."""
    return int.from_bytes(xxhash.xxh3_64_digest("\n".join(sorted(paths)).encode()), "big", signed=True)


_CONTROL = re.compile(r"[\\#]|<(?=/turn>)")
_ROLE_CONTROL = re.compile(r"[\\#:]|<(?=/turn>)")
# possessive: no state is kept for going back, so a long turn takes no memory beyond itself
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<#]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    """A backslash before each control character: backslash, #, the < of </turn>, and : in a role."""
    return (_ROLE_CONTROL if role else _CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, loss spans): ``### role: text</turn>`` lines; the spans cover the assistant's escaped texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role, True)}: ", escape(text)
        if role == LEARNT:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}</turn>\n")
        at += len(parts[-1])
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; a text that the template cannot have made raises ValueError."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _format(mappings):
    def run(batches):
        chosen: dict[int, Mapping | None] = {}
        for batch in batches:
            out = {k: [] for k in ("fingerprint", "layout", "formatted", "loss", "n_turns")}
            for raw in batch.column("record").to_pylist():
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                mapping, f = None, None
                if isinstance(record, dict):
                    paths = field_paths(record)
                    f = fingerprint(paths)
                    if f not in chosen:
                        chosen[f] = next((m for m in mappings if m.needs <= paths), None)
                    mapping = chosen[f]
                text, spans, n = None, None, None
                if mapping is not None:
                    turns = mapping.turns(record)
                    text, spans = render(turns)
                    n = len(turns)
                for k, v in zip(out, (f, mapping and mapping.name, text, spans and [{"start": a, "end": b} for a, b in spans] or ([] if text is not None else None), n), strict=True):
                    out[k].append(v)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            new = [pa.array(out["fingerprint"], pa.int64()), pa.array(out["layout"], pa.string()), pa.array(out["formatted"], pa.string()), pa.array(out["loss"], span), pa.array(out["n_turns"], pa.int64())]
            names = [n for n in batch.schema.names if n != "record"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new], names=[*names, *out])

    return run


def format_records(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Other columns of ``records`` plus fingerprint, layout, formatted, loss and n_turns.

    ``record`` is a JSON object as text.  loss lists the code-point spans of
    ``formatted`` that the assistant said.  A missing role or text is empty.  A
    record that is null, no JSON object, or of a fingerprint without mapping
    stays in the result with null layout and text, so none is lost.
    """
    names = ["fingerprint", "layout", "formatted", "loss", "n_turns"]
    clash = set(names) & set(records.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema if f.name != "record"]
    schema = ", ".join([*kept, "fingerprint long, layout string, formatted string, loss array<struct<start: bigint, end: bigint>>, n_turns long"])
    return records.mapInArrow(_format(mappings), schema)


def _crowded_parts(said: DataFrame, crowded: DataFrame, part_turns: int, rows: int) -> DataFrame:
    """(conv_id, part, piece, turns) of the parts in ``crowded``: pieces of ``part_turns`` places in the order of turn, role and text.

    Equal rows are counted first.  The others are dealt by ranges of that
    order, so a part of any size is spread; a running sum inside each slice and
    the small table of slice sizes give the places.
    """
    part = ["conv_id", "part"]
    of = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in part]
    distinct = said.join(crowded.select(*[F.col(c).alias(f"_{c}") for c in part]), of[0] & of[1], "left_semi").groupBy(*part, "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    slices = max(8, -(-rows // SLICE_ROWS))
    dealt = distinct.repartitionByRange(slices, *part, "turn", "role", "text").withColumn("slice", F.spark_partition_id())
    dealt = staged(dealt, "crowded-turns")
    inside = Window.partitionBy("slice", *part).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*part).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*part, "slice").agg(F.sum("n").alias("size"))
    offsets = sizes.select(*[F.col(c).alias(f"_{c}") for c in part], F.col("slice").alias("_slice"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    placed = dealt.withColumn("end", F.sum("n").over(inside)).join(offsets, of[0] & of[1] & (F.col("slice") == F.col("_slice")))
    placed = placed.withColumn("end", F.col("end") + F.col("offset")).withColumn("begin", F.col("end") - F.col("n"))
    first, last = F.floor(F.col("begin") / part_turns), F.floor((F.col("end") - 1) / part_turns)
    pieces = placed.withColumn("piece", F.explode(F.sequence(first, last)))
    share = F.least("end", (F.col("piece") + 1) * part_turns) - F.greatest("begin", F.col("piece") * part_turns)
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text", share.cast("int").alias("n"))))
    again = F.flatten(F.transform(turns, lambda t: F.array_repeat(F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text")), t["n"])))
    return pieces.groupBy(*part, "piece").agg(again.alias("turns"))


def turn_records(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, piece, record): turn rows as JSON records in the layout that fits their roles.

    A conversation is cut by turn number into parts of ``part_turns``, and a
    part that holds more rows than that (turn numbers or conv_id that are null
    or repeat) into pieces of ``part_turns`` rows, so no row holds a long
    conversation whole.  A null text or role is empty; a null turn number comes
    first; equal turn numbers are ordered by role and text.  Columns other than
    conv_id, turn, role and text are dropped.
    """
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    part = F.floor(turn / part_turns).alias("part")
    filled = [turn.alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")]
    said = turns.select("conv_id", part, *filled)
    crowded = turns.select("conv_id", part).groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > part_turns)
    crowded = staged(crowded, "crowded")
    rows = crowded.agg(F.sum("rows")).first()[0] or 0
    calm = said
    if rows:
        calm = said.join(crowded.select(F.col("conv_id").alias("_conv_id"), F.col("part").alias("_part")), F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("part") == F.col("_part")), "left_anti")
    parts = calm.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")).select("conv_id", "part", F.lit(0).cast("long").alias("piece"), "turns")
    if rows:
        parts = parts.unionByName(_crowded_parts(said, crowded, part_turns, rows))
    roles = F.array_join(F.transform("turns", lambda t: t["role"]), ",")
    known = F.forall("turns", lambda t: t["role"].isin("system", "user", "assistant"))
    text = lambda i: F.col("turns")[i]["text"]
    sharer = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    record = (
        F.when(roles == "user,assistant", F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(roles == "system,user,assistant", F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("input"), text(2).alias("output"))))
        .when(known & roles.startswith("system"), F.to_json(F.struct(F.transform("turns", lambda t: F.struct(sharer(t["role"]).alias("from"), t["text"].alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))))
    )
    return parts.select("conv_id", "part", "piece", record.alias("record"))


def _digest(batches):
    """Rows sorted by (conv_id, part, piece): one row per conversation, read back from its formatted parts as they pass."""
    state = None

    def finish():
        return {"conv_id": state["id"], "n_turns": state["n"], "turns_sha256": state["turns"].hexdigest(), "loss_chars": state["chars"], "loss_sha256": state["loss"].hexdigest(), "formatted_chars": state["len"]}

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    for batch in batches:
        done = []
        for conv, text, loss in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
            if state is None or state["id"] != conv:
                if state is not None:
                    done.append(finish())
                state = {"id": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "len": 0}
            for role, said in parse(text):
                state["n"] += 1
                state["turns"].update(f"{role}\n{said}\n".encode())
            for span in loss:
                said = unescape(text[span["start"] : span["end"]])
                state["chars"] += len(said)
                state["loss"].update(said.encode())
            state["len"] += len(text)
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([finish()], schema=schema)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation from its formatted parts (conv_id, part, piece, formatted, loss), read in order and never held whole."""
    dealt = formatted.select("conv_id", "part", "piece", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return dealt.select("conv_id", "formatted", "loss").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return conversation_digests(format_records(turn_records(turns.unionByName(extra))))
