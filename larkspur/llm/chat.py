"""Chat formatting by schema fingerprints.

A record's layout is the set of its nested field paths, each with its kind (object, list or plain value).  The hash of the
sorted paths selects a declarative mapping, which turns the record into canonical turns ``(role, text)``: among the mappings
whose required paths are all there, the one that requires most, found once for each layout.  Other fields, such as ids,
sources or a prompt beside messages, change nothing.  Mappings cover single turn rows, prompt/response pairs,
instruction/input/output records and message lists, each with a system text where there is one; more are added by example.
A text in parts is joined, parts that are not text are named in brackets; calls of tools are kept as JSON.

The template is ``### Role: text</turn>`` and a line feed per turn.  Inside roles and texts a backslash goes before each
backslash, ``###`` and ``</turn>`` (in roles also before ``:``), so the format reads back to exactly the turns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

END = "</turn>"
_ESCAPE = re.compile(r"\\|###|</turn>")
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def paths(value: Any, prefix: str = "") -> set[str]:
    """Nested field paths of a JSON value with their kinds; list items share one path; null is a plain value."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items())) if value else {f"{prefix}:object"}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{prefix}[]") for v in value)) if value else {f"{prefix}[]"}
    return {f"{prefix}:value"}


def fingerprint(value: Any) -> int:
    """Hash of a value's paths."""
    return xxhash.xxh64_intdigest("\n".join(sorted(paths(value))).encode("utf-8", "surrogatepass"), 0)


def present(value: Any) -> set[str]:
    """All paths of a value and what stands above them, without kinds."""
    out = set()
    for path in paths(value):
        path = path.rpartition(":")[0] or path
        while path:
            out.add(path)
            path = path[:-2] if path.endswith("[]") else path.rpartition(".")[0]
    return out


def text_of(value: Any) -> str:
    """A text, or the texts of its parts."""
    if isinstance(value, list):
        return "".join(p if isinstance(p, str) else str(p["text"]) if isinstance(p, dict) and p.get("text") is not None else f"[{p.get('type', 'part')}]" if isinstance(p, dict) else "" for p in value)
    if isinstance(value, dict):
        return str(value["text"]) if "text" in value else json.dumps(value, ensure_ascii=False)
    return "" if value is None else str(value)


@dataclass(frozen=True)
class Mapping:
    """``fields``: (role, path) pairs in order, joined where a role repeats in a row; or ``each``: a list of messages with the
    names of their role and text fields, and what their roles are called here."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()

    def turns(self, record: dict) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        for role, path in self.fields:
            text = text_of(_at(record, path))
            if not text:
                continue
            if out and out[-1][0] == role:
                out[-1] = (role, f"{out[-1][1]}\n\n{text}")
            else:
                out.append((role, text))
        if not self.each:
            return out
        names = dict(self.roles)
        items = _at(record, self.each) if self.each != "." else [record]
        for m in items or []:
            if not isinstance(m, dict):
                continue
            text, role = text_of(m.get(self.text)), str(m.get(self.role) or "")
            called = {k: m[k] for k in ("tool_calls", "function_call") if m.get(k)}
            if called:
                text += ("\n" if text else "") + json.dumps(called, ensure_ascii=False)
            out.append((names.get(role, role), text))
        return out


def _at(record: Any, path: str) -> Any:
    for part in path.split("."):
        record = record.get(part) if isinstance(record, dict) else None
    return record


_SHARE_GPT = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
_SYSTEM = ("system", "system")
#: (mapping, example records): an example stands for the paths that a record must have.
LAYOUTS: tuple[tuple[Mapping, tuple[dict, ...]], ...] = (
    (Mapping("turn", each=".", text="text"), ({"role": "", "text": ""},)),
    (Mapping("prompt-response", (_SYSTEM, ("user", "prompt"), ("assistant", "response"))), ({"prompt": "", "response": ""},)),
    (Mapping("prompt-completion", (_SYSTEM, ("user", "prompt"), ("assistant", "completion"))), ({"prompt": "", "completion": ""},)),
    (Mapping("question-answer", (_SYSTEM, ("user", "question"), ("assistant", "answer"))), ({"question": "", "answer": ""},)),
    (Mapping("instruction", (_SYSTEM, ("user", "instruction"), ("user", "input"), ("assistant", "output"))), ({"instruction": "", "output": ""},)),
    (Mapping("messages", (_SYSTEM,), each="messages"), ({"messages": [{"role": "", "content": ""}]}, {"messages": [{"role": "", "tool_calls": [{}]}]}, {"messages": []})),
    (Mapping("conversations", (_SYSTEM,), each="conversations", role="from", text="value", roles=_SHARE_GPT), ({"conversations": [{"from": "", "value": ""}]}, {"conversations": []})),
    (Mapping("nested-prompt", (("system", "data.system"), ("user", "data.prompt"), ("assistant", "data.response"))), ({"data": {"prompt": "", "response": ""}},)),
)
#: Layouts whose mapping a registry remembers.
REMEMBERED = 10_000


class Registry:
    """Mappings by the fingerprints of layouts; a layout seen for the first time takes the mapping that requires most of what it has, the first of several."""

    def __init__(self, layouts: tuple[tuple[Mapping, tuple[dict, ...]], ...]) -> None:
        self.required = [(present(example), mapping) for mapping, examples in layouts for example in examples]
        self.found: dict[int, Mapping | None] = {}

    def get(self, record: dict) -> Mapping | None:
        layout = fingerprint(record)
        if layout not in self.found:
            if len(self.found) >= REMEMBERED:
                self.found.clear()
            have = present(record)
            fit = [(len(paths), mapping) for paths, mapping in self.required if paths <= have]
            self.found[layout] = max(fit, key=lambda x: x[0])[1] if fit else None
        return self.found[layout]


REGISTRY = Registry(LAYOUTS)


def canonical(record: dict, registry: Registry | None = None) -> tuple[str, list[tuple[str, str]]]:
    """Name of the mapping and the turns of a record; ``unknown`` and no turns where no mapping has its layout."""
    mapping = (registry or REGISTRY).get(record)
    return (mapping.name, mapping.turns(record)) if mapping else ("unknown", [])


def format_turn(role: str, text: str) -> str:
    name = _ESCAPE.sub(lambda m: "\\" + m[0], role).replace(":", "\\:")
    return f"### {name}: {_ESCAPE.sub(lambda m: chr(92) + m[0], text)}{END}\n"


def read_turns(formatted: str) -> list[tuple[str, str, tuple[int, int]]]:
    """Turns read back from a formatted text: role, text, and the span of the escaped text (without the end mark)."""
    return [(_UNESCAPE.sub(r"\1", m[1]), _UNESCAPE.sub(r"\1", m[2]), m.span(2)) for m in _TURN.finditer(formatted)]


def format_records(records: DataFrame, json_col: str, registry: Registry | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(carry..., layout, n_turns, formatted, loss_spans)`` for every JSON record, in the order of the input.

    ``loss_spans`` holds (start, end) code points of assistant texts within ``formatted``.  A null or malformed record, or
    one of unknown layout, gives no turns and layout ``unknown``; its row stays, so such records can be looked through.  Null
    texts are empty, numbers are their JSON text, whole texts of any length are formatted, repeated rows each.  Columns in
    ``carry`` pass through, others are ignored; an empty table gives an empty result.
    """
    fields = [records.schema[c] for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 0):
                names, counts, texts, spans = [], [], [], []
                for raw in batch.column(0).to_pylist():
                    try:
                        record = json.loads(raw) if raw else None
                    except ValueError:
                        record = None
                    name, turns = canonical(record, registry) if isinstance(record, dict) else ("unknown", [])
                    out, at, loss = [], 0, []
                    for role, text in turns:
                        turn = format_turn(role, text)
                        if role == "assistant":
                            start, end = read_turns(turn)[0][2]
                            loss.append([at + start, at + end])
                        out.append(turn)
                        at += len(turn)
                    names.append(name)
                    counts.append(len(turns))
                    texts.append("".join(out))
                    spans.append(loss)
                made = [pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*batch.schema.names[1:], "layout", "n_turns", "formatted", "loss_spans"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "layout string, n_turns long, formatted string, loss_spans array<array<bigint>>"])
    return records.select(F.col(json_col).cast("string"), *carry).mapInArrow(run, schema)


def conversation_digests(parts: DataFrame) -> DataFrame:
    """Read formatted parts ``(conv_id, turn, formatted, loss_spans)`` back and digest each conversation.

    Parts are dealt by conversation and sorted, and each conversation streams through running hashes, so one that fills
    a third of the table needs no more memory than a short one.  Ties of ``turn`` go by the formatted text, null turns come
    first and null conversations are one.  Repeated parts count each; a null or empty part adds nothing; texts may be of any
    length; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, begun = None, False
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = chars = lost = 0

        def send() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, formatted, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not begun or conv != now:
                    if begun:
                        rows.append((now, n, turns.hexdigest(), lost, loss.hexdigest(), chars))
                    now, begun = conv, True
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    n = chars = lost = 0
                    if len(rows) >= 10_000:
                        yield send()
                        rows.clear()
                formatted, spans = formatted or "", spans or []
                for role, text, _ in read_turns(formatted):
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for start, end in spans:
                    text = _UNESCAPE.sub(r"\1", formatted[start:end])
                    loss.update(text.encode("utf-8", "surrogatepass"))
                    lost += len(text)
                chars += len(formatted)
        if begun:
            rows.append((now, n, turns.hexdigest(), lost, loss.hexdigest(), chars))
        if rows:
            yield send()

    sort = parts.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return sort.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
