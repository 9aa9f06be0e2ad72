"""Chat formatting: heterogeneous conversation layouts to canonical turns, to one marked text.

A layout is declared by the nested field paths it needs. Of the paths of a record (or of a table's
schema) those that any layout knows are hashed to a fingerprint, under which a table has the mapping
to (role, text) turns. The table begins with the layouts' own fingerprints; a record that has the
fields of several layouts, or more known fields than its own needs, has another fingerprint, which is
resolved once (the first layout declared whose fields are all there) and kept. Unknown fields never matter.

Template of a turn: `### ROLE: TEXT</turn>` and a newline. In roles and texts a backslash goes
before every backslash, `#` and `<` (in roles also `:`), so `###` and `</turn>` outside the template
cannot be met, and reading back removes exactly those backslashes. The loss mask covers the escaped
text of each assistant turn.

Conversations are sorted inside partitions and formatted turn by turn, with digests carried from row
to row: a conversation of any length needs no more memory than its longest turn. Its turns do share
one task, because a digest over them in order is sequential.

Defined results: null text or role is the empty string; turns are ordered by turn (null first), then
role and text, so ties and repeated rows have one order; a null conv_id is a conversation of its
own; a conversation without assistant turns has an empty loss text; an empty table gives no rows;
a record of no known layout gives no turns and the layout name null.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ESCAPED = re.compile(r"([\\#<])")
ESCAPED_ROLE = re.compile(r"([\\#<:])")
UNESCAPE = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ((?:[^\\:#<]++|\\.)*+): ((?:[^\\#<]++|\\.)*+)</turn>\n", re.S)


def hashed(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """turns: (role or @path of the role, path of the text), in order; below `each` where it is set."""

    name: str
    turns: tuple[tuple[str, str], ...]
    each: str = ""
    paths: frozenset = field(init=False)
    fingerprint: str = field(init=False)

    def __post_init__(self):
        at = f"{self.each}[]." if self.each else ""
        used = {at + t for _, t in self.turns} | {at + r[1:] for r, _ in self.turns if r.startswith("@")}
        object.__setattr__(self, "paths", frozenset(used))
        object.__setattr__(self, "fingerprint", hashed(used))


LAYOUTS = (
    Layout("turn_row", (("@role", "text"),)),
    Layout("messages", (("@role", "content"),), "messages"),
    Layout("message_parts", (("@author.role", "content.text"),), "messages"),
    Layout("conversations", (("@from", "value"),), "conversations"),
    Layout("turns", (("@role", "text"),), "turns"),
    Layout("system_instruction", (("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction_output", (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_response", (("user", "instruction"), ("assistant", "response"))),
    Layout("prompt_response", (("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", (("user", "prompt"), ("assistant", "completion"))),
    Layout("question_answer", (("user", "question"), ("assistant", "answer"))),
)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def record_paths(value, at: str = "") -> set[str]:
    """Paths of the leaves of a parsed JSON value; a list adds [] once for all its items."""
    if isinstance(value, dict):
        return set().union(*(record_paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(record_paths(v, f"{at}[]") for v in value)) if value else set()
    return {at}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields)) if kind.fields else set()
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


#: All paths that some layout knows, and the mapping of each fingerprint of such paths. A set of paths that is no
#: layout's own is resolved when it is first met: the first layout of LAYOUTS that has all its paths there.
KNOWN = frozenset().union(*(x.paths for x in LAYOUTS))
TABLE: dict[str, Layout | None] = {x.fingerprint: x for x in reversed(LAYOUTS)}


def select_layout(paths: set[str]) -> Layout | None:
    """The layout in the table under the fingerprint of the known ones of the paths; None: there is none."""
    known = paths & KNOWN
    key = hashed(known)
    if key not in TABLE:
        TABLE[key] = next((x for x in LAYOUTS if x.paths <= known), None)
    return TABLE[key]


def _get(value, path: str):
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _string(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def record_turns(record) -> tuple[str | None, list[tuple[str, str]]]:
    """Layout name and (role, text) turns of one parsed record; an optional empty input is no turn."""
    layout = select_layout(record_paths(record))
    if layout is None:
        return None, []
    out = []
    for item in (_get(record, layout.each) or []) if layout.each else [record]:
        for role, text in layout.turns:
            who = _string(_get(item, role[1:])) if role.startswith("@") else role
            said = _string(_get(item, text))
            if said or layout.each or text != "input":
                out.append((ROLES.get(who, who), said))
    return layout.name, out


def turns_of_json(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(conv_id, turn, role, text, layout) of JSON records, each with a layout of its own."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    name, turns = record_turns(json.loads(raw)) if raw else (None, [])
                except ValueError:
                    name, turns = None, []
                rows += [(key, i, role, text, name) for i, (role, text) in enumerate(turns)] or [(key, None, None, None, None)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "turn", "role", "text", "layout"])

    return records.select(F.col(id_col).cast("long"), F.col(json_col).cast("string")).mapInArrow(run, "conv_id long, turn long, role string, text string, layout string")


def turns_of_table(rows: DataFrame, id_col: str = "conv_id", order_col: str = "turn") -> DataFrame:
    """Canonical turns of a table, by the layout that its schema's fingerprint selects."""
    layout = select_layout(schema_paths(rows.schema))
    if layout is None:
        raise ValueError(f"no layout has the fields of {rows.columns}")
    key = F.col(id_col).cast("long").alias("conv_id")
    if layout.each:
        base = rows.select(key, F.posexplode(layout.each).alias("turn", "item"))
        col, order = (lambda p: F.col(f"item.{p}")), F.col("turn").cast("long")
    else:
        base, order = rows.withColumn("conv_id", key), F.col(order_col).cast("long") if order_col in rows.columns else F.lit(0)
        col = F.col
    n = len(layout.turns)
    said = F.array(*(F.struct((col(r[1:]) if r.startswith("@") else F.lit(r)).cast("string").alias("role"), col(t).cast("string").alias("text")) for r, t in layout.turns))
    if n == 1:
        one = said[0]
        out = base.select("conv_id", order.alias("turn"), one["role"].alias("role"), one["text"].alias("text"))
    else:
        out = base.select("conv_id", order.alias("at"), F.posexplode(said).alias("k", "one")).select("conv_id", (F.col("at") * n + F.col("k")).alias("turn"), "one.role", "one.text")
    return out.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn and where the escaped text lies in it."""
    head = f"### {ESCAPED_ROLE.sub(r'\\\1', role)}: "
    body = ESCAPED.sub(r"\\\1", text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted text; raises where it is not one."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        out.append((UNESCAPE.sub(r"\1", m[1]), UNESCAPE.sub(r"\1", m[2])))
        at = m.end()
    return out


PIECES = "conv_id long, piece long, formatted string, start long, loss_start long, loss_end long"


def format_pieces(turns: DataFrame) -> DataFrame:
    """One row per turn, each conversation's in order and together: the formatted piece, where it
    starts in its conversation (code points), and the loss span (null where the turn has none)."""

    def run(batches):
        now, at, k = ..., 0, 0
        for batch in batches:
            rows = []
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if key != now:
                    now, at, k = key, 0, 0
                piece, lo, hi = format_turn(role, text)
                loss = role == "assistant"
                rows.append((key, k, piece, at, at + lo if loss else None, at + hi if loss else None))
                at, k = at + len(piece), k + 1
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in PIECES.split(", ")])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, PIECES)


def read_back(pieces: DataFrame) -> DataFrame:
    """Counts and digests per conversation, read from the formatted text and its loss spans alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches):
        now, state, done = ..., None, []

        def fresh():
            return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

        def finish():
            if state is not None:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush():
            cols = list(zip(*done)) or [()] * 6
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)
            done.clear()
            return batch

        for batch in batches:
            for key, text, start, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "start", "loss_start", "loss_end"))):
                if key != now:
                    finish()
                    now, state = key, fresh()
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if lo is not None:
                    learned = UNESCAPE.sub(r"\1", text[lo - start : hi - start])
                    state[2] += len(learned)
                    state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if done:
                yield flush()
        finish()
        yield flush()

    return pieces.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
