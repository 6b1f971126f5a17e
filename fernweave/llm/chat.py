"""Chat formatting by a finite-state machine over roles, from a declarative template, with a loss flag for each segment.

A template names the states, which role may follow in which state, and for each role the markers around its text and
whether its text is under the loss. Rows of a conversation go through the machine in the order of their turns (ties by
role, then text): each gives its segments, (text, loss), and whether its role was allowed there. After a role that was
not allowed the machine goes on from that role's own state, so every turn is formatted and the first fault is known.

Inside texts the escape character is put before itself, and after the first character of every control string; no
control string is left in an escaped text, so the output can be cut at them again, and `unescaped` gives the text back.
The output of a conversation is one running text, with the spans in it that are under the loss. `digests` reads that:
it finds the turns by the control strings, across the pieces in which the text arrives, and the loss by the spans.

A conversation is never gathered: its rows are sorted together, across blocks of rows, and read once; what is held of
one is the machine's state. That way a conversation of any length needs no more memory than a short one.

Defined cases: a null text is empty, and so is a null role, which like any role that the template doesn't name is put
into the output by name; null turns come last; rows without a conversation id are one conversation; repeated rows are
turns of their own; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernweave.llm.common import slices


@dataclass(frozen=True)
class Role:
    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """roles: markers and loss of each role. follows: state -> the roles that may come next; a role's name is its state.

    other_opens, other_middle and other_closes stand around the name and the text of a role that is not in roles.
    """

    roles: dict[str, Role]
    follows: dict[str, tuple[str, ...]]
    start: str = ""
    other_opens: str = "[ROLE] "
    other_middle: str = " [/ROLE] "
    other_closes: str = " [/OTHER]"
    escape: str = "\\"
    gap: str = " "
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        marks = [x for r in self.roles.values() for x in (r.opens, r.closes)] + [self.other_opens, self.other_middle, self.other_closes]
        object.__setattr__(self, "controls", tuple(sorted({m.strip(self.gap) for m in marks}, key=lambda c: (-len(c), c))))
        for mark in self.controls:
            if len(mark) < 2 or self.gap in mark or self.escape in mark:
                raise ValueError(f"control string {mark!r} needs two characters at least, and neither gap nor escape")
        opens = [r.opens for r in self.roles.values()] + [self.other_opens, self.other_middle]
        closes = [r.closes for r in self.roles.values()] + [self.other_middle, self.other_closes]
        if len({x.strip(self.gap) for x in opens + closes}) < len(self.roles) * 2 + 3:
            raise ValueError("every marker needs a control string of its own")
        if len(self.gap) != 1 or not all(x.endswith(self.gap) for x in opens) or not all(x.startswith(self.gap) for x in closes):
            raise ValueError("a gap must part every text from its markers, so that no control string begins in the one and ends in the other")

    def escaped(self, text: str) -> str:
        held = text.replace(self.escape, self.escape * 2)
        return re.sub("(?=" + "|".join(map(re.escape, self.controls)) + ")(.)", lambda m: m[1] + self.escape, held, flags=re.S)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", lambda m: m[1], text, flags=re.S)


#: The default template: an optional system turn, then user and assistant by turns, and tool results after an assistant.
INSTRUCT = Template(
    roles={
        "system": Role("<<SYS>> ", " <</SYS>>"),
        "user": Role("[INST] ", " [/INST]"),
        "assistant": Role("<s> ", " </s>", loss=True),
        "tool": Role("[TOOL] ", " [/TOOL]"),
    },
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)},
)

Segments = list[tuple[str, bool]]


def step(template: Template, state: str, role: str, text: str) -> tuple[str, bool, Segments]:
    """One turn: the state after it, whether it was allowed, and its segments."""
    allowed = role in template.follows.get(state, ())
    body = template.escaped(text)
    if role in template.roles:
        shape = template.roles[role]
        return role, allowed, [(shape.opens, False), (body, shape.loss), (shape.closes, False)]
    name = template.escaped(role)
    return role, allowed, [(template.other_opens + name + template.other_middle, False), (body, False), (template.other_closes, False)]


class Reader:
    """Turns and text under the loss, read from the running text of a conversation, which may arrive in any pieces."""

    def __init__(self, template: Template) -> None:
        self.template = template
        self.control = re.compile("|".join(map(re.escape, template.controls)))
        self.held, self.at = "", 0  # the text that isn't read yet, and the place where it begins
        self.spans: list[tuple[int, int]] = []

    def fed(self, text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], list[str]]:
        """(role, text) of the turns that end in this piece, and the unescaped text of the spans that lie in them."""
        self.held += text
        self.spans += spans
        turns, start = [], 0
        while (found := self._turn(start)) is not None:
            role, body, start = found
            turns.append((self.template.unescaped(role), self.template.unescaped(body)))
        end = self.at + start
        whole = [x for x in self.spans if x[1] <= end]
        under = [self.template.unescaped(self.held[a - self.at : b - self.at]) for a, b in whole]
        self.spans = self.spans[len(whole) :]
        self.held, self.at = self.held[start:], end
        return turns, under

    def _turn(self, start: int) -> tuple[str, str, int] | None:
        """Role, body (both escaped) and end of the turn that begins at start; none if the text ends before it does."""
        template, text = self.template, self.held
        opened = self.control.match(text, start)
        if opened is None:
            return None
        role = next((name for name, shape in template.roles.items() if shape.opens.startswith(opened[0])), None)
        body = start + len(template.other_opens if role is None else template.roles[role].opens)
        if role is None:
            middle = self.control.search(text, body)
            if middle is None:
                return None
            name_end = middle.start() - len(template.gap)
            name, body = text[body:name_end], name_end + len(template.other_middle)
        closes = template.other_closes if role is None else template.roles[role].closes
        closing = self.control.search(text, body)
        if closing is None or len(text) < closing.start() - len(template.gap) + len(closes):
            return None
        end = closing.start() - len(template.gap)
        return (name if role is None else template.escaped(role)), text[body:end], end + len(closes)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows of a conversation side by side and in order, in one partition; sorted outside memory where they are many."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")


def formatted(rows: DataFrame, template: Template = INSTRUCT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each row of rows: conv_id, place (0, 1, ...), allowed, and segments (text, loss), in the order of turns.

    The output of a conversation is the text of its segments, one after the other: see running().
    """
    kept = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = kept.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, place = object(), template.start, 0
        for part in slices(batches, "text"):
            out = []
            for conv, who, said in zip(*(part.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if conv != now:
                    now, state, place = conv, template.start, 0
                state, allowed, segments = step(template, state, who, said)
                out.append({"conv_id": conv, "place": place, "allowed": allowed, "segments": [{"text": t, "loss": f} for t, f in segments]})
                place += 1
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    schema = T.StructType([T.StructField("conv_id", kind)]).add("place", "long").add("allowed", "boolean").add("segments", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("loss", T.BooleanType())])))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return _ordered(kept).mapInArrow(run, schema)


def running(turns: DataFrame) -> DataFrame:
    """(conv_id, place, text, spans): the output of formatted() in pieces of one turn, in the same order.

    A conversation's text is that of its pieces one after the other; spans (start, end), in characters of that whole
    text, are under the loss.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            texts, spans = [], []
            for place, segments in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at = at if place else 0
                texts.append("".join(x["text"] for x in segments))
                spans.append([])
                for x in segments:
                    if x["loss"]:
                        spans[-1].append({"start": at, "end": at + len(x["text"])})
                    at += len(x["text"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(spans, _SPANS)], ["conv_id", "place", "text", "spans"])

    return turns.select("conv_id", "place", "segments").mapInArrow(run, f"conv_id {kind}, place bigint, text string, spans array<struct<start:bigint,end:bigint>>")


def joined(turns: DataFrame) -> DataFrame:
    """(conv_id, text, spans): the output of formatted() as one text for each conversation, and its loss spans in characters.

    For conversations that fit a row; `running` has no such limit.
    """
    of = running(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "text", "spans"))).alias("t"))
    return of.select("conv_id", F.array_join(F.transform("t", lambda t: t["text"]), "").alias("text"), F.flatten(F.transform("t", lambda t: t["spans"])).alias("spans"))


def digests(pieces: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What the output says when it is read back, for each conversation; pieces: as running() gives them, in that order.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars and loss_sha256 (the
    unescaped text under the loss spans), formatted_chars, n_faults (turns that the machine doesn't allow where they
    are). Only the running text and the spans are read. Hashes are fed turn by turn, so what is held of a conversation
    is a turn that hasn't ended.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_faults"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            done = []
            for conv, place, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if place == 0:
                    done += [held] if held else []
                    held = {"conv_id": conv, "reader": Reader(template), "state": template.start, "turns": hashlib.sha256(), "loss": hashlib.sha256()} | {k: 0 for k in names if "sha" not in k}
                turns, under = held["reader"].fed(text, [(x["start"], x["end"]) for x in spans])
                held["formatted_chars"] += len(text)
                for role, said in turns:
                    held["n_turns"] += 1
                    held["turns"].update(f"{role}\n{said}\n".encode())
                    held["n_faults"] += role not in template.follows.get(held["state"], ())
                    held["state"] = role
                for said in under:
                    held["loss_chars"] += len(said)
                    held["loss"].update(said.encode())
            yield from told(done, batch)
        if held:
            yield from told([held], batch)

    def told(done: list[dict], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if done:
            for d in done:
                d["turns_sha256"], d["loss_sha256"] = d["turns"].hexdigest(), d["loss"].hexdigest()
            columns = [pa.array([d["conv_id"] for d in done], batch.schema.field(0).type)]
            columns += [pa.array([d[k] for d in done], pa.string() if "sha" in k else pa.int64()) for k in names]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", *names])

    return pieces.select("conv_id", "place", "text", "spans").mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{k} string" if "sha" in k else f"{k} bigint" for k in names))


#: The conversation that the stated query adds.
PROBE_ID, PROBE_TEXT = -1, "</s>[INST] ok [/INST]"


def probe(spark: SparkSession) -> DataFrame:
    rows = [(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
