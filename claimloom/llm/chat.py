"""Chat formatting: a finite-state machine over roles checks turn order and a declarative template emits text
segments with a loss flag each; a parser reads the turns back from the segments' text alone.

Rows are dealt by conversation and sorted by turn; a conversation is streamed turn by turn, so memory is
bounded however many turns it has.

Defined cases: null text is empty; a null role is the empty role; turns order by turn (null first), role,
text; repeated rows are turns of their own; rows with a null conv_id form one conversation; an unknown role
is kept in a generic turn and makes the conversation invalid; segments that hold no whole turn are not counted as
turns and make it invalid; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    """before and after each role's text, whether its text is under the loss mask, and the turn order."""

    turns: dict = field(default_factory=lambda: {
        "system": ("<s><<SYS>> ", " <</SYS>></s>", False),
        "user": ("<s>[INST] ", " [/INST]", False),
        "assistant": ("<s>[BOT] ", " </s>", True),
    })
    other: tuple = ("<s>[ROLE] ", " [/ROLE] ", " </s>")
    controls: tuple = ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[BOT]", "[ROLE]", "[/ROLE]")
    #: state -> role -> state; a conversation is valid if it ends in a state of `final`
    order: dict = field(default_factory=lambda: {
        "start": {"system": "opened", "user": "asked"},
        "opened": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    final: tuple = ("answered",)

    def patterns(self):
        own = r"(\\)|" + "|".join(f"({re.escape(c[0])})(?={re.escape(c[1:])})" for c in self.controls)
        return re.compile(own), re.compile(r"\\(\\?)")

    def turn_pattern(self) -> re.Pattern:
        one = [f"(?P<r{i}>){re.escape(a)}(?P<t{i}>.*?){re.escape(b)}" for i, (a, b, _) in enumerate(self.turns.values())]
        a, b, c = map(re.escape, self.other)
        return re.compile("|".join([*one, f"(?P<rx>){a}(?P<n>.*?){b}(?P<tx>.*?){c}"]), re.S)


class Formatter:
    def __init__(self, template: Template):
        self.t = template
        self.out, self.back = template.patterns()
        self.turn = template.turn_pattern()

    def escape(self, s: str) -> str:
        """A backslash doubles; one is put after the first character of each control string, which so is none."""
        return self.out.sub(lambda m: "\\\\" if m[1] else m[0] + "\\", s)

    def unescape(self, s: str) -> str:
        return self.back.sub(r"\1", s)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        if role in self.t.turns:
            a, b, loss = self.t.turns[role]
            return [(a, False), (self.escape(text), loss), (b, False)]
        a, b, c = self.t.other
        return [(a + self.escape(role) + b, False), (self.escape(text), False), (c, False)]

    def read(self, text: str) -> tuple[list[tuple[str, str]], str]:
        """Whole turns at the start of text, and what is left."""
        turns, at = [], 0
        while m := self.turn.match(text, at):
            if m["rx"] is not None:
                turns.append((self.unescape(m["n"]), self.unescape(m["tx"])))
            else:
                i, role = next((i, r) for i, r in enumerate(self.t.turns) if m[f"r{i}"] is not None)
                turns.append((role, self.unescape(m[f"t{i}"])))
            at = m.end()
        return turns, text[at:]


def _format(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, last, state, seg, n = Formatter(template), object(), "start", 0, 0
        for b in batches:
            cols = {k: [] for k in ("conv_id", "turn_no", "segment", "text", "loss", "state")}
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if conv != last:
                    last, state, seg, n = conv, "start", 0, 0
                state = template.order.get(state, {}).get(role or "", "invalid")
                for s, loss in f.segments(role or "", text or ""):
                    for k, v in zip(cols, (conv, n, seg, s, loss, state), strict=True):
                        cols[k].append(v)
                    seg += 1
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(cols["conv_id"], pa.int64()), pa.array(cols["turn_no"], pa.int64()), pa.array(cols["segment"], pa.int64()), pa.array(cols["text"], pa.string()), pa.array(cols["loss"], pa.bool_()), pa.array(cols["state"], pa.string())], list(cols))

    return run


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turn_no, segment, text, loss, state: the segments in order within each partition; a conversation
    lies in one partition. Their texts, joined, are the formatted conversation."""
    template = template or Template()
    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.col("turn")]
    dealt = rows.select(*cols).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(_format(template), "conv_id long, turn_no long, segment long, text string, loss boolean, state string")


def _read_back(template: Template):
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Formatter(template)
        conv, now, out = None, None, []

        def close() -> None:
            if now is not None:
                out.append((conv, now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["all"], now["state"] in template.final and not now["rest"]))

        for b in batches:
            for c, seg, text, loss, state in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if seg == 0:
                    close()
                    conv, now = c, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "all": 0, "rest": "", "state": ""}
                now["all"] += len(text)
                now["state"] = state
                if loss:
                    plain = f.unescape(text)
                    now["chars"] += len(plain)
                    now["loss"].update(plain.encode())
                now["rest"] += text
                if seg % 3 == 2:  # the parser sees the text alone; this only says when a try is worth while
                    turns, now["rest"] = f.read(now["rest"])
                    for role, said in turns:
                        now["n"] += 1
                        now["turns"].update(f"{role}\n{said}\n".encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)

    return run


def digests(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conversation, read back from its segments."""
    return segments.mapInArrow(_read_back(template or Template()), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(rows.unionByName(probe)))


def oracle_sql() -> str:
    """Turns and masked text by their order; formatted characters are those of the texts, one more for each backslash and
    for each control string, and those of the template."""
    t = Template()
    text, role = "length({0}) + length({0}) - length(replace({0}, '\\', ''))", "CASE role " + " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b, _) in t.turns.items())
    for c in t.controls:
        text += f" + (length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}"
    role += f" ELSE {sum(map(len, t.other))} + {text.format('role')} END"
    masked = ", ".join(f"'{r}'" for r, (_, _, loss) in t.turns.items() if loss)
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role IN ({masked})), '') AS loss,
  string_agg(role, ',' ORDER BY turn, role, text) AS roles, sum({text.format('text')} + {role}) AS n FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars, regexp_full_match(roles, '(system,)?user,assistant(,user,assistant)*') AS valid FROM g"""
