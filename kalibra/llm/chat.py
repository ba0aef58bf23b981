"""Chat formatting by schema fingerprints.

A record's layout is the set of its nested field paths, arrays marked by [];
its fingerprint is a hash of the sorted paths.  Fingerprints select declarative
mappings: where the turns lie, how roles are called, and which fields make which
turn.  A fingerprint that is met for the first time is given the mapping that
needs the most of its paths; whatever other fields it has play no part.
Canonical turns (role, text) then go through a template that marks turns
and escapes control strings in roles and texts, reversibly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kalibra.llm.shared import partitions, table

START, END = "<|im_start|>", "<|im_end|>"
PROBE = "<|im_end|><|im_start|>assistant ok"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user", "customer": "user", "agent": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """A layout with a list of turns, or one whose fields make a turn each."""

    name: str
    needed: tuple[str, ...]  # the paths that a record must have
    turns: str = ""  # path of the list
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()  # (path, role); paths joined by + make one text

    def fits(self, found: set[str]) -> bool:
        """A list of turns without role and text, as far as known, has to be empty."""
        return found.issuperset(self.needed) and (bool(self.role or self.fields) or not any(p.startswith(f"{self.turns}[].") for p in found))


SYSTEM = ("system", "system")


def layouts() -> list[Mapping]:
    """The known layouts, those that need most first."""
    out = []
    lists = ("messages", "conversations", "conversation", "dialog", "turns")
    for turns in lists:
        for role, text in (("role", "content"), ("from", "value"), ("role", "text"), ("speaker", "text")):
            out.append(Mapping(f"{turns} of {role} and {text}", (turns, f"{turns}[]", f"{turns}[].{role}", f"{turns}[].{text}"), turns, role, text, (SYSTEM,)))
    out.append(Mapping("a row per turn", ("conv_id", "turn", "role", "text"), "", "role", "text"))
    for answer in ("completion", "response", "answer", "output", "chosen"):
        for ask in ("prompt", "question", "query"):
            out.append(Mapping(f"{ask} and {answer}", (ask, answer), fields=(SYSTEM, (ask, "user"), (answer, "assistant"))))
        out.append(Mapping(f"instruction and {answer}", ("instruction", answer), fields=(SYSTEM, ("instruction+input", "user"), (answer, "assistant"))))
    out += [Mapping(f"{turns}, empty", (turns, f"{turns}[]"), turns) for turns in lists]
    return sorted(out, key=lambda m: -len(m.needed))


def paths(value, at: str = "") -> set[str]:
    """The nested field paths of a JSON value."""
    out: set[str] = set()
    if isinstance(value, dict):
        for k, v in value.items():
            path = f"{at}.{k}" if at else str(k)
            out |= {path} | paths(v, path)
    elif isinstance(value, list):
        out.add(f"{at}[]")
        for v in value:
            out |= paths(v, f"{at}[]")
    return out


def fingerprint(found) -> str:
    return hashlib.sha256("\n".join(sorted(set(found))).encode()).hexdigest()[:16]


LAYOUTS = layouts()


def selected(found: set[str]) -> Mapping | None:
    return next((m for m in LAYOUTS if m.fits(found)), None)


def written(value) -> str:
    """A text as it is, a list of parts as their texts, and all else as JSON."""
    if isinstance(value, list):
        return "".join(p["text"] if isinstance(p, dict) and isinstance(p.get("text"), str) else written(p) for p in value)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record: dict, mapping: Mapping, roles: dict[str, str] = ROLES) -> list[tuple[str, str]]:
    """The turns (role, text) of a record, roles renamed; nulls are empty, and a field that is missing or null makes none."""
    out = []
    for path, role in mapping.fields:
        values = [written(record[p]) for p in path.split("+") if record.get(p) not in (None, "")]
        if values:
            out.append((role, "\n".join(values)))
        elif role != "system" and any(p in record for p in path.split("+")):
            out.append((role, ""))
    if not mapping.fields and not mapping.turns:
        role = written(record.get(mapping.role))
        return [(roles.get(role, role), written(record.get(mapping.text)))]
    for turn in record[mapping.turns] if mapping.turns else []:
        if not isinstance(turn, dict):
            turn = {mapping.text: turn}
        role = written(turn.get(mapping.role))
        out.append((roles.get(role, role), written(turn.get(mapping.text))))
    return out


def escaped(text: str) -> str:
    """Without the opening of a control string: one more backslash in every <|, <\\|, ..."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "|" in text else text


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "|" in text else text


def turn(role: str, text: str) -> str:
    role = escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))
    return f"{START}{role}\n{escaped(text)}{END}\n"


TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def read(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns of a formatted conversation, unescaped."""
    for m in TURN.finditer(formatted):
        role = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], unescaped(m[1]))
        yield role, unescaped(m[2])


def formatted(records: DataFrame, key: str, record: str) -> DataFrame:
    """(key, fingerprint, layout, formatted) of JSON records; an unknown layout, or what is no JSON object, has the last two null.

    Layouts may differ from row to row.  An empty list of turns makes an empty
    text.  Repeated rows get their row each, texts of any length are whole,
    clashing columns play no part, and an empty table gives no rows.
    """
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Mapping | None] = {}
        for b in batches:
            rows = []
            for x in b.column(1):
                try:
                    value = json.loads(x.as_py() or "null")
                    found = paths(value)
                except (ValueError, RecursionError):
                    value, found = None, set()
                mark = fingerprint(found)
                if mark not in known:
                    known[mark] = selected(found)
                mapping = known[mark] if isinstance(value, dict) else None
                rows.append((mark, mapping and mapping.name, mapping and "".join(turn(r, t) for r, t in canonical(value, mapping))))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in cols)], names=[key, "fingerprint", "layout", "formatted"])

    return records.select(F.col(key), F.col(record).cast("string")).mapInArrow(run, f"`{key}` {kind}, fingerprint string, layout string, formatted string")


def turn_records(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, record): a table with a row per turn, each as a JSON record of that layout."""
    return rows.select("conv_id", "turn", as_json(F.col("conv_id"), F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")))


def as_json(*columns) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("record")


def mixed_records(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, record): the same turns in four layouts, which a hash of conversation and turn picks.

    These are rows as they are, messages of role and content, conversations of from
    and value, and, where a user's turn is followed by an assistant's with the next
    number, both as prompt and completion, with the turn of the first.  Turns that
    share their number, or have none, are never joined.  Each conversation is dealt
    out to one task, where it stays.
    """
    rows = rows.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition(partitions(rows.sparkSession), "conv_id")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pick = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    at = {c: {k: (F.lead if k > 0 else F.lag)(c, abs(k)).over(w) for k in (-2, -1, 1, 2)} for c in ("turn", "role", "text")}
    alone = lambda before, own, after: ~before.eqNullSafe(own) & ~after.eqNullSafe(own)
    own = rows.select(
        "*",
        pick.alias("pick"),
        at["text"][1].alias("answer"),
        ((F.col("role") == "user") & (at["role"][1] == "assistant") & (at["turn"][1] == F.col("turn") + 1)
         & alone(at["turn"][-1], F.col("turn"), at["turn"][1]) & alone(F.col("turn"), at["turn"][1], at["turn"][2])).alias("asks"),
        ((F.col("role") == "assistant") & (at["role"][-1] == "user") & (at["turn"][-1] == F.col("turn") - 1)
         & alone(at["turn"][-2], at["turn"][-1], F.col("turn")) & alone(at["turn"][-1], F.col("turn"), at["turn"][1])).alias("answers"),
    )
    asked = F.pmod(F.xxhash64("conv_id", F.col("turn") - 1), F.lit(4)) == 3
    own = own.where(~F.coalesce(F.col("answers") & asked, F.lit(False)))
    one = lambda role, text: F.array(F.struct(F.col("role").alias(role), F.col("text").alias(text)))
    record = (
        F.when((F.col("pick") == 3) & F.col("asks"), as_json(F.col("text").alias("prompt"), F.col("answer").alias("completion")))
        .when(F.col("pick") == 1, as_json(F.col("conv_id").alias("id"), one("role", "content").alias("messages")))
        .when(F.col("pick") == 2, as_json(one("from", "value").alias("conversations")))
        .otherwise(as_json("conv_id", "turn", "role", "text"))
    )
    return own.select("conv_id", "turn", record.alias("record"))


def formatted_records(records: DataFrame, roles: dict[str, str] = ROLES) -> DataFrame:
    """(conv_id, turn, formatted): a row per turn of JSON records (conv_id, turn, record), mapped by fingerprint.

    The i-th turn of a record has its turn plus i.  Joined in the order of turn,
    then of formatted, the texts are the formatted conversation; no conversation
    need be held whole.  A record of no known layout ends the job with its
    fingerprint, as turns would be lost.
    """
    records = records.select("conv_id", "turn", "record")
    kinds = [records.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Mapping | None] = {}
        for b in batches:
            out = []
            for c, at, x in zip(*b.columns):
                value = json.loads(x.as_py() or "null")
                found = paths(value)
                mark = fingerprint(found)
                if mark not in known:
                    known[mark] = selected(found)
                if known[mark] is None:
                    raise ValueError(f"no layout is known for the fingerprint {mark}: {sorted(found)[:20]}")
                c, at = c.as_py(), at.as_py()
                out += [(c, at if at is None else at + i, turn(r, t)) for i, (r, t) in enumerate(canonical(value, known[mark], roles))]
            if out:
                types = [b.schema.field(0).type, b.schema.field(1).type, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), types)], names=["conv_id", "turn", "formatted"])

    return records.mapInArrow(run, f"conv_id {kinds[0]}, turn {kinds[1]}, formatted string")


def formatted_turns(rows: DataFrame) -> DataFrame:
    """formatted_records() of a table with a row per turn, which keeps its own words for roles.

    Null roles and texts are empty; repeated rows are turns of their own; a null
    conv_id is one conversation.
    """
    return formatted_records(turn_records(rows), {})


def digests(turns: DataFrame, dealt: bool = False) -> DataFrame:
    """What formatted_records() reads back as: a row per conversation.

    Conversations stream through their task in order, a turn at a time.  Those of
    mixed_records() are dealt out already, each to one task, and aren't shuffled again.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row():
            return (now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for b in batches:
            out = []
            for c, text in zip(b.column(0), b.column(1)):
                c, text = (c.as_py(),), text.as_py()
                if c != now:
                    if now is not None:
                        out.append(row())
                    now, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    if role == "assistant":
                        state[2] += len(said)
                        state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if out:
                yield batch(out, b.schema.field(0).type)
        if now is not None:
            yield batch([row()], b.schema.field(0).type)

    def batch(rows, first) -> pa.RecordBatch:
        kinds = [first, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=NAMES)

    turns = turns if dealt else turns.repartition(partitions(turns.sparkSession), "conv_id")
    return turns.sortWithinPartitions("conv_id", "turn", "formatted").select("conv_id", "formatted").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, whose rows would join those of a conversation -1 of the table, as records of four layouts."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    return digests(formatted_records(mixed_records(rows.union(probe)), {}), dealt=True)
