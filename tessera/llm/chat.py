"""Chat formatting: a finite-state machine over roles and a declarative template with loss flags.

A template states, for each role, the text before and after a turn and whether the turn's
text is trained on, the states of the machine, and the control strings that tokenizers act
on. A turn is written as prefix, role, separator, text, suffix. Control strings inside roles
and texts are broken by a backslash after their first character and backslashes are doubled,
so that no control string of the template survives in them and reading gives them back.

Edge cases: a null text or role is empty; a conversation whose roles the machine rejects is
formatted all the same, with valid false and the first bad turn; equal turn numbers are
ordered by role, then text, null turns first; null conv_ids form one conversation; repeated
rows are repeated turns; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import quoted


@dataclass(frozen=True)
class Template:
    """moves: state -> role -> next state; a conversation is valid if it ends in one of final."""

    begin: str = "<|turn|>"
    separator: str = "\n"
    end: str = "<|end|>\n"
    trained_roles: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("<|turn|>", "<|end|>", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("asked", "answered")

    def breaker(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, ["\\", *sorted(self.controls, key=len, reverse=True)])))

    def escape(self, text: str) -> str:
        return self.breaker().sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def escape_role(self, role: str) -> str:
        """As escape, and a newline (which ends the role) becomes backslash, n."""
        return self.escape(role).replace("\n", "\\n")

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    @staticmethod
    def unescape_role(role: str) -> str:
        return re.sub(r"\\(\\|n|)", lambda m: "\n" if m[1] == "n" else m[1], role)


SEGMENTS = "array<struct<text:string,loss:boolean>>"


def walk(template: Template, roles: list[str]) -> int | None:
    """The first turn that the machine rejects; len(roles) if it ends too early; None if valid."""
    state = template.start
    for i, role in enumerate(roles):
        state = template.moves.get(state, {}).get(role)
        if state is None:
            return i
    return None if state in template.final else len(roles)


def segments(template: Template, turns: list[tuple[str, str]]) -> list[tuple[str, bool]]:
    """Text segments in order, each with its loss flag; joined, they are the formatted text."""
    out, plain = [], ""
    for role, text in turns:
        plain += template.begin + template.escape_role(role) + template.separator
        if role in template.trained_roles:
            out += [(plain, False), (template.escape(text), True)]
            plain = template.end
        else:
            plain += template.escape(text) + template.end
    return [*out, (plain, False)] if plain else out


def read_back(template: Template, formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for part in formatted.split(template.begin)[1:]:
        role, _, text = part.partition(template.separator)
        text = text[: -len(template.end)]
        turns.append((template.unescape_role(role), template.unescape(text)))
    return turns


def format_chats(turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, segments (text, loss), valid, bad_turn: a row per conversation."""
    template = template or Template()
    said = F.struct(quoted(turn).alias("turn"), F.coalesce(quoted(role), F.lit("")).alias("role"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    grouped = turns.groupBy(quoted(conv).alias("_conv")).agg(F.sort_array(F.collect_list(said)).alias("_turns"))

    def run(batches):
        for batch in batches:
            cols = [[], [], [], []]
            for turns in batch.column(1).to_pylist():
                parts = segments(template, [(t["role"], t["text"]) for t in turns])
                bad = walk(template, [t["role"] for t in turns])
                for c, x in zip(cols, ("".join(p for p, _ in parts), [{"text": p, "loss": on} for p, on in parts], bad is None, bad), strict=True):
                    c.append(x)
            kinds = (pa.string(), pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["_conv", "formatted", "segments", "valid", "bad_turn"])

    kind = grouped.schema["_conv"].dataType.simpleString()
    out = grouped.mapInArrow(run, f"_conv {kind}, formatted string, segments {SEGMENTS}, valid boolean, bad_turn int")
    return out.withColumnRenamed("_conv", conv)


def digests(formatted: DataFrame, template: Template | None = None, conv: str = "conv_id") -> DataFrame:
    """What the formatted text and its segments say when read back, as counts and hashes."""
    template = template or Template()

    def run(batches):
        for batch in batches:
            n, sha, chars, loss_sha, size = [], [], [], [], []
            for text, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(template, text)
                loss = "".join(template.unescape(p["text"]) for p in parts if p["loss"])
                n.append(len(turns))
                sha.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                chars.append(len(loss))
                loss_sha.append(hashlib.sha256(loss.encode()).hexdigest())
                size.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(size, pa.int64()), batch.column(3)],
                names=["_conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"],
            )

    inside = formatted.select(quoted(conv).alias("_conv"), "formatted", "segments", "valid")
    kind = inside.schema["_conv"].dataType.simpleString()
    out = inside.mapInArrow(run, f"_conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
    return out.withColumnRenamed("_conv", conv)
