"""Chat formatting: roles of a raw transcript's lines by a hidden Markov model, then canonical turns.

States are a role and whether a line opens a turn or goes on. What is seen of a line is its speaker marker (if any), its
length and whether a blank line stands before it. Transition and emission counts come from labelled transcripts and have a
fixed size whatever the corpus; Viterbi's recursion gives each transcript's most probable states, so that lines without a
marker, and words that only look like one, are read by what stands around them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import written
from tallyframe.llm.registry import query

ROLES = ("system", "user", "assistant")
STATES = [(role, opens) for role in ROLES for opens in (True, False)]
TURNS_A_PART = 64  # longer conversations are transcripts of several parts

# Words and signs that name a speaker
MARKERS = {
    "system": 1, "instructions": 1, "sys": 1, "#": 1,
    "user": 2, "human": 2, "q": 2, "customer": 2, ">": 2,
    "assistant": 3, "ai": 3, "a": 3, "bot": 3,
}
_MARKER = re.compile(r"\s*(?:\[?([A-Za-z]{1,12})\]?\s*[:\-]\s|([>#])\s)")
# A line of these alone is blank, in SQL and in Python: what str.isspace() takes for blanks
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LENGTHS = 8
SEEN = 4 * LENGTHS * 2
ADDED = (0.01, 10, 1)  # to the counts of markers, lengths and blank lines: a marker says more of a role than a length does


def marker(line: str) -> tuple[int, int]:
    """(class, end) of a line's speaker marker; (0, 0) without one."""
    m = _MARKER.match(line)
    kind = MARKERS.get((m[1] or m[2]).lower(), 0) if m else 0
    return (kind, m.end()) if kind else (0, 0)


def observed(lines: list[str]) -> list[int]:
    """What is seen of each line that is not blank."""
    out, blank = [], False
    for line in lines:
        if not line.strip(BLANKS):
            blank = True
            continue
        length = min(LENGTHS - 1, max(0, len(line).bit_length() - 3))
        out.append((marker(line)[0] * LENGTHS + length) * 2 + blank)
        blank = False
    return out


@dataclass(frozen=True)
class Model:
    """Logarithms of the first state's, the transitions' and the emissions' probabilities, from counts with a little added. What is
    seen of a line is emitted as three independent parts, its marker, its length and the blank line before it: a length
    that a state never had does not outweigh a marker."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def of(counts: pd.DataFrame) -> Model:
        n = len(STATES)
        start, move, emit = np.ones(n), np.ones((n, n)), np.ones((n, SEEN))
        for kind, i, j, c in counts.itertuples(index=False):
            if kind == "start":
                start[i] += c
            else:
                (move if kind == "move" else emit)[i, j] += c
        for k, (_, opens) in enumerate(STATES):
            if not opens:  # a transcript opens a turn, and a turn goes on as its own role
                start[k] = 0
                for j in range(n):
                    if STATES[j][0] != STATES[k][0]:
                        move[j, k] = 0
        cells = (emit - 1).reshape(n, -1, LENGTHS, 2)
        logs = np.zeros_like(cells)
        for axis, added in zip((1, 2, 3), ADDED, strict=True):
            part = cells.sum(axis=tuple({1, 2, 3} - {axis}), keepdims=True) + added
            logs = logs + np.log(part / part.sum(axis=axis, keepdims=True))
        with np.errstate(divide="ignore"):
            return Model(np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), logs.reshape(n, -1))


def viterbi(model: Model, seen: list[int]) -> list[int]:
    """The most probable states; of equally probable ones the first."""
    if not seen:
        return []
    best = model.start + model.emit[:, seen[0]]
    back = []
    for x in seen[1:]:
        paths = best[:, None] + model.move
        back.append(paths.argmax(0))
        best = paths.max(0) + model.emit[:, x]
    state = int(best.argmax())
    states = [state]
    for step in reversed(back):
        state = int(step[state])
        states.append(state)
    return states[::-1]


def turns(text: str, model: Model) -> tuple[list[str], list[tuple[str, str]]]:
    """(role of each line that is not blank, turns as role and content)."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    states = viterbi(model, observed(text.split("\n")))
    out: list[tuple[str, list[str]]] = []
    for line, s in zip(lines, states, strict=True):
        role, opens = STATES[s]
        if opens or not out:
            out.append((role, [line[marker(line)[1] :]]))
        else:
            out[-1][1].append(line)
    return [STATES[s][0] for s in states], [(role, "\n".join(x)) for role, x in out]


def rendered(found: list[tuple[str, str]]) -> str:
    """The canonical form: each turn between its role and an end mark."""
    return "".join(f"<|{role}|>\n{content}\n<|end|>\n" for role, content in found)


COUNTS = "kind string, i int, j int, n long"


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        counts: dict[tuple, int] = {}
        for text, states in zip(frame["text"], frame["states"], strict=True):
            seen = observed(text.split("\n"))
            for k, (x, s) in enumerate(zip(seen, states, strict=True)):
                for key in ((("move", int(states[k - 1]), int(s)) if k else ("start", int(s), 0)), ("emit", int(s), x)):
                    counts[key] = counts.get(key, 0) + 1
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", "i", "j", "n"])


def fitted(labelled: DataFrame) -> Model:
    """A model from (text, states) rows, states being those of the lines that are not blank. Without rows all is equally
    probable. The counts have a few hundred kinds."""
    return Model.of(labelled.select("text", "states").mapInPandas(_count, COUNTS).groupBy("kind", "i", "j").agg(F.sum("n").alias("n")).toPandas())


def parsed(transcripts: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The other columns with n_lines, n_turns, roles (of the lines) and rendered. NULL and blank texts have no turns."""
    rest = [c for c in transcripts.columns if c != text]
    kinds = ", ".join(f"`{c}` {t}" for c, t in transcripts.dtypes if c != text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [turns(t or "", model) for t in frame[text]]
            out = frame[rest].copy()
            out["n_lines"] = [len(roles) for roles, _ in found]
            out["n_turns"] = [len(x) for _, x in found]
            out["roles"] = [roles for roles, _ in found]
            out["rendered"] = [rendered(x) for _, x in found]
            yield out

    return transcripts.mapInPandas(run, f"{kinds}, n_lines long, n_turns long, roles array<string>, rendered string")


# ---- raw transcripts out of the conversations table ----------------------------------------------------------------

# How the speakers are named, by the conversation's number: system, user, assistant
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("Instructions: ", "Human: ", "AI: "),
    ("# ", "Q: ", "A: "),
    ("[system]: ", "> ", ""),
    ("SYS - ", "CUSTOMER - ", "BOT - "),
)


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, text, states): each conversation as one text, in a style of its own, every tenth marker missing.

    Conversations of more than TURNS_A_PART turns give a text per so many. Turns without a text are left out; repeated rows
    are one turn; a role that is none of the three counts as the assistant's; a row without a conversation stands alone.
    """
    role = F.coalesce(F.array_position(F.lit(list(ROLES)), F.coalesce("role", F.lit(""))), F.lit(0))
    role = F.when(role == 0, len(ROLES)).otherwise(role).cast("int")
    number = F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0).cast("bigint"))
    styles = F.lit([list(s) for s in STYLES])
    missing = F.pmod(number * 7 + F.coalesce("turn", F.lit(0)) * 3, F.lit(10)) == 0
    mark = F.when(missing, "").otherwise(F.element_at(F.element_at(styles, (F.pmod(number, F.lit(len(STYLES))) + 1).cast("int")), role))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    part = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(F.coalesce(F.floor(F.col("turn") / TURNS_A_PART), F.lit(-1)).cast("bigint"))
    said = conversations.select("conv_id", part.alias("part"), "turn", role.alias("role"), lines.alias("lines"), mark.alias("mark")).filter(F.size("lines") > 0)
    shown = said.select("conv_id", "part", F.struct(
        "turn", F.concat("mark", F.array_join("lines", "\n")).alias("text"),
        F.transform("lines", lambda _, i: (F.col("role") - 1) * 2 + F.when(i == 0, 0).otherwise(1)).alias("states"),
    ).alias("t"))
    joined = shown.groupBy("conv_id", "part").agg(F.sort_array(F.collect_set("t")).alias("t"))
    between = F.when(F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(2)) == 0, "\n\n").otherwise("\n")
    return joined.select("conv_id", "part", F.col("t.text").alias("texts"), between.alias("between"), F.flatten("t.states").alias("states")).select(
        "conv_id", "part", F.expr("array_join(texts, between)").alias("text"), "states"
    )


def _held_out(conv_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(conv_id.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


@query("op1_transcripts")
def op1_transcripts(spark, sf_dir):
    """Every conversation, its roles recovered from the raw text. The model has seen nine tenths of them."""
    made = written(raw_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "transcripts")
    model = fitted(made.filter(~_held_out(F.col("conv_id"))))
    truth = F.transform("states", lambda s: F.element_at(F.lit(list(ROLES)), (F.floor(s / 2) + 1).cast("int")))
    found = parsed(made.select("conv_id", "part", "text", truth.alias("truth")), model)
    right = F.size(F.filter(F.zip_with("truth", "roles", lambda a, b: a == b), lambda x: x))
    return found.select(
        "conv_id", "part", _held_out(F.col("conv_id")).alias("held_out"), "n_lines", "n_turns", right.cast("bigint").alias("n_right"), "rendered"
    )
