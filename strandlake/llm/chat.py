"""Transcript parsing by a hidden Markov model, and canonical rendering of turns.

A transcript is text of which only the lines are known. States are the roles, each
as the first line of a turn or a later one. A line's observation joins its speaker
marker (of several styles, or none) with line features: whether the line before
was blank, whether this one is (and then whether a marker follows), how long it is and
whether it asks. Start, transition and emission probabilities are counted over transcripts with known
roles that aren't held out; a Viterbi pass then finds the roles of any transcript
(``parse_transcripts``), or of conversations that are written out as transcripts
and parsed from their lines alone (``parse``).

A turn opens with a marker, which isn't part of its text, or with one blank line,
which isn't either; whether a blank line within a marked turn opens another is the
model's belief, from the turns that it was trained on. All else is kept as it stands: the canonical form of a turn is
``<|role|>``, a line end, the text, a line end.

No task holds a whole conversation: lines are cut into blocks of bounded size;
a block gives the best score from every entry state to every exit state, these
matrices are chained along the conversation, and every block is then traced
between the entry and exit states that the chain chose. ``parts`` are the lines of a
turn within a block; ``whole_turns`` joins them, so that a turn is one row again.

Conversations: null and empty texts are turns of one empty line. Equal rows are
one turn. Rows with a null conv_id are one conversation; null turns come last.
Roles that are null or unknown count as user. Transcripts: a null text is empty;
rows of one id with different texts are transcripts of their own, equal rows one.
Ties between paths go to the first state. Other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import written
from strandlake.session import ship

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # 2 r: first line of a turn of role r; 2 r + 1: a later line
SHARE_ROWS = 1000

#: Speaker markers by role and style: fixed values.
MARKERS = {
    "system": ("System: ", "SYSTEM> ", "[system] ", "### Instruction: "),
    "user": ("User: ", "HUMAN> ", "[user] ", "### Question: "),
    "assistant": ("Assistant: ", "BOT> ", "[assistant] ", "### Answer: "),
}
STYLES = 4
_MARKER = re.compile("(?:" + "|".join(f"(?P<{r}>" + "|".join(re.escape(m.strip()) for m in MARKERS[r]) + ")" for r in ROLES) + ") ?", re.IGNORECASE)
SYMBOLS = (len(ROLES) + 1) * 2 * 2 * 3 * 2
#: Observations of blank lines that a marker follows.
BEFORE_MARKER = [((before * 2 + 1) * 3 + 1) * 2 for before in (0, 1)]


def observe(lines: list[str], ahead: bool) -> np.ndarray:
    """Observation of each line of a block: marker, blank line before, blank, length class (of a blank line, whether a marker follows), question.

    ``ahead``: whether the next block begins with a marker, or there is none.
    """
    out = np.zeros(len(lines), np.int64)
    marks, blank_before = [_MARKER.match(line) for line in lines], False
    for k, (line, m) in enumerate(zip(lines, marks)):
        mark = ROLES.index(m.lastgroup) + 1 if m else 0
        blank, size = not line.strip(), len(line)
        length = int(marks[k + 1] is not None if k + 1 < len(lines) else ahead) if blank else 0 if size < 80 else 1 if size < 400 else 2
        out[k] = (((mark * 2 + blank_before) * 2 + blank) * 3 + length) * 2 + line.rstrip().endswith("?")
        blank_before = blank
    return out


def body_of(lines: list[str], opens: bool) -> list[str]:
    """Lines of a part that are its turn's text."""
    if not opens:
        return lines
    m = _MARKER.match(lines[0])
    if m:
        return [lines[0][m.end() :], *lines[1:]]
    return lines if lines[0].strip() else lines[1:]


class Hmm:
    """Log probabilities from counts, with a prior added to every count that the model allows."""

    def __init__(self, starts: np.ndarray, moves: np.ndarray, seen: np.ndarray):
        allowed = np.zeros((STATES, STATES), bool)
        allowed[:, 0::2] = True
        for r in range(len(ROLES)):
            allowed[2 * r, 2 * r + 1] = allowed[2 * r + 1, 2 * r + 1] = True
        with np.errstate(divide="ignore"):
            m = (moves + 1.0) * allowed
            self.move = np.log(m / m.sum(1, keepdims=True))
            s = np.zeros(STATES)
            s[0::2] = starts[0::2] + 1.0
            self.start = np.log(s / s.sum())
        # where nothing was counted, markers are taken to open a turn of their own role
        mark = np.arange(SYMBOLS) // (SYMBOLS // (len(ROLES) + 1)) - 1
        state = np.arange(STATES)[:, None]
        prior = np.where(mark < 0, 0.1, np.where((state % 2 == 0) & (state // 2 == mark), 1.0, 0.001))
        self.emit = np.log((seen + prior) / (seen + prior).sum(1, keepdims=True))
        # a blank line just before a marker or the transcript's end belongs to the turn that ends there
        self.emit[0::2, BEFORE_MARKER] -= 20.0

    def block(self, obs: np.ndarray) -> np.ndarray:
        """Best score from each state before the block to each state at its end."""
        best = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
        for o in obs.tolist():
            best = (best[:, :, None] + self.move[None]).max(1) + self.emit[:, o]
        return best

    def first_block(self, obs: np.ndarray) -> np.ndarray:
        """The same for a conversation's first block; every row is the start."""
        best = (self.start + self.emit[:, obs[0]])[None]
        for o in obs[1:].tolist():
            best = (best[:, :, None] + self.move[None]).max(1) + self.emit[:, o]
        return np.repeat(best, STATES, 0)

    def trace(self, obs: np.ndarray, entry: int | None, end: int | None) -> list[int]:
        """Best states of a block's lines from its entry state (None: the start) to its exit state (None: any)."""
        score = self.start if entry is None else self.move[entry]
        score, back = score + self.emit[:, obs[0]], []
        for o in obs[1:].tolist():
            step = score[:, None] + self.move
            back.append(step.argmax(0))
            score = step.max(0) + self.emit[:, o]
        state = int(score.argmax()) if end is None else end
        out = [state]
        for b in reversed(back):
            state = int(b[state])
            out.append(state)
        return out[::-1]


def written_out(conversations: DataFrame) -> DataFrame:
    """Raw lines of every turn as they stand in a transcript: (conv, at, tie, role, raw).

    Conversations are written in one of several marker styles; about one turn in
    eight lacks its marker and follows a blank line instead.
    """
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit((1 << 62))).alias("at"), role.alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    rows = rows.withColumn("tie", F.xxhash64("role", "text"))
    markers = F.create_map(*[x for r in ROLES for x in (F.lit(r), F.array(*map(F.lit, MARKERS[r])))])
    marker = F.get(markers[F.col("role")], F.pmod(F.xxhash64("conv"), F.lit(STYLES)).cast("int"))
    return rows.select("conv", "at", "tie", "role", F.concat(F.when(F.pmod("tie", F.lit(8)) == 0, "\n").otherwise(marker), "text").alias("raw"))


def lines_of(transcripts: DataFrame) -> DataFrame:
    """Raw lines of transcripts (conv_id, text), with no role."""
    text = F.coalesce("text", F.lit(""))
    rows = transcripts.select(F.concat_ws("/", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.hex(F.xxhash64(text))).alias("conv"), text.alias("text")).distinct()
    rows = rows.select("conv", F.posexplode(F.split("text", "\n", -1)).alias("at", "raw"))
    return rows.select("conv", F.col("at").cast("long").alias("at"), F.lit(0).cast("long").alias("tie"), F.lit(None).cast("string").alias("role"), "raw")


def in_blocks(rows: DataFrame, span: int) -> DataFrame:
    """Rows with the block that they are in: ranges of ``at``, and where a range is full ranges of its ties, so that no conversation or turn is one task."""
    rows = written(rows.withColumn("range", F.floor(F.col("at") / span)), "chat-rows")
    full = rows.groupBy("conv", "range").agg(F.count("*").alias("n"))
    most = max(1024, span)
    cut = F.greatest(F.lit(1), F.ceil(F.col("n") / most)).cast("double")
    wide = F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * cut).cast("long")
    cut_up = F.col("n") > most
    rows = rows.join(written(full, "chat-ranges"), ["conv", "range"]).withColumn("sub", F.when(cut_up, wide).otherwise(F.lit(0)))
    rows = rows.withColumn("own", F.when(cut_up, F.col("at")).otherwise(F.lit(-1)))
    return rows.select("conv", F.struct("range", "own", "sub").alias("block"), "at", "tie", "role", "raw")


class Block(NamedTuple):
    """A block's rows in order, of one conversation; ``ahead``, ``entry`` and ``leave`` are None where they aren't known yet."""

    conv: str
    nth: int
    raw: list[str]
    roles: list[str | None]
    ahead: bool
    entry: int | None
    leave: int | None

    def lines(self) -> list[str]:
        return "\n".join(self.raw).split("\n")

    def truth(self) -> np.ndarray | None:
        """The state that each line was written from; None where a role isn't known."""
        if None in self.roles:
            return None
        n = np.array([r.count("\n") + 1 for r in self.raw])
        out = np.repeat([2 * ROLES.index(r) + 1 for r in self.roles], n)
        out[np.cumsum(n) - n] -= 1
        return out


def _each(pdf: pd.DataFrame) -> Iterator[Block]:
    """The blocks of a share."""
    pdf = pdf.sort_values(["conv", "nth", "at", "tie", "role", "raw"], kind="stable", ignore_index=True)
    cells = {c: pdf[c].tolist() for c in ("conv", "nth", "raw", "role", "ahead")}
    known = {c: [None if pd.isna(x) else int(x) for x in pdf[c]] if c in pdf else [None] * len(pdf) for c in ("entry", "leave")}
    starts = [k for k in range(len(pdf)) if not k or (cells["conv"][k], cells["nth"][k]) != (cells["conv"][k - 1], cells["nth"][k - 1])]
    for a, b in zip(starts, [*starts[1:], len(pdf)]):
        roles = [None if r is None or r != r else r for r in cells["role"][a:b]]
        yield Block(cells["conv"][a], int(cells["nth"][a]), cells["raw"][a:b], roles, bool(cells["ahead"][a]), known["entry"][a], known["leave"][a])


def _counted(pdf: pd.DataFrame) -> pd.DataFrame:
    codes = []
    for own in _each(pdf):
        truth, obs = own.truth(), observe(own.lines(), own.ahead)
        codes += [truth * SYMBOLS + obs, STATES * SYMBOLS + truth[:-1] * STATES + truth[1:], [STATES * (SYMBOLS + STATES) + truth[0]]]
    k, n = np.unique(np.concatenate(codes).astype(np.int64), return_counts=True)
    return pd.DataFrame({"code": k, "n": n.astype(np.int64)})


def _dealt(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of their block in the conversation and a share, and (conv, nth) of all blocks."""
    marked = F.col("raw").rlike("(?i)^(?:" + "|".join(re.escape(m.strip()) for r in ROLES for m in MARKERS[r]) + ")")
    spans = blocks.groupBy("conv", "block").agg(F.min_by(marked, F.struct("at", "tie", "role", "raw")).alias("head"))
    order = Window.partitionBy("conv").orderBy("block")
    spans = written(spans.select("conv", "block", F.row_number().over(order).cast("int").alias("nth"), F.coalesce(F.lead("head").over(order), F.lit(True)).alias("ahead")), "chat-spans")
    # a task takes as many whole blocks as make about SHARE_ROWS rows
    share = F.pmod(F.xxhash64("conv", "nth"), F.lit(max(1, blocks.count() // SHARE_ROWS)))
    return written(blocks.join(spans, ["conv", "block"]).drop("block").withColumn("share", share), "chat-lines"), spans


def _trained(rows: DataFrame) -> Hmm:
    learn = rows.where(F.crc32(F.col("conv").cast("binary")) % 4 != 2)
    counts = learn.groupBy("share").applyInPandas(_counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(STATES * (SYMBOLS + STATES + 1))
    for r in counts:
        total[r["code"]] = r["n"]
    seen, moves, starts = np.split(total, [STATES * SYMBOLS, STATES * (SYMBOLS + STATES)])
    return Hmm(starts, moves.reshape(STATES, STATES), seen.reshape(STATES, SYMBOLS))


def train(conversations: DataFrame) -> Hmm:
    """Model from the conversations (conv_id, turn, role, text) that aren't held out; counts are of fixed size."""
    ship(conversations.sparkSession)
    return _trained(_dealt(in_blocks(written_out(conversations), 64))[0])


def _parsed(rows: DataFrame, spans: DataFrame, hmm: Hmm) -> DataFrame:
    """(conv, block, part, turn_no, role, opens, n_lines, n_body, body, right) of every part of a turn.

    ``n_lines`` counts its lines, ``n_body`` those that are its text; ``right`` those written from its role (null where none is known).
    """

    def scored(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own in _each(pdf):
            obs = observe(own.lines(), own.ahead)
            best = hmm.first_block(obs) if own.nth == 1 else hmm.block(obs)
            out.append((own.conv, own.nth, best.tobytes()))
        return pd.DataFrame(out, columns=["conv", "nth", "best"])

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        """Entry and exit state of each block on the best path."""
        pdf = pdf.sort_values("nth")
        score, back = np.zeros(STATES), []
        for raw in pdf["best"]:
            step = score[:, None] + np.frombuffer(raw).reshape(STATES, STATES)
            back.append(step.argmax(0))
            score = step.max(0)
        state, out = int(score.argmax()), []
        for b in reversed(back):
            out.append((int(b[state]), state))
            state = int(b[state])
        return pd.DataFrame({"conv": pdf["conv"], "nth": pdf["nth"], "entry": [e for e, _ in out[::-1]], "leave": [e for _, e in out[::-1]]})

    # conversations of one block need no chain
    many = written(spans.groupBy("conv").agg(F.max("nth").alias("blocks")), "chat-many")
    rows = rows.join(many, "conv")
    long = rows.where("blocks > 1")
    ends = long.groupBy("share").applyInPandas(scored, "conv string, nth int, best binary").groupBy("conv").applyInPandas(chained, "conv string, nth int, entry int, leave int")
    rows = rows.join(written(ends, "chat-ends"), ["conv", "nth"], "left")

    def traced(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own in _each(pdf):
            lines, truth = own.lines(), own.truth()
            truth = None if truth is None else truth // 2
            states = hmm.trace(observe(lines, own.ahead), None if own.nth == 1 else own.entry, own.leave)
            cuts = [k for k, s in enumerate(states) if s % 2 == 0 or k == 0] + [len(states)]
            for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                opens = states[a] % 2 == 0
                body = body_of(lines[a:b], opens)
                right = None if truth is None else int((truth[a:b] == states[a] // 2).sum())
                out.append((own.conv, own.nth, part, ROLES[states[a] // 2], opens, b - a, len(body), "\n".join(body), right))
        return pd.DataFrame(out, columns=["conv", "nth", "part", "role", "opens", "n_lines", "n_body", "body", "right"]).astype({"right": "Int64"})

    schema = "conv string, nth int, part int, role string, opens boolean, n_lines int, n_body int, body string, right int"
    parts = written(rows.groupBy("share").applyInPandas(traced, schema), "chat-parts")
    opened = parts.groupBy("conv", "nth").agg(F.sum(F.col("opens").cast("int")).alias("turns"))
    before = Window.partitionBy("conv").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(opened.select("conv", "nth", F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("base")), "chat-bases")
    within = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("conv", "nth").orderBy("part"))
    return parts.withColumn("k", within).join(bases, ["conv", "nth"]).select(
        "conv", F.col("nth").alias("block"), "part", (F.col("base") + F.col("k")).cast("long").alias("turn_no"), "role", "opens", "n_lines", "n_body", "body", "right"
    )


def whole_turns(parts: DataFrame) -> DataFrame:
    """(conv, turn_no, role, n_lines, rendered, right): the parts of every turn joined, in canonical form."""
    own = F.array_sort(F.collect_list(F.struct("block", "part", "n_body", "body")))
    turns = parts.groupBy("conv", "turn_no").agg(F.max_by("role", "opens").alias("role"), F.sum("n_lines").alias("n_lines"), F.sum("right").alias("right"), own.alias("own"))
    text = F.array_join(F.transform(F.filter("own", lambda p: p["n_body"] > 0), lambda p: p["body"]), "\n")
    return turns.select("conv", "turn_no", "role", "n_lines", F.concat(F.lit("<|"), "role", F.lit("|>\n"), text, F.lit("\n")).alias("rendered"), "right")


def parse(conversations: DataFrame) -> DataFrame:
    """Canonical turns of every conversation (conv_id, turn, role, text), parsed from its transcript's lines alone.

    (conv_id, turn_no, role, n_lines, rendered, right); roles train the model and
    tell how many lines are ``right``, but no line's role is looked at to parse it.
    """
    ship(conversations.sparkSession)
    rows, spans = _dealt(in_blocks(written_out(conversations), 64))
    return whole_turns(_parsed(rows, spans, _trained(rows))).select(F.when(F.col("conv") != "", F.col("conv").cast("long")).alias("conv_id"), "turn_no", "role", "n_lines", "rendered", "right")


def parse_transcripts(transcripts: DataFrame, hmm: Hmm) -> DataFrame:
    """Canonical turns (conv_id, conv, turn_no, role, n_lines, rendered) of raw transcripts (conv_id, text); ``conv`` tells an id's transcripts apart."""
    ship(transcripts.sparkSession)
    rows, spans = _dealt(in_blocks(lines_of(transcripts), 1024))
    turns = whole_turns(_parsed(rows, spans, hmm))
    own = F.regexp_extract("conv", "^(.*)/[0-9A-F]+$", 1)
    return turns.select(F.when(own != "", own).alias("conv_id"), "conv", "turn_no", "role", "n_lines", "rendered")
