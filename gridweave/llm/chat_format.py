"""Transcript parsing and canonical chat rendering.

A hidden Markov model reads a conversation line by line. Its states are the
roles, each at the start of a turn or inside one; what it sees of a line are the
speaker marker (if any), the line's length, whether it asks, whether a recorded
turn starts there, and whether a blank line came before. Viterbi's algorithm
finds the best sequence of states; each turn that begins gets one canonical form.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import released
from gridweave.session import stored

ROLES = ("system", "user", "assistant")
#: Turns, and characters, of a chunk; longer conversations are decoded in chunks that a scan joins.
CHUNK_TURNS, CHUNK_CHARS = 256, 1 << 20
#: Characters of text that a range of the ordered conversations holds.
RANGE_CHARS = 32 << 20

# Names under which the roles go in transcripts.
_NAMES = {
    "system": "system",
    "instruction": "system",
    "instructions": "system",
    "user": "user",
    "human": "user",
    "you": "user",
    "question": "user",
    "q": "user",
    "assistant": "assistant",
    "ai": "assistant",
    "bot": "assistant",
    "model": "assistant",
    "answer": "assistant",
    "a": "assistant",
}
_MARKER = re.compile(r"\s*(?:<\|(\w+)\|>|\[(\w+)\]|#{1,4}\s*(\w+)\s*:?\s*$|\*\*(\w+)\s*:?\*\*:?|(\w+)\s*[:>])\s*", re.IGNORECASE)
#: Steps of the logarithm of a line's length, and all kinds of what can be seen of a line without its marker.
_LENGTHS = 8
_KINDS = _LENGTHS * 2 * 2


def marker(line: str) -> tuple[str | None, str]:
    """(role, rest): the role that a speaker marker at the start of a line names, and the line without it."""
    found = _MARKER.match(line)
    if found:
        role = _NAMES.get(next(g for g in found.groups() if g).lower())
        if role:
            return role, line[found.end() :]
    return None, line


def _kind(line: str, opens: bool) -> int:
    length = min(_LENGTHS - 1, int(math.log2(len(line) + 1)) // 2 + (len(line) > 400) + (len(line) > 800))
    return (length * 2 + ("?" in line)) * 2 + opens


def lines_of(text: str, recorded: bool) -> list[tuple[str, str | None, int, bool]]:
    """(line without its marker, marked role, kind, gap) of a text's lines that are not blank; of a blank text one empty line.

    gap: a blank line, or the start of the text, comes before. recorded: the text is a
    recorded turn, so only its first line opens one for sure.
    """
    out, gap = [], True
    for line in text.split("\n"):
        if not line.strip():
            gap = True
            continue
        role, rest = marker(line)
        out.append((rest, role, _kind(rest, not out if recorded else gap), gap))
        gap = False
    return out or ([("", None, _kind("", True), True)] if recorded else [])


class Hmm:
    """Log probabilities: start of each role, next role after a turn, kind of line by role, marker by role.

    States 0 to r - 1 are the first line of a turn, r to 2r - 1 a later line, by role.
    """

    def __init__(self, kinds: np.ndarray | None = None, starts: np.ndarray | None = None, steps: np.ndarray | None = None):
        """Counts by role of kinds of lines, of first turns, and of next roles; None for what is not known.

        What is counted is added to what transcripts are like at large: a system turn
        comes first or not at all, users and assistants take turns.
        """
        r = len(ROLES)
        counts = np.ones((r, _KINDS)) if kinds is None else kinds + 0.5
        self.kind = np.log(counts / counts.sum(axis=1, keepdims=True))
        start = 4 * np.array([0.3, 0.68, 0.02]) + (0 if starts is None else starts)
        step = 4 * np.array([[0.02, 0.96, 0.02], [0.01, 0.04, 0.95], [0.01, 0.95, 0.04]]) + (0 if steps is None else steps)
        self.next = np.log(step / step.sum(axis=1, keepdims=True))
        self.first = np.r_[np.log(start / start.sum()), np.full(r, -1e9)]
        self.step = np.full((2 * r, 2 * r), -1e9)
        self.step[:r, :r] = self.step[r:, :r] = self.next
        self.step[:r, r:] = self.step[r:, r:] = np.where(np.eye(r, dtype=bool), 0.0, -1e9)
        self.marked, self.unmarked = math.log(0.97), math.log(0.015)

    def scores(self, lines, recorded: bool) -> np.ndarray:
        """[line, state] of the lines of a text."""
        r, at = len(ROLES), {role: k for k, role in enumerate(ROLES)}
        emissions = self.kind[:, [kind for _, _, kind, _ in lines]].T
        out = np.empty((len(lines), 2 * r))
        for k, (_, role, _, gap) in enumerate(lines):
            e = emissions[k]
            if role is not None:
                e = e + self.unmarked
                e[at[role]] += self.marked - self.unmarked
            if recorded:
                # a recorded turn starts one; inside it only a marker speaks for another
                opens = 1.0 if not k else 0.9 if role is not None else 0.002
            else:
                opens = 0.98 if role is not None else 0.6 if gap else 0.04
            out[k, :r], out[k, r:] = e + math.log(opens), e + (math.log(1 - opens) if opens < 1 else -1e9)
        return out


def viterbi(scores: np.ndarray, step: np.ndarray, first: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """The best path: scores [time, state], step [state, state], first and last: additions at the ends."""
    best, back = first + scores[0], np.zeros(scores.shape, dtype=np.int64)
    for t in range(1, len(scores)):
        ways = best[:, None] + step
        back[t] = ways.argmax(axis=0)
        best = ways.max(axis=0) + scores[t]
    path = np.zeros(len(scores), dtype=np.int64)
    path[-1] = (best if last is None else best + last).argmax()
    for t in range(len(scores) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def through(scores: np.ndarray, step: np.ndarray) -> np.ndarray:
    """[first state, last state]: the best score of a path between them."""
    best = np.where(np.eye(len(step), dtype=bool), 0.0, -1e9) + scores[0][None, :]
    for e in scores[1:]:
        best = (best[:, :, None] + step[None, :, :]).max(axis=1) + e[None, :]
    return best


def chained(parts: list[np.ndarray], step: np.ndarray) -> np.ndarray:
    """:func:`through` of chunks that follow one another."""
    best = parts[0]
    for m in parts[1:]:
        best = ((best[:, :, None] + step[None, :, :]).max(axis=1)[:, :, None] + m[None, :, :]).max(axis=1)
    return best


def ends(parts: list[np.ndarray], step: np.ndarray, first: np.ndarray, last: np.ndarray | None = None) -> list[tuple[int, int]]:
    """The states at the first and last line of each chunk on the best path through all of them."""
    best, back = first, []
    for k, m in enumerate(parts):
        into = best if not k else (best[:, None] + step).max(axis=0)
        before = None if not k else (best[:, None] + step).argmax(axis=0)
        ways = into[:, None] + m
        back.append((ways.argmax(axis=0), before))
        best = ways.max(axis=0)
    at, found = int((best if last is None else best + last).argmax()), []
    for first_of, before in reversed(back):
        start = int(first_of[at])
        found.append((start, at))
        at = int(before[start]) if before is not None else start
    return found[::-1]


def turns_of(lines, path: np.ndarray) -> list[tuple[str, str]]:
    """(role, text) of the turns that begin in the lines; the first line begins one."""
    turns: list[tuple[str, list[str]]] = []
    for (rest, _, _, gap), state in zip(lines, path):
        if state < len(ROLES) or not turns:
            turns.append((ROLES[state % len(ROLES)], [rest]))
        else:
            turns[-1][1].append(("\n\n" if gap else "\n") + rest)
    return [(role, "".join(parts)) for role, parts in turns]


def parse_transcript(text: str, model: Hmm | None = None) -> list[tuple[str, str]]:
    """(role, text) turns of a raw transcript, found line by line.

    Inside a turn a line keeps its role unless a marker or a blank line speaks for
    a change. Blank lines between turns and the markers go; what one role says after a
    blank line goes on with its turn.
    """
    model = model or Hmm()
    lines = lines_of(text, False)
    if not lines:
        return []
    path = viterbi(model.scores(lines, False), model.step, model.first)
    turns: list[tuple[str, str]] = []
    for k, (role, words) in enumerate(turns_of(lines, path)):
        if turns and turns[-1][0] == role:
            turns[-1] = (role, turns[-1][1] + "\n\n" + words)
        else:
            turns.append((role, words))
    return turns


def render(role: str, text: str) -> str:
    """One turn in canonical form; characters that would end it early are escaped."""
    return f"<|{role}|>\n" + text.strip().replace("<|", "<​|") + "\n<|end|>\n"


def _ordered(conversations: DataFrame, *columns: str) -> DataFrame:
    """conv_id, turn, _h (a hash of the text) and ``columns``, in ranges of that order, sorted within partitions.

    No range need hold a whole conversation, or all rows of one turn: rows that agree
    in conv_id and turn are dealt by the hash of their texts.
    """
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(text).alias("_h"), *columns, *([] if "text" in columns else [F.length(text).alias("_chars")]))
    size = conversations.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    parts = max(1, min(20_000, size[0] // RANGE_CHARS + size[1] // 1_000_000 + 1, max(1, size[1])))
    order = (F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("_h"))
    # rows that are equal in all three may still go to different ranges
    return rows.repartitionByRange(max(parts, conversations.sparkSession.sparkContext.defaultParallelism), *order).sortWithinPartitions(*order)


def train(conversations: DataFrame) -> Hmm:
    """Count kinds of lines by role, first roles and next roles over all turns that name a role; the counts have a fixed size."""
    r = len(ROLES)
    at = {role: k for k, role in enumerate(ROLES)}

    def lines(batches):
        counts = np.zeros((r, _KINDS), dtype=np.int64)
        for batch in batches:
            for role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for _, _, kind, _ in lines_of(text or "", True):
                    counts[at[role], kind] += 1
        role, kind = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(role), pa.array(kind), pa.array(counts[role, kind])], names=["role", "kind", "n"])

    def steps(batches):
        """Next roles inside a range by count; its first and last rows, for what goes over its borders."""
        counts, before, first = np.zeros((r, r), dtype=np.int64), None, None
        starts = np.zeros(r, dtype=np.int64)
        for batch in batches:
            for conv, role in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = at.get(role, -1)
                if before is None:
                    first = (conv, k)
                elif conv != before[0]:
                    starts[k] += k >= 0
                elif k >= 0 and before[1] >= 0:
                    counts[before[1], k] += 1
                before = (conv, k)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), *(pa.array([x], pa.int64()) for x in (first[0], first[1], before[0], before[1])), pa.array([counts.ravel().tolist()]), pa.array([starts.tolist()])], names=["part", "c0", "r0", "c1", "r1", "steps", "starts"])

    roled = conversations.withColumn("role", F.lower("role"))
    kinds = np.zeros((r, _KINDS))
    for row in roled.where(F.col("role").isin(*ROLES)).select("role", "text").mapInArrow(released(lines), "role long, kind long, n long").groupBy("role", "kind").agg(F.sum("n").alias("n")).collect():
        kinds[row["role"], row["kind"]] = row["n"]
    follow, starts, last = np.zeros((r, r)), np.zeros(r), None
    ranges = _ordered(roled, "role").select("conv_id", "role").mapInArrow(released(steps), "part long, c0 long, r0 long, c1 long, r1 long, steps array<long>, starts array<long>")
    for row in sorted(ranges.collect()):  # one row per range
        follow += np.array(row["steps"]).reshape(r, r)
        starts += row["starts"]
        if last is None or last[0] != row["c0"]:
            starts[row["r0"]] += row["r0"] >= 0
        elif row["r0"] >= 0 and last[1] >= 0:
            follow[last[1], row["r0"]] += 1
        last = (row["c1"], row["r1"])
    return Hmm(kinds if kinds.sum() else None, starts, follow)


_TURN = "turn long, part int, role_pred string, rendered string"


def _rendered(model: Hmm, turns: list, lines: list, path: np.ndarray) -> list[dict]:
    """The recovered turns of recorded ones: lines holds those of each, path the states of all."""
    out, start = [], 0
    for turn, own in zip(turns, lines):
        for k, (role, text) in enumerate(turns_of(own, path[start : start + len(own)])):
            out.append({"turn": turn, "part": k, "role_pred": role, "rendered": render(role, text)})
        start += len(own)
    return out


def format_conversations(conversations: DataFrame, model: Hmm | None = None) -> DataFrame:
    """conv_id, turn, part, role_pred, rendered: every recovered turn with its role, in canonical form.

    A recorded turn starts a turn, and a line inside it starts another where the
    model says so, as where it has another speaker's marker: those are parts 1, 2, ...
    of the recorded turn. The recorded roles only serve to count (:func:`train`);
    decoding does not see them. The order is that of ``turn`` (null first); rows with
    the same turn follow one another by a hash of their texts.

    The rows are ordered once, by range, so that no task needs a whole conversation.
    Conversations that lie inside a range and one chunk are decoded at once. Others
    become chunks, each with its best scores between any states at its ends (a small
    matrix); scans over those matrices, first within ranges and then over ranges, fix
    the states at the chunks' ends, and each chunk is traced alone.

    Null and blank texts are empty turns; null conv_ids are one conversation; repeated
    rows are turns each; an empty table gives an empty result; columns other than
    conv_id, turn, role and text are not read.
    """
    model = model or train(conversations)
    turn_type = pa.struct([("turn", pa.int64()), ("part", pa.int32()), ("role_pred", pa.string()), ("rendered", pa.string())])

    def decode(texts):
        lines = [lines_of(t or "", True) for t in texts]
        return lines, np.concatenate([model.scores(own, True) for own in lines])

    def chunks(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []  # (turn, text) of the chunk at hand
        # first: the conversation may have begun in the range before; cut: earlier chunks of it are out; open_end: it may go on in the next range
        state = {"conv": None, "chars": 0, "first": True, "cut": False, "open_end": False}

        def row(done, best, out):
            turns, texts = ([], []) if done else ([t for t, _ in held], [x for _, x in held])
            return {"conv_id": state["conv"], "range": part, "chunk": number, "best": best, "done": out, "turns": turns, "texts": texts}

        def closed(last: bool):
            """The chunk at hand as a row; last: of its conversation in this range."""
            nonlocal number
            lines, scores = decode([x for _, x in held])
            if last and not state["cut"] and not state["first"] and not state["open_end"]:
                path = viterbi(scores, model.step, model.first)
                made = row(True, [], _rendered(model, [t for t, _ in held], lines, path))
            else:
                made = row(False, through(scores, model.step).ravel().tolist(), [])
            number += 1
            held.clear()
            state["chars"] = 0
            state["cut"] = not last
            return made

        def batch_of(rows):
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("range", pa.int32()), ("chunk", pa.int32()), ("best", pa.list_(pa.float64())), ("done", pa.list_(turn_type)), ("turns", pa.list_(pa.int64())), ("texts", pa.list_(pa.string()))]))

        for batch in batches:
            rows = []
            for conv, turn, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if held and conv != state["conv"]:
                    rows.append(closed(True))
                    state["first"], state["cut"] = False, False
                elif held and (len(held) >= CHUNK_TURNS or state["chars"] >= CHUNK_CHARS):
                    rows.append(closed(False))
                state["conv"] = conv
                held.append((turn, text))
                state["chars"] += len(text or "")
            if rows:
                yield batch_of(rows)
        if held:
            state["open_end"] = True
            yield batch_of([closed(True)])

    found = stored(_ordered(conversations, "text").select("conv_id", "turn", "text").mapInArrow(released(chunks), f"conv_id long, range int, chunk int, best array<double>, done array<struct<{_TURN.replace(' long', ':long').replace(' int', ':int').replace(' string', ':string')}>>, turns array<long>, texts array<string>"))
    now = found.where(F.size("best") == 0).select("conv_id", F.explode("done").alias("_t")).select("conv_id", "_t.*")
    later = found.where(F.size("best") > 0)
    n = 2 * len(ROLES)
    square = lambda column: [np.array(b).reshape(n, n) for b in column.to_pylist()]
    at = lambda k: np.where(np.arange(n) == k, 0.0, -1e9)

    def composed(part: pa.Table) -> pa.Table:
        part = part.sort_by("chunk")
        return pa.table({"conv_id": part.column("conv_id")[:1], "range": part.column("range")[:1], "best": pa.array([chained(square(part.column("best")), model.step).ravel().tolist()])})

    def over_ranges(part: pa.Table) -> pa.Table:
        part = part.sort_by("range")
        fixed = ends(square(part.column("best")), model.step, model.first)
        return pa.table({"conv_id": part.column("conv_id"), "range": part.column("range"), "first": pa.array([f for f, _ in fixed], pa.int32()), "last": pa.array([l for _, l in fixed], pa.int32())})

    def over_chunks(part: pa.Table) -> pa.Table:
        part = part.sort_by("chunk")
        fixed = ends(square(part.column("best")), model.step, at(part.column("first")[0].as_py()), at(part.column("last")[0].as_py()))
        return pa.table({"_c": part.column("conv_id"), "_r": part.column("range"), "_k": part.column("chunk"), "first": pa.array([f for f, _ in fixed], pa.int32()), "last": pa.array([l for _, l in fixed], pa.int32())})

    def traced(batches):
        for batch in batches:
            rows = []
            for conv, turns, texts, first, last in zip(*(batch.column(k).to_pylist() for k in range(5))):
                lines, scores = decode(texts)
                path = viterbi(scores, model.step, at(first), at(last))
                rows += [{"conv_id": conv, **t} for t in _rendered(model, turns, lines, path)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), *((f.name, f.type) for f in turn_type)]))

    small = later.select("conv_id", "range", "chunk", "best")
    by_range = small.groupBy("conv_id", "range").applyInArrow(composed, "conv_id long, range int, best array<double>")
    fixed = by_range.groupBy("conv_id").applyInArrow(over_ranges, "conv_id long, range int, first int, last int")
    fixed = fixed.select(F.col("conv_id").alias("_c"), F.col("range").alias("_r"), "first", "last")
    inside = small.join(fixed, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("range") == F.col("_r"))).drop("_c", "_r")
    borders = stored(inside.groupBy("conv_id", "range").applyInArrow(over_chunks, "_c long, _r int, _k int, first int, last int"))
    keyed = later.join(borders, (F.col("range") == F.col("_r")) & (F.col("chunk") == F.col("_k")))
    return now.unionByName(keyed.select("conv_id", "turns", "texts", "first", "last").mapInArrow(released(traced), "conv_id long, " + _TURN))
