"""Chat formatting: repair of role sequences at least cost, then rendering.

A legal conversation follows an automaton: an optional system turn, then user and assistant in turn, with
tool turns between assistant turns, and an assistant turn at the end. Each input turn is kept (0),
merged into the turn before it if that has its role (1), or relabelled (3; 2 where the role is
missing or unknown); before it, and at the end, empty turns may be inserted (2 each). Dynamic programming over the
automaton's states finds the cheapest repair.

A step's costs form a min-plus matrix over the states, so blocks of a long conversation multiply to
one matrix each. Walking the matrices back from a conversation's end gives each block what the turns behind it cost from each state; with
that each block finds its own way from any state that it may be entered in, and walking forward chooses among them. So
no task needs more than one block, however long the conversation, and where the blocks begin changes nothing in the result.

Rows are range-partitioned in the order of their turns and cut into blocks where they lie, so a block has `block_turns` rows at
most whatever the numbers of its turns are: null, repeated or far apart. The walks over a conversation's blocks are streams of sorted rows.

Defined results: turns are ordered by turn number (null last), then role (null first), then a hash of the text, then text;
repeated rows are turns of their own; a null text is empty; rows with a null conversation id form one conversation; an
empty table gives no rows. A control string inside a text is no control string of the rendering: a backslash goes behind its first
character (and one more where backslashes stand there already), so that `unescaped` gives the text back. Among repairs of equal cost the one with fewer inserted turns
goes first, then the one whose turns' roles come first in the listed order, from the first turn on; a step from one state to another keeps rather than merges, and merges rather than relabels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import quoted
from furrow.session import ensure_checkpoint_dir, shuffle_width

ROLES = ("system", "user", "assistant", "tool")
START = 4  # the state before the first turn; others are the role of the turn before
STATES = 5
#: Role of the next turn -> states it may follow.
FOLLOWS = {0: (START,), 1: (START, 0, 2), 2: (1, 3), 3: (2,)}
FINAL = 2
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 1, 3, 2, 2
#: Turns of one block.
BLOCK_TURNS = 4_096

OPEN, CLOSE, BETWEEN = "<|im_start|>{role}\n", "<|im_end|>\n", "\n\n"


_CONTROL = re.compile(r"<(\\*)(?=\|im_(?:start|end)\|>)")


def escaped(text: str) -> str:
    """The text without control strings of the rendering."""
    return _CONTROL.sub(r"<\1\\", text)


def unescaped(text: str) -> str:
    """The text that `escaped` was given."""
    return re.sub(r"<(\\*)\\(?=\|im_(?:start|end)\|>)", r"<\1", text)


def _insertions() -> list[list[tuple[int, ...] | None]]:
    """The shortest run of inserted turns between each two states."""
    found: list[list[tuple[int, ...] | None]] = [[() if a == b else None for b in range(STATES)] for a in range(STATES)]
    for a in range(STATES):
        edge = [a]
        while edge:
            grown = []
            for s in edge:
                for role in range(len(ROLES)):
                    if s in FOLLOWS[role] and found[a][role] is None:
                        found[a][role] = (*found[a][s], role)
                        grown.append(role)
            edge = grown
    return found


INSERTED = _insertions()


def _steps(role: int | None) -> list[list[tuple[int, str, int, tuple[int, ...]] | None]]:
    """For each two states the cheapest way through one turn: cost, operation, inserted turns."""
    out: list[list[tuple | None]] = [[None] * STATES for _ in range(STATES)]
    for a in range(STATES):
        for to in range(len(ROLES)):
            other = 0 if role == to else RELABEL if role is not None else RELABEL_UNKNOWN
            ways = []
            for s in FOLLOWS[to]:
                if INSERTED[a][s] is not None:
                    n = len(INSERTED[a][s])
                    ways.append((other + n * INSERT, 0 if not other else 2, n, s, "keep" if not other else "relabel", INSERTED[a][s]))
            if a == to:
                ways.append((other + MERGE, 1, 0, a, "merge", ()))
            if ways:
                cost, _, n, _, op, inserted = min(ways)
                out[a][to] = (cost, op, n, inserted)
    return out


STEP = {role: _steps(role) for role in (None, 0, 1, 2, 3)}


def role_number(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else None


#: What a step weighs: its cost, and then the turns that it inserts.
UNIT = 1 << 32
FAR = 1 << 61
WEIGHT = {role: [[FAR if x is None else x[0] * UNIT + len(x[3]) for x in row] for row in step] for role, step in STEP.items()}


def block_matrix(roles: list[int | None]) -> list[int]:
    """The least weight from each state to each state through the turns, row by row."""
    rows = [[0 if a == b else FAR for b in range(STATES)] for a in range(STATES)]
    for role in roles:
        w = WEIGHT[role]
        rows = [[min(FAR, min(row[a] + w[a][b] for a in range(STATES))) for b in range(STATES)] for row in rows]
    return [c for row in rows for c in row]


def closing(state: int) -> tuple[int, ...] | None:
    """The turns inserted after the last one."""
    return INSERTED[state][FINAL]


#: What it takes to end a conversation in each state.
ENDING = [FAR if closing(s) is None else len(closing(s)) * (INSERT * UNIT + 1) for s in range(STATES)]


def before_block(matrix: list[int], behind: list[int]) -> list[int]:
    """What a block and all behind it weigh from each state, given what is behind it."""
    return [min(FAR, min(matrix[a * STATES + b] + behind[b] for b in range(STATES))) for a in range(STATES)]


def to_go(roles: list[int | None], behind: list[int]) -> list[list[int]]:
    """What is left from each state before each turn, and behind the last."""
    out = [behind]
    for role in reversed(roles):
        w, after = WEIGHT[role], out[-1]
        out.append([min(FAR, min(w[a][b] + after[b] for b in range(STATES))) for a in range(STATES)])
    return out[::-1]


def repair(roles: list[int | None], entry: int, behind: list[int]) -> list[tuple[str, int, tuple[int, ...]]]:
    """For each turn: operation, role, and the turns inserted before it; of ways of equal weight the one whose states come first."""
    left, state, out = to_go(roles, behind), entry, []
    for k, role in enumerate(roles):
        w, after = WEIGHT[role][state], left[k + 1]
        to = min(range(STATES), key=lambda b: (w[b] + after[b], b))
        _, op, _, inserted = STEP[role][state][to]
        out.append((op, to, inserted))
        state = to
    return out


def passages(roles: list[int | None], behind: list[int]) -> list[int]:
    """For each state that a block may be entered in: the state behind it, and how many turns it inserts."""
    left, out = to_go(roles, behind), []
    for entry in range(STATES):
        if left[0][entry] >= FAR:
            out += [-1, 0]
            continue
        steps = repair(roles, entry, behind)
        out += [steps[-1][1] if steps else entry, sum(len(x[2]) for x in steps)]
    return out


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of equal keys of sorted rows; one run is held at a time."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_keys] != key and held:
                yield key, held
                held = []
            key = row[:n_keys]
            held.append(row[n_keys:])
    if held:
        yield key, held


def repair_chats(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_turns: int = BLOCK_TURNS
) -> DataFrame:
    """The repaired and rendered turns, a row for each piece.

    Columns: conv_id, piece (from 0 on in each conversation), turn (null if inserted), role, op (keep, relabel, merge, insert), cost
    (of the whole conversation), rendered. The pieces' texts, in order, are the rendered conversation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    conv, turn, role, text = (F.col(quoted(c)) for c in (conv_col, turn_col, role_col, text_col))
    rows = df.select(
        conv.cast("long").alias("c"),
        turn.cast("long").alias("n"),
        role.cast("string").alias("r"),
        F.xxhash64(text.cast("string")).alias("h"),
        # Rows alike in all that counts may lie on both sides of a border of partitions.
        F.monotonically_increasing_id().alias("u"),
        text.cast("string").alias("t"),
    )
    order = ["c", F.col("n").asc_nulls_last(), F.col("r").asc_nulls_first(), "h", "u"]
    laid = rows.repartitionByRange(shuffle_width(df.sparkSession, rows), *order).sortWithinPartitions(*order[:4], F.col("t").asc_nulls_first())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, left, conv, row = TaskContext.get().partitionId() << 32, 0, (), 0
        for batch in batches:
            found = []
            for c in batch.column(0).to_pylist():
                if left == 0 or (c,) != conv:
                    block, left, conv = block + 1, block_turns, (c,)
                left -= 1
                found.append(block)
            place = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            kept = [batch.column(k) for k in ("c", "n", "r", "t")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), place, *kept], names=["b", "p", "c", "n", "r", "t"])

    schema = "b long, p long, c long, n long, r string, t string"
    numbered = laid.mapInArrow(number, schema).checkpoint()

    long_list = pa.list_(pa.int64())

    def table(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (c, b), held in _groups(batches, 2):
            yield table([(c, b, block_matrix([role_number(x[0]) for x in held]))], c=pa.int64(), b=pa.int64(), m=long_list)

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: tuple = ()
        behind = ENDING
        for batch in batches:
            out = []
            for c, b, m in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                behind = behind if (c,) == conv else ENDING
                conv = (c,)
                out.append((c, b, behind))
                behind = before_block(m, behind)
            if out:
                yield table(out, c=pa.int64(), b=pa.int64(), behind=long_list)

    # What is behind a block travels as its first row, so that no join can tear a block apart.
    def with_first(rows: DataFrame, first: DataFrame, *columns: str, width: int | None = None) -> DataFrame:
        both = rows.withColumn("behind", F.lit(None).cast("array<long>")).unionByName(first, allowMissingColumns=True)
        dealt = both.repartition(width, "c", "b") if width else both.repartition("c", "b")
        return dealt.sortWithinPartitions("c", "b", F.col("behind").isNull(), "p").select("c", "b", *columns)

    # Roles are small, but each takes a step of the dynamic programme: more tasks than their bytes ask for.
    width = shuffle_width(df.sparkSession, numbered.select("c", "b", "r"), mb_each=4)
    blocks = numbered.select("c", "b", "r").mapInArrow(_batched(matrices), "c long, b long, m array<long>")
    back = blocks.repartition(width, "c").sortWithinPartitions("c", F.col("b").desc()).mapInArrow(backward, "c long, b long, behind array<long>").checkpoint()

    def crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (c, b), held in _groups(batches, 2):
            behind, roles = held[0][0], [role_number(x[1]) for x in held[1:]]
            left = to_go(roles, behind)[0][START]
            yield table([(c, b, behind, passages(roles, behind), len(roles), left)], c=pa.int64(), b=pa.int64(), behind=long_list, ways=long_list, n=pa.int64(), left=pa.int64())

    crossed = with_first(numbered.select("c", "b", "p", "r"), back, "behind", "r", width=width)
    crossed = crossed.mapInArrow(_batched(crossings), "c long, b long, behind array<long>, ways array<long>, n long, left long").checkpoint()

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: tuple = ()
        state, piece, cost = START, 0, 0
        for batch in batches:
            out = []
            for c, b, behind, ways, n, left in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c,) != conv:
                    conv, state, piece, cost = (c,), START, 0, left // UNIT
                # Behind the last block stands the conversation's end, and behind no other.
                out.append((c, b, [*behind, state, piece, cost]))
                state, piece = ways[2 * state], piece + n + ways[2 * state + 1]
            if out:
                yield table(out, c=pa.int64(), b=pa.int64(), behind=long_list)

    planned = crossed.repartition(width, "c").sortWithinPartitions("c", "b").mapInArrow(forward, "c long, b long, behind array<long>")
    ends = crossed.groupBy("c").agg(F.max("b").alias("last")).withColumn("final", F.lit(1))
    planned = planned.join(ends, planned["c"].eqNullSafe(ends["c"]) & (planned["b"] == ends["last"]), "left").select(
        planned["c"], planned["b"], F.concat("behind", F.array(F.coalesce("final", F.lit(0)).cast("long"))).alias("behind")
    )
    ready = with_first(numbered, planned, "n", "r", "t", "behind")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (c, _), held in _groups(batches, 2):
            *behind, entry, first, cost, final = held[0][3]
            turns = held[1:]
            out: list[tuple] = []
            started = first > 0

            def begin(role: int) -> str:
                nonlocal started
                mark = (CLOSE if started else "") + OPEN.format(role=ROLES[role])
                started = True
                return mark

            state = entry
            for (op, role, inserted), (n, _, text, _) in zip(repair([role_number(x[1]) for x in turns], entry, behind), turns, strict=True):
                for extra in inserted:
                    out.append((c, first + len(out), None, ROLES[extra], "insert", cost, begin(extra)))
                mark = BETWEEN if op == "merge" else begin(role)
                out.append((c, first + len(out), n, ROLES[role], op, cost, mark + escaped(text or "")))
                state = role
            if final:
                for extra in closing(state):
                    out.append((c, first + len(out), None, ROLES[extra], "insert", cost, begin(extra)))
                out[-1] = (*out[-1][:-1], out[-1][-1] + CLOSE)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield table(out, **dict(zip(("conv_id", "piece", "turn", "role", "op", "cost", "rendered"), kinds, strict=True)))

    return ready.mapInArrow(_batched(pieces), "conv_id long, piece long, turn long, role string, op string, cost long, rendered string")


def _batched(fn):
    """Many small results as fewer batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in fn(batches):
            held.append(batch)
            size += batch.nbytes
            if size > 4 << 20:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run
