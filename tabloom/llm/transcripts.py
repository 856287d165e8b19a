"""Chat formatting: a hidden Markov model finds who speaks, then turns are rendered in one canonical form.

A transcript is an ordered list of text rows; every row is a paragraph of lines. States are the roles. A line emits a speaker
marker, its place in the paragraph, its own and its paragraph's length and whether it asks; given the role these are
independent. Transitions depend on the kind of line: the first of a transcript, the first of a paragraph, any other. All are
smoothed counts over every labelled row, with a strong prior that a marker means what it says. Roles are recovered by Viterbi.

A transcript may be as long as it likes. All rows are range-sorted by transcript and order, which moves their text once and cuts a
transcript wherever a partition ends; inside a partition it is cut into blocks of at most ``BLOCK`` rows and about ``BLOCK_BYTES`` of
text. Each block is summed up by a small matrix of best path scores from every state before it to every state at its end, the matrices
are chained per transcript, and each block is then decoded between its known ends. The result is the exact best path. Blocks that hold
a whole transcript, the usual case, are decoded where they lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabloom.llm.common import fitted, packed, shuffle_partitions

BLOCK = 4096
BLOCK_BYTES = 4 << 20
ROLES = ("system", "user", "assistant")
# Names that speakers go by.
ALIASES = {
    "system": "system", "user": "user", "human": "user", "customer": "user", "me": "user", "q": "user", "prompter": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "model": "assistant", "agent": "assistant", "a": "assistant", "gpt": "assistant",
}
MARKER = re.compile(r"^\s*(?:#{1,6}\s*|<\|?|\[|\*\*)?\s*(" + "|".join(ALIASES) + r")\s*(?:\|?>|\]|\*\*)?\s*[:>]\s*|^\s*<\|(?:im_start\|>)?(" + "|".join(ALIASES) + r")\|?>?\s*$", re.I)
KINDS = 3  # first of transcript, first of paragraph, other
LENGTHS = 12
MARKER_PRIOR = 1000.0
FEATURES = {"marker": len(ROLES) + 1, "place": 2, "length": LENGTHS, "paragraph": LENGTHS, "asks": 2}


def _log2(n: int) -> int:
    return min(LENGTHS - 1, n.bit_length())


def line_features(text: str) -> tuple[list[str], np.ndarray]:
    """The lines of a row without speaker markers, and their feature codes."""
    lines = text.split("\n")
    paragraph = _log2(len(text))
    kept, codes = [], np.zeros((len(lines), len(FEATURES)), np.int64)
    for i, line in enumerate(lines):
        marker = 0
        if found := MARKER.match(line):
            marker = 1 + ROLES.index(ALIASES[(found.group(1) or found.group(2)).lower()])
            line = line[found.end() :]
        kept.append(line)
        codes[i] = marker, int(i > 0), _log2(len(line)), paragraph, int(line.rstrip().endswith("?"))
    return kept, codes


def ordered(rows: DataFrame) -> DataFrame:
    """Stored blocks: conv_id, block (ascending along a transcript), single (holds all of it), turn, role, size (lines) and text as lists,
    codes of all lines, head and tail (first and last known role, -1 for none).

    Order is turn (null first), then a digest of the text; the role has no part in it. Rows equal in transcript, turn and text are one,
    with the first of ``ROLES`` that one of them names. Null text counts as empty.
    """
    limit, most = BLOCK, BLOCK_BYTES
    role = F.coalesce(F.array_position(F.lit(list(ROLES)), F.col("role").cast("string")).cast("int"), F.lit(0)) - 1
    keyed = rows.select(
        "conv_id", F.col("turn").try_cast("long").alias("turn"), F.when(role >= 0, role).otherwise(len(ROLES)).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    keys = ("conv_id", "turn", "h1", "h2")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repeated rows of a batch only once, before they are moved."""
        for batch in batches:
            seen: dict[tuple, int] = {}
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in (*keys, "role")))):
                seen.setdefault(key, i)
            yield batch if len(seen) == batch.num_rows else batch.take(pa.array(list(seen.values())))

    conv = to_arrow_type(rows.schema["conv_id"].dataType)
    schema = pa.schema(
        [("conv_id", conv), ("block", pa.int64()), ("single", pa.bool_()), ("turn", pa.list_(pa.int64())), ("role", pa.list_(pa.int32())), ("size", pa.list_(pa.int32())),
         ("text", pa.list_(pa.string())), ("codes", pa.binary()), ("head", pa.int32()), ("tail", pa.int32())]
    )
    spark_schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, block bigint, single boolean, turn array<bigint>, role array<int>, size array<int>, text array<string>, codes binary, head int, tail int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []  # turn, role, text
        state = {"conv": None, "key": None, "bytes": 0, "opened": False, "first": True}

        def emit(closes: bool) -> pa.RecordBatch:
            nonlocal number, held
            turns, roles, texts = zip(*held)
            codes = [line_features(t)[1] for t in texts]
            known = [r for r in roles if r < len(ROLES)]
            # a transcript at either end of a partition may go on in the next one
            whole = closes and state["opened"]
            found = {
                "conv_id": state["conv"], "block": base + number, "single": whole, "turn": turns, "role": roles, "size": [len(c) for c in codes], "text": texts,
                "codes": np.concatenate(codes).astype(np.uint8).tobytes(), "head": known[0] if known else -1, "tail": known[-1] if known else -1,
            }
            number, held = number + 1, []
            state["bytes"], state["opened"] = 0, False
            return pa.RecordBatch.from_pydict({k: [v] for k, v in found.items()}, schema=schema)

        for batch in batches:
            for conv_id, turn, h1, h2, role, text in zip(*(batch.column(c).to_pylist() for c in (*keys, "role", "text"))):
                key = (conv_id, turn, h1, h2)
                if key == state["key"]:
                    continue
                if held and conv_id != state["conv"]:
                    yield emit(True)
                elif held and (len(held) >= limit or state["bytes"] + len(text) > most):
                    yield emit(False)
                if state["key"] is None or conv_id != state["conv"]:
                    state["opened"] = state["key"] is not None
                    state["conv"] = conv_id
                state["key"] = key
                state["bytes"] += len(text)
                held.append((turn, role, text))
        if held:
            yield emit(False)

    order = [F.col(c).asc_nulls_first() for c in keys]
    moved = keyed.mapInArrow(once, keyed.schema).repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order, "role")
    return packed(moved.mapInArrow(cut, spark_schema), "blocks")


def _codes(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return np.frombuffer(batch.column("codes")[i].as_buffer(), np.uint8).reshape(-1, len(FEATURES)).astype(np.int64)


class Model:
    def __init__(self, emissions: np.ndarray, transitions: np.ndarray):
        """Counts: emissions[role, feature, code], transitions[kind, previous role or start, role]."""
        self.emit = []
        for k, size in enumerate(FEATURES.values()):
            counts = emissions[:, k, :size] + 1.0
            if k == 0:
                counts[np.arange(len(ROLES)), 1 + np.arange(len(ROLES))] += MARKER_PRIOR
            self.emit.append(np.log(counts / counts.sum(axis=1, keepdims=True)))
        smooth = transitions + 0.5
        smooth[2] += 50 * np.vstack([np.eye(len(ROLES)), np.zeros((1, len(ROLES)))])
        self.step = np.log(smooth / smooth.sum(axis=2, keepdims=True))

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return sum(table[:, codes[:, k]].T for k, table in enumerate(self.emit))

    def kinds(self, codes: np.ndarray, starts: bool) -> np.ndarray:
        kind = np.where(codes[:, 1] == 0, 1, 2)
        kind[codes[:, 0] > 0] = 1  # a marker may change the speaker anywhere
        if starts:
            kind[0] = 0
        return kind

    def matrix(self, codes: np.ndarray, starts: bool) -> np.ndarray:
        """Best score from each state before (the last row: the start) to each state at the end."""
        best = None
        for score, kind in zip(self.scores(codes), self.kinds(codes, starts)):
            step = self.step[kind] + score
            best = step if best is None else (best[:, :, None] + step[None, : len(ROLES)]).max(axis=1)
        return best

    def decode(self, codes: np.ndarray, starts: bool, before: int, after: int) -> np.ndarray:
        """Roles of the lines of a block between the state before it and the state of its last line."""
        score, kind = self.scores(codes), self.kinds(codes, starts)
        back = np.zeros((len(codes), len(ROLES)), np.int64)
        best = self.step[kind[0]][before] + score[0]
        for i in range(1, len(codes)):
            step = best[:, None] + self.step[kind[i]][: len(ROLES)]
            back[i] = step.argmax(axis=0)
            best = step.max(axis=0) + score[i]
        path = np.zeros(len(codes), np.int64)
        path[-1] = after
        for i in range(len(codes) - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path


START = len(ROLES)


def fit(blocks: DataFrame) -> Model:
    """Counts over every row with a known role; at most a few hundred sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ROLES) + 1, len(FEATURES), LENGTHS), np.int64)
        moves = np.zeros((KINDS, len(ROLES) + 1, len(ROLES)), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                roles, sizes = np.array(batch.column("role")[i].as_py()), np.array(batch.column("size")[i].as_py())
                codes, line_role = _codes(batch, i), np.repeat(roles, sizes)
                for k in range(len(FEATURES)):
                    np.add.at(total, (line_role, k, codes[:, k]), 1)
                known = np.flatnonzero(roles < len(ROLES))
                np.add.at(moves, (2, roles[known], roles[known]), sizes[known] - 1)
                np.add.at(moves, (1, roles[known][:-1], roles[known][1:]), 1)
                if len(known) and batch.column("single")[i].as_py():
                    moves[0, START, roles[known[0]]] += 1
        keys, values = [], []
        for name, table in (("e", total[: len(ROLES)]), ("t", moves)):
            for at in np.argwhere(table):
                keys.append(" ".join([name, *map(str, at)]))
                values.append(int(table[tuple(at)]))
        yield pa.record_batch({"key": pa.array(keys, pa.string()), "n": pa.array(values, pa.int64())})

    emissions = np.zeros((len(ROLES), len(FEATURES), LENGTHS))
    transitions = np.zeros((KINDS, len(ROLES) + 1, len(ROLES)))
    for key, n in blocks.select("single", "role", "size", "codes").mapInArrow(count, "key string, n bigint").groupBy("key").agg(F.sum("n")).collect():
        table, *at = key.split(" ")
        (emissions if table == "e" else transitions)[tuple(map(int, at))] += n
    # the ends of neighbouring blocks of transcripts that have several
    ends = blocks.where("head >= 0 and not single").select("head", F.lag("tail").over(W.partitionBy("conv_id").orderBy("block")).alias("last"))
    for head, last, n in ends.groupBy("head", "last").agg(F.count("*")).collect():
        transitions[(0, START, head) if last is None else (1, last, head)] += n
    return Model(emissions, transitions)


def render(role: str, lines: list[str]) -> str:
    """The canonical form of a turn."""
    return f"<|{role}|>\n" + "\n".join(lines).strip() + "\n<|end|>"


def parse(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """Turns of all transcripts: conv_id, turn, part, role_pred, n_lines, rendered.

    A turn is a maximal run of lines of one row with one recovered role, or from one marker to the next; ``part`` numbers the
    turns of a row. The column ``role`` serves to fit the model only (rows without a known role do not take part in that);
    with none known, the prior on markers decides. Repeated rows count once, null text is one empty line, rows of a null
    conv_id are one transcript, a turn that is no number counts as null. An empty table has no turns.
    """
    blocks = ordered(rows)
    found = model or fit(blocks)
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    conv = to_arrow_type(rows.schema["conv_id"].dataType)
    ends_schema = pa.schema([("conv_id", conv), ("block", pa.int64()), ("before", pa.int32()), ("after", pa.int32())])
    out_schema = pa.schema([("conv_id", conv), ("turn", pa.int64()), ("part", pa.int64()), ("role_pred", pa.string()), ("n_lines", pa.int64()), ("rendered", pa.string())])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrices = []
            for i in range(batch.num_rows):
                codes = _codes(batch, i)
                inner = found.matrix(codes, False)
                inner[START] = found.matrix(codes, True)[START]
                matrices.append(inner.ravel().tolist())
            yield pa.record_batch({"conv_id": batch.column("conv_id"), "block": batch.column("block"), "matrix": pa.array(matrices, pa.list_(pa.float64()))})

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ends_of(conv_id, numbers: list[int], backs: list[np.ndarray], best: np.ndarray) -> pa.RecordBatch:
            ends = [int(best.argmax())]
            for back in reversed(backs):
                ends.append(int(back[ends[-1]]))
            ends = ends[::-1]
            return pa.RecordBatch.from_pydict({"conv_id": [conv_id] * len(numbers), "block": numbers, "before": [START, *ends[:-1]], "after": ends}, schema=ends_schema)

        # a block adds one number and one row of back pointers
        key, numbers, backs, best = None, [], [], None
        for batch in batches:
            for conv_id, block, matrix in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "matrix"))):
                m = np.array(matrix).reshape(len(ROLES) + 1, len(ROLES))
                if numbers and conv_id == key:
                    step = best[:, None] + m[: len(ROLES)]
                    backs.append(step.argmax(axis=0).astype(np.int8))
                    best = step.max(axis=0)
                    numbers.append(block)
                    continue
                if numbers:
                    yield ends_of(key, numbers, backs, best)
                key, numbers, backs, best = conv_id, [block], [], m[START]
        if numbers:
            yield ends_of(key, numbers, backs, best)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes = _codes(batch, i)
                before, after = batch.column("before")[i].as_py(), batch.column("after")[i].as_py()
                if before is None:
                    before, after = START, int(found.matrix(codes, True)[START].argmax())
                path = found.decode(codes, before == START, before, after)
                out: dict[str, list] = {name: [] for name in out_schema.names}
                at = 0
                for turn, size, text in zip(*(batch.column(c)[i].as_py() for c in ("turn", "size", "text"))):
                    lines, roles, own = line_features(text)[0], path[at : at + size], codes[at : at + size]
                    at += size
                    opens = np.flatnonzero(np.concatenate([[True], (roles[1:] != roles[:-1]) | (own[1:, 0] > 0)]))
                    for part, (a, b) in enumerate(zip(opens, [*opens[1:], size])):
                        role = ROLES[roles[a]]
                        for name, value in zip(out_schema.names, (batch.column("conv_id")[i].as_py(), turn, part, role, int(b - a), render(role, lines[a:b]))):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=out_schema)

    long = blocks.where("not single")
    matrices = long.select("conv_id", "block", "codes").mapInArrow(summarise, f"conv_id {conv_type}, block bigint, matrix array<double>")
    n = shuffle_partitions(rows.sparkSession)
    ends = matrices.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(chain, f"conv_id {conv_type}, block bigint, before int, after int")
    known = long.join(fitted(ends.select("block", "before", "after"), "ends"), "block")
    columns = ["conv_id", "turn", "size", "text", "codes", "before", "after"]
    ready = blocks.where("single").withColumns({"before": F.lit(None).cast("int"), "after": F.lit(None).cast("int")}).select(*columns).unionByName(known.select(*columns))
    return ready.mapInArrow(decode, f"conv_id {conv_type}, turn bigint, part bigint, role_pred string, n_lines bigint, rendered string")
