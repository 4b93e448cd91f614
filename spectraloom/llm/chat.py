"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role`` + newline + text + ``<|im_end|>`` + newline; a conversation is its turns in order, so
no turn depends on another. A task sees a run of rows as the byte buffers Arrow already has: the lengths of headers, text
pieces and footers give cumulative offsets, these give scatter indices, and every piece is copied once into one
preallocated Arrow buffer whose offsets fall between conversations.

Control strings inside a text or role are kept apart from real ones: a backslash goes in after their first character, and
strings that already look escaped get one more, so taking one away is the exact inverse. The loss mask is a list of
(start, length) in code points of the formatted text, one entry per text of a loss role.

Rows are dealt by conversation and sorted. A conversation of more than ``hot_turns`` rows is dealt by blocks of its turn
numbers too, and comes as several parts; parts are cut at ``PART_BYTES`` in any case, so a task holds one run of that size
or one text. Only the digests of ``read_back`` need a conversation's parts in one place: they stream through it, as
SHA-256 takes bytes in order.

Defined cases: null text or role is empty; a null conv_id is a conversation of its own; rows are ordered by turn (null
first), then role, then text, and repeated rows are repeated turns; any other column is ignored, whatever its name; an empty
table gives no rows; roles may hold anything, newlines and control strings included; a text may have any length that fits
one Arrow value (2 GB), its bytes being held about three times.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of usual templates; none holds ``<`` or ``[`` after its first character.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
LOSS_ROLES = ("assistant",)
HOT_TURNS, BLOCK_TURNS = 100_000, 16_384
PART_BYTES, SCATTER_BYTES, SLICE_BYTES = 8_000_000, 1_000_000, 4_096

_RESTS = "|".join(re.escape(c[1:]) for c in CONTROLS)
#: The same rule for Python and for the SQL twin.
ESCAPE = r"([<\[])(\\*(?:" + _RESTS + "))"
UNESCAPE = r"([<\[])\\(\\*(?:" + _RESTS + "))"
_IN_BYTES, _OUT = re.compile(ESCAPE.encode()), re.compile(UNESCAPE)
PART_SCHEMA = "conv_id {id}, blk long, part int, n_turns int, formatted string, loss array<struct<start: long, length: long>>"


def escape(text: str) -> str:
    return re.sub(ESCAPE, r"\1\\\2", text)


def unescape(text: str) -> str:
    return _OUT.sub(r"\1\2", text) if "\\" in text else text


def header(role: str) -> str:
    return OPEN + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"


def role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


# --- assembly ----------------------------------------------------------------------------------------


def scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy ``data[start:start+length]`` to ``out[to:to+length]`` for every piece: long ones as slices, short ones together."""
    long = length >= SLICE_BYTES
    for a, b, n in zip(to[long].tolist(), start[long].tolist(), length[long].tolist()):
        out[a : a + n] = data[b : b + n]
    to, start, length = to[~long], start[~long], length[~long]
    ends = np.cumsum(length)
    edges = [0, *(np.flatnonzero(np.diff(ends // SCATTER_BYTES)) + 1).tolist(), len(ends)] if len(ends) else [0]
    for first, stop in zip(edges[:-1], edges[1:]):
        s = slice(first, stop)
        n = length[s]
        inside = np.arange(int(n.sum())) - np.repeat(ends[s] - n - (ends[first] - length[first]), n)
        out[np.repeat(to[s], n) + inside] = data[np.repeat(start[s], n) + inside]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data bytes of a string column without nulls and the row offsets into them."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), at


def _escapes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a backslash goes in (before this byte) and in which row; a match may not reach into the next row."""
    found = np.array([m.span() for m in _IN_BYTES.finditer(memoryview(data)[int(at[0]) : int(at[-1])])], np.int64).reshape(-1, 2) + at[0]
    row = np.searchsorted(at, found[:, 0], "right") - 1
    whole = found[:, 1] <= at[row + 1]
    return found[whole, 0] + 1, row[whole]


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns as one string array with an entry per run of rows starting at ``first``.

    Also per row the code points before its text inside its entry, and those of its escaped text.
    """
    names = pc.dictionary_encode(roles)
    heads = [header(r) for r in names.dictionary.to_pylist()]
    pool = np.frombuffer("".join([*heads, CLOSE, "\\"]).encode(), np.uint8)
    sizes = np.array([*[len(h.encode()) for h in heads], len(CLOSE), 1])
    starts = np.cumsum(sizes) - sizes
    which = np.asarray(names.indices).astype(np.int64)
    data, at = _bytes(texts)
    cut, row = _escapes(data, at)
    added = np.bincount(row, minlength=len(texts))
    # Pieces of texts: each row's bytes, cut where a backslash goes in.
    begin = np.sort(np.concatenate([at[:-1], cut]), kind="stable")
    length = np.diff(np.append(begin, at[-1]))
    piece_row = np.repeat(np.arange(len(texts)), added + 1)
    # A row's cut at its own start or end cannot happen (a control string has two characters or more), so rows stay in order.
    total = sizes[which] + np.diff(at) + added + len(CLOSE)
    end = np.cumsum(total)
    head_at = end - total
    nth = np.arange(len(begin)) - np.repeat(np.cumsum(added + 1) - (added + 1), added + 1)
    piece_at = head_at[piece_row] + sizes[which][piece_row] + (begin - at[:-1][piece_row]) + nth
    buffer = pa.allocate_buffer(int(end[-1]) if len(end) else 0)
    out = np.frombuffer(buffer, np.uint8)
    scatter(out, head_at, pool, starts[which], sizes[which])
    scatter(out, piece_at, data, begin, length)
    scatter(out, end - len(CLOSE), pool, np.full(len(end), starts[-2]), np.full(len(end), len(CLOSE)))
    out[piece_at[nth > 0] - 1] = pool[-1]
    offsets = np.append(head_at[first], end[-1]).astype(np.int32)
    joined = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), buffer])
    points = np.asarray(pc.utf8_length(texts)).astype(np.int64) + added
    head_points = np.array([len(h) for h in heads], np.int64)[which]
    turn = head_points + points + len(CLOSE)
    before = np.cumsum(turn) - turn
    return joined, before + head_points - np.repeat(before[first], np.diff(np.append(first, len(texts)))), points


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about PART_BYTES of text."""
    size = np.cumsum(np.asarray(pc.binary_length(batch.column("text"))).astype(np.int64)) // PART_BYTES
    edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:]):
        yield batch.slice(a, b - a)


def _format(loss_roles: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = None, 0
        for big in batches:
            if big.num_rows == 0:
                continue
            for b in _runs(big):
                ids = list(zip(b.column("conv_id").to_pylist(), b.column("blk").to_pylist()))
                first = np.array([i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]])
                joined, before, points = assemble(b.column("role"), b.column("text"), first)
                keys, parts = [ids[i] for i in first.tolist()], []
                for k in keys:
                    part = part + 1 if k == last else 0
                    last = k
                    parts.append(part)
                learned = np.asarray(pc.is_in(b.column("role"), pa.array(loss_roles)))
                spans = pa.StructArray.from_arrays([pa.array(before[learned]), pa.array(points[learned])], ["start", "length"])
                edges = np.append(first, b.num_rows)
                held = np.append(0, np.cumsum(learned))[edges].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("conv_id").take(pa.array(first)), b.column("blk").take(pa.array(first)), pa.array(parts, pa.int32()),
                     pa.array(np.diff(edges), pa.int32()), joined, pa.ListArray.from_arrays(pa.array(held), spans)],
                    ["conv_id", "blk", "part", "n_turns", "formatted", "loss"],
                )

    return run


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES, hot_turns: int = HOT_TURNS) -> tuple[DataFrame, bool]:
    """(conv_id, blk, part, n_turns, formatted, loss) and whether any conversation was split over blocks.

    The parts of a conversation, by (blk, part), make up its text; the spans of a part count from its own start.
    """
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    hot = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_turns).select("conv_id", F.lit(True).alias("_hot"))
    split = not hot.isEmpty()
    if split:  # at most rows / hot_turns of them
        rows = rows.alias("r").join(hot.alias("h"), F.expr("r.conv_id <=> h.conv_id"), "left").select("r.*", "_hot")
        rows = rows.withColumn("blk", F.when(F.col("_hot"), F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(2**62)))).otherwise(0).cast("long")).drop("_hot")
    else:
        rows = rows.withColumn("blk", F.lit(0).cast("long"))
    dealt = rows.repartition("conv_id", "blk").sortWithinPartitions("conv_id", "blk", F.asc_nulls_first("turn"), "role", "text")
    dealt = dealt.select("conv_id", "blk", "role", "text")
    return dealt.mapInArrow(_format(tuple(loss_roles)), PART_SCHEMA.format(id=dict(rows.dtypes)["conv_id"])), split


# --- reading back ------------------------------------------------------------------------------------


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted part; raises where it is not well formed."""
    pieces = formatted.split(OPEN)
    if pieces[0]:
        raise ValueError("text before the first turn")
    for piece in pieces[1:]:
        line, mark, body = piece.partition("\n")
        if not mark or not body.endswith(CLOSE) or OPEN in body or CLOSE[:-1] in body[: -len(CLOSE)]:
            raise ValueError("a turn is not closed")
        yield role_of(line), unescape(body[: -len(CLOSE)])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, state, done = None, None, []

    def rows(ids: pa.DataType) -> pa.RecordBatch:
        got = list(zip(*[(k, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]) for k, s in done]))
        done.clear()
        kinds = [ids, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, kinds)], names)

    kind = pa.int64()
    for b in batches:
        kind = b.schema.field("conv_id").type
        columns = [b.column(c) for c in ("conv_id", "formatted", "loss")]
        for key, text, loss in zip(*columns):
            key, text = (key.as_py(),), text.as_py()
            if key != now:
                if state:
                    done.append((now[0], state))
                now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in turns_of(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for span in loss.as_py():
                said = unescape(text[span["start"] : span["start"] + span["length"]])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(text)
        if done:
            yield rows(kind)
    if state:
        done.append((now[0], state))
        yield rows(kind)


def read_back(parts: DataFrame, split: bool = True) -> DataFrame:
    """Per conversation what its formatted parts say: turns, text under the loss mask, sizes.

    ``parts`` without a split conversation is read in the order ``format_conversations`` left it in; otherwise the parts of
    each conversation are brought together first.
    """
    rows = parts.select("conv_id", "blk", "part", "formatted", "loss")
    if split:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "blk", "part")
    schema = f"conv_id {dict(parts.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(_digest, schema)


PROBE = "</s>[INST] ok [/INST]"


def report(turns: DataFrame) -> DataFrame:
    """The conversations and one of control strings (-7), formatted and read back."""
    probe = turns.sparkSession.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    parts, split = format_conversations(turns.select("conv_id", "turn", "role", "text").unionByName(probe))
    return read_back(parts, split)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_quoted(PROBE)} UNION ALL SELECT -7, 1, 'assistant', {_quoted(PROBE)}),
e AS (SELECT *, length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), {_quoted(ESCAPE)}, '\1\\\2', 'g')) AS role_chars,
  length(regexp_replace(text, {_quoted(ESCAPE)}, '\1\\\2', 'g')) AS text_chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN)} + role_chars + 1 + text_chars + {len(CLOSE)}) AS BIGINT) AS formatted_chars
FROM e GROUP BY 1"""
