"""Chat formatting by incremental rendering of a template that is a black box.

A template is any function from a list of (role, text) to a string. Successive prefixes of a conversation are rendered, and
each output is compared with the one before: what it adds is the newest turn's span. Where an output doesn't begin with the
one before, the template rewrites history (it moves a closing mark, drops earlier reasoning, numbers turns anew); such turns are
marked, and spans are then located in the whole output, by rendering it with a turn's text exchanged. Where the text stands
within a span is found likewise: two renderings with one-letter texts agree up to where the text begins and from where it ends.

Long conversations are cut into pieces of TURNS turns, each rendered by a task of its own behind the MEMORY + 1 turns that
precede it; the last of those is rendered in both pieces, and where its spans differ the template looks further back than
MEMORY turns, which fails the job instead of giving spans that depend on the cut.

Contract for odd input: a null role or text counts as empty; rows without a conversation's id form one conversation; turns
are ordered by turn (null first), ties by the MD5 of role, line break and text, and repeated rows are turns of their own.
Empty tables give no rows. Roles may hold any characters, as texts may. Other columns are not read. A template that
rewrites history can be used on conversations of up to the given number of turns in a piece; longer ones fail the job.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlemill.llm.common import bound_batches, shuffle_partitions, stage_table

Template = Callable[[list[tuple[str, str]]], str]

#: Turns rendered together, and the earlier turns that a turn's rendering may depend on in longer conversations.
TURNS, MEMORY = 32, 2
MARK, CLOSE = "###", "</turn>"


def escape(text: str) -> str:
    r"""Control strings broken by a backslash, and backslashes doubled: '###' becomes '#\##'. No control string is left."""
    return re.sub(r"\\|#(?=##)|<(?=/turn>)", lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    """What escape was given."""
    return re.sub(r"\\(\\?)", r"\1", text)


def escape_role(role: str) -> str:
    """As escape, and a line break follows a backslash, as the header is one line; a leading # is broken off the mark."""
    return re.sub(r"\\|\n|#", lambda m: "\\" + m[0], role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", r"\1", role, flags=re.DOTALL)


def render(turns: list[tuple[str, str]]) -> str:
    """The template of the registered query: '### role:', the text, and '</turn>', each on its line."""
    return "".join(f"{MARK} {escape_role(role)}:\n{escape(text)}\n{CLOSE}\n" for role, text in turns)


_TURN = re.compile(r"### ((?:\\.|[^\\\n])*):\n(.*?)\n</turn>\n", re.DOTALL)


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, where the escaped text starts, where it ends) of each turn of an output of render."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def _common(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def _hole(first: str, second: str) -> tuple[int, int]:
    """Length of what two renderings have in common in front, and behind."""
    front = _common(first, second)
    back = _common(first[front:][::-1], second[front:][::-1])
    return front, back


def spans(template: Template, turns: list[tuple[str, str]], skip: int = 0) -> list[tuple[str, int, int, bool]]:
    """For each turn from skip on: (what it adds, where its text starts and ends in that, whether history was rewritten).

    If no output rewrites the one before, the pieces concatenate to the whole output. If one does, all turns are located in
    the whole output instead: a turn's piece then reaches from its text's start to that of the next turn's, the first from 0.
    """
    before = template(turns[:skip])
    out = []
    for k in range(skip, len(turns)):
        now = template(turns[: k + 1])
        if not now.startswith(before):
            return _spans_of_whole(template, turns, skip)
        probes = [template([*turns[:k], (turns[k][0], x)]) for x in ("a", "b")]
        front, back = _hole(*probes)
        if front < len(before) or front + back > len(now) or not now.startswith(probes[0][:front]):  # the text decides on what surrounds it
            front, back = max(_common(now, probes[0]), len(before)), 0
        out.append((now[len(before) :], front - len(before), len(now) - back - len(before), False))
        before = now
    return out


def _spans_of_whole(template: Template, turns: list[tuple[str, str]], skip: int) -> list[tuple[str, int, int, bool]]:
    """Texts located in the whole output by exchanging one at a time; a text that the template leaves out is empty."""
    whole, found, at = template(turns), [], 0
    for k, (role, _) in enumerate(turns):
        probes = [template([*turns[:k], (role, x), *turns[k + 1 :]]) for x in ("a", "b")]
        if probes[0] == probes[1]:
            found.append((at, at))
            continue
        front, back = _hole(*probes)
        start, end = max(front, at), len(whole) - back
        found.append((start, max(start, end)))
        at = max(start, end)
    starts = [0, *(a for a, _ in found[1:]), len(whole)]
    starts = [max(starts[: i + 1]) for i in range(len(starts))]
    return [(whole[starts[k] : starts[k + 1]], a - starts[k], min(z, starts[k + 1]) - starts[k], True) for k, (a, z) in enumerate(found)][skip:]


def _runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], key: Callable[[tuple], tuple]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows of one key, over the borders of batches."""
    return groupby((row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)), key)


def number_turns(rows: DataFrame) -> DataFrame:
    """conv_id, role, text and pos, the number of the turns before; one exchange, and no conversation needs to fit in a task.

    Ranges of (conversation, turn) are sorted and numbered as they are read. Only a range's first conversation can have begun
    in an earlier range, so what is added to its numbers is a table of one row a range at most.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("tie", F.md5(F.concat_ws("\n", "role", "text").cast("binary"))).withColumn("place", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "tie", "place"]  # the place deals equal rows over ranges
    ranges = keyed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = object(), 0
        for batch in batches:
            inside = []
            for conv in batch.column("conv_id").to_pylist():
                n = n + 1 if conv == last else 0
                last = conv
                inside.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside, pa.int64())], names=[*batch.schema.names, "inside"])

    own = ranges.select("conv_id", "role", "text", F.spark_partition_id().alias("range"))
    numbered = stage_table(own.mapInArrow(count, "conv_id long, role string, text string, range int, inside long"), "turns")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.sum("n").over(before)).where("offset > 0")
    offsets = counts.select(F.col("conv_id").alias("o_conv"), F.col("range").alias("o_range"), "offset")
    joined = numbered.join(F.broadcast(offsets), (F.col("range") == F.col("o_range")) & F.col("conv_id").eqNullSafe(F.col("o_conv")), "left")
    return joined.select("conv_id", "role", "text", (F.col("inside") + F.coalesce("offset", F.lit(0))).alias("pos"))


_PIECE = "conv_id long, pos long, role string, piece string, text_start int, text_end int, rewrites boolean, repeated boolean"


def format_conversations(conversations: DataFrame, template: Template = render, *, turns: int = TURNS, memory: int = MEMORY) -> DataFrame:
    """A row for each turn: conv_id, pos (from 0), role, piece (what the turn adds to the output), text_start and text_end
    (where its text stands in the piece; the loss mask of assistant turns), rewrites (the template changed earlier output).

    Numbering turns and cutting conversations run over ranges of (conversation, turn), so one that holds a third of all
    rows is dealt over tasks as any other.
    """
    bound_batches(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    placed = number_turns(rows)
    part = F.floor(F.col("pos") / turns)
    behind = F.col("pos") % turns >= turns - memory - 1  # these turns also stand before the next piece
    copies = F.when(behind, F.array(part, part + 1)).otherwise(F.array(part))
    dealt = placed.withColumn("part", F.explode(copies)).withColumn("context", F.col("part") > part)
    ordered = dealt.repartition(shuffle_partitions(conversations.sparkSession), "conv_id", "part").sortWithinPartitions("conv_id", "part", "pos")

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (conv, _), group in _runs(batches, ("conv_id", "part", "pos", "role", "text", "context"), lambda r: r[:2]):
            own = list(group)
            skip = sum(r[5] for r in own)
            if skip == len(own):
                continue  # nothing follows these turns
            first = max(0, skip - 1)
            located = spans(template, [(r[3], r[4]) for r in own], first)
            if skip and any(x[3] for x in located):
                raise ValueError(f"the template rewrites history, and conversation {conv} has more turns than are rendered together")
            for r, (piece, a, z, rewrites) in zip(own[first:], located, strict=True):
                out.append((conv, r[2], r[3], piece, a, z, rewrites, r[5]))
            if len(out) >= 512:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _PIECE.split(", ")])

    return ordered.mapInArrow(rendered, _PIECE)


def digests(pieces: DataFrame, read: Callable[[str], list[tuple[str, str, int, int]]] = read_back, loss_role: str = "assistant") -> DataFrame:
    """For each conversation, read back from its output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, rewrites.

    SHA-256 takes a conversation's characters in order, so they stream through one task, which holds a batch and a digest.
    A turn that was rendered twice, at the cut of a long conversation, must look the same both times.
    """
    n = shuffle_partitions(pieces.sparkSession)
    ordered = pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", "pos", "repeated")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (conv,), group in _runs(batches, ("conv_id", "pos", "piece", "text_start", "text_end", "rewrites", "repeated"), lambda r: r[:1]):
            turns, loss, n, chars, length, rewrites, last = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, False, None
            for _, pos, piece, a, z, changed, repeated in group:
                if repeated:
                    if last != (pos, piece):
                        raise ValueError(f"turn {pos} of conversation {conv} depends on turns further back than the template's memory")
                    continue
                last, rewrites, length = (pos, piece), rewrites or changed, length + len(piece)
                for role, text, start, end in read(piece):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                    if role == loss_role:
                        if (start, end) != (a, z):
                            raise ValueError(f"turn {pos} of conversation {conv}: its text was located at {a} to {z}, and is read at {start} to {end}")
                        masked = unescape(piece[a:z])
                        chars += len(masked)
                        loss.update(masked.encode())
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), length, rewrites))
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return ordered.mapInArrow(digest, schema)
