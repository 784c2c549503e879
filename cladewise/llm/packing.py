"""Operator 1: documents packed into sequences by bin completion."""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import checkpointed, pick
from .pieces import CACHE, Splitter

#: Pieces that are packed together, on average; more would save less than a sequence in a thousand.
GROUP = 16_384
#: Lengths that the search may try for each piece of a group, and fillings that it looks at ahead to take the fullest first.
EFFORT, AHEAD = 48, 8


class Ids:
    """The library's ids of texts as bytes of little-endian 32-bit integers, by pieces met before."""

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        self.known: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        if len(self.known) >= CACHE:
            self.known.clear()
        tokens = self.splitter.tokenizer.model.tokenize(self.splitter.letters(piece))
        out = np.array([x.id for x in tokens], "<u4").tobytes()
        if len(piece) <= 64:
            self.known[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        out = []
        for special, pieces in self.splitter.segments(text):
            if special:
                out.append(np.array([self.splitter.special[special]], "<u4").tobytes())
                continue
            found = [*map(self.known.get, pieces)]
            if None in found:
                found = [self.piece(p) if x is None else x for p, x in zip(pieces, found)]
            out += found
        return b"".join(out)


@lru_cache(maxsize=2)
def kept_packing(path: str) -> Ids:
    """One for each worker process: a worker's later tasks find what its earlier ones met."""
    return Ids(path)


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only its first piece may be shorter than size."""
    first = (total - 1) % size + 1
    return [(0, first), *((s, size) for s in range(first, total, size))]


def best_fit(counts: dict[int, int], size: int) -> list[list[int]]:
    """Bins by best fit, longest first: each length goes where it leaves least room."""
    room: dict[int, list[list[int]]] = {}
    mask, bins = 0, []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = mask >> length
            if fitting:
                r = length + (fitting & -fitting).bit_length() - 1
                bin_ = room[r].pop()
                if not room[r]:
                    mask ^= 1 << r
            else:
                r, bin_ = size, []
                bins.append(bin_)
            bin_.append(length)
            r -= length
            if r:
                if not room.get(r):
                    mask |= 1 << r
                room.setdefault(r, []).append(bin_)
    return bins


def fewest(counts: dict[int, int], size: int) -> int:
    """A bound no packing can beat: lengths above size - t share no bin, and those of t or more only the room beside them."""
    full = np.zeros(size + 2, np.int64)
    for length, n in counts.items():
        full[length] += n
    lengths = np.arange(size + 2)
    best = -(-int((full * lengths).sum()) // size)
    above, tokens = full[::-1].cumsum()[::-1], (full * lengths)[::-1].cumsum()[::-1]
    for t in range(1, size // 2 + 1):
        big, half = int(above[size - t + 1]), int(above[size // 2 + 1])
        middle = half - big
        spare = middle * size - int(tokens[size // 2 + 1] - tokens[size - t + 1])
        small = int(tokens[t] - tokens[size // 2 + 1])
        best = max(best, big + middle + max(0, -(-(small - spare) // size)))
    return best


def smeared(bits: int, width: int) -> int:
    """The bits, each also set at the `width` places above it."""
    done = 0
    while done < width:
        more = min(done + 1, width - done)
        bits |= bits << more
        done += more
    return bits


class Completion:
    """Search over the bins that complete the longest length left; `steps` is how many lengths may still be tried."""

    def __init__(self, counts: dict[int, int], size: int, steps: int):
        self.size, self.counts, self.steps = size, dict(counts), steps
        self.there = sum(1 << x for x in counts)
        self.turned = sum(1 << (size - x) for x in counts)

    def take(self, length: int) -> None:
        self.counts[length] -= 1
        if not self.counts[length]:
            self.there ^= 1 << length
            self.turned ^= 1 << (self.size - length)

    def give(self, length: int) -> None:
        if not self.counts[length]:
            self.there ^= 1 << length
            self.turned ^= 1 << (self.size - length)
        self.counts[length] += 1

    def upto(self, room: int) -> int:
        """The longest length left of at most room, or 0."""
        return max(0, (self.there & ((1 << (room + 1)) - 1)).bit_length() - 1) if room > 0 else 0

    def pair(self, room: int) -> tuple[int, ...]:
        """Two lengths that fill room exactly, the longer as long as can be."""
        if room < 2:
            return ()
        hit = self.there & (self.turned >> (self.size - room)) & ((1 << room) - 1)
        while hit:
            a = hit.bit_length() - 1
            if a * 2 < room:
                return ()
            if a * 2 != room or self.counts[a] > 1:
                return a, room - a
            hit ^= 1 << a
        return ()

    def fullest(self, room: int) -> Iterator[tuple[int, ...]]:
        """Fillings of two or three lengths, one for each longest length, fullest first, that fill more than any length alone."""
        for total in range(room, self.upto(room), -1):
            if found := self.pair(total):
                yield found
            a = self.upto(total)
            while a and self.steps > 0:
                self.steps -= 1
                self.take(a)
                found = self.pair(total - a)
                self.give(a)
                if found:
                    yield tuple(sorted((a, *found), reverse=True))
                a = self.upto(a - 1)

    def maximal(self, room: int) -> Iterator[tuple[int, ...]]:
        """All fillings beside which no length left has room, the longest lengths first; all is given back at each."""
        chosen: list[int] = []
        left = most = room
        while self.steps > 0:
            self.steps -= 1
            if a := self.upto(min(most, left)):
                self.take(a)
                chosen.append(a)
                left, most = left - a, a
                continue
            if not self.upto(left):
                for x in chosen:
                    self.give(x)
                yield tuple(chosen)
                for x in chosen:
                    self.take(x)
            if not chosen:
                return
            a = chosen.pop()
            self.give(a)
            left, most = left + a, a - 1
        for x in chosen:
            self.give(x)

    def dominated(self, filling: tuple[int, ...], room: int) -> bool:
        """Whether a length left over could stand for some of the filling's lengths (or for none) and fill as much or more.

        One that stands for a single length must be longer. Such a filling needs no
        look: what it leaves could take the place of what the other one leaves.
        """
        spare = room - sum(filling)
        one, more = 0, 1  # sums of one length; of none, two or more
        for x in filling:
            self.take(x)
        for x in filling:
            more |= (more ^ 1) << x | one << x
            one |= 1 << x
        hit = smeared(more, spare) & ~1 & self.there
        if spare:
            hit |= smeared(one << 1, spare - 1) & self.there
        for x in filling:
            self.give(x)
        return hit != 0

    def fillings(self, room: int) -> Iterator[tuple[int, ...]]:
        """All fillings of room that no other one dominates, found as they are asked for.

        A filling is dominated if its lengths fit into the lengths of another one; so one
        length that fills room alone leaves no other worth a look.
        """
        one = self.upto(room)
        if one in (room, 0):
            yield (one,) if one else ()
            return
        met = {None}
        for filling in itertools.chain.from_iterable(itertools.zip_longest(self.fullest(room), self.maximal(room))):  # by turns
            if filling not in met and not self.dominated(filling, room):
                met.add(filling)
                yield filling


class Level:
    """A bin in the making: its longest length, the waste of the bins before it, the filling taken, and those untried."""

    def __init__(self, state: Completion, waste: int):
        self.longest, self.waste, self.taken = state.there.bit_length() - 1, waste, None
        state.take(self.longest)
        self.room = state.size - self.longest
        self.untried, self.ahead = state.fillings(self.room), []

    def next(self) -> tuple[int, ...] | None:
        """The fullest of the AHEAD next fillings, or the first that leaves no room; None after the last."""
        while len(self.ahead) < AHEAD and not (self.ahead and not self.ahead[0][0]) and (filling := next(self.untried, None)) is not None:
            heapq.heappush(self.ahead, (self.room - sum(filling), len(filling), tuple(-x for x in filling)))
        return tuple(-x for x in heapq.heappop(self.ahead)[2]) if self.ahead else None


def complete_bins(counts: dict[int, int], size: int, effort: int = EFFORT) -> list[list[int]]:
    """Bins for `counts` lengths: the best-fit solution, or a smaller one that bin completion finds.

    Depth first, each level completes the longest length left, by each filling that no
    other one dominates, fuller ones first. The waste of all bins so far may not exceed
    what a solution of one bin fewer than the incumbent could waste; otherwise the
    branch is pruned. A solution becomes the new incumbent. The search ends at the lower
    bound, when all is searched, or when `effort` lengths for each piece are tried; then
    best fit completes the bins of the branch at hand, and the smaller solution stands.
    """
    incumbent = best_fit(counts, size)
    least, total = fewest(counts, size), sum(x * n for x, n in counts.items())
    if len(incumbent) <= least:
        return incumbent
    state = Completion(counts, size, effort * sum(counts.values()) + 1000)
    stack = [Level(state, 0)]
    while stack:
        level = stack[-1]
        if state.steps <= 0:
            made = [[x.longest, *x.taken] for x in stack[:-1]]
            state.give(level.longest)
            for x in level.taken or ():
                state.give(x)
            made += best_fit({x: n for x, n in state.counts.items() if n}, size)
            return min(made, incumbent, key=len)
        for x in level.taken or ():
            state.give(x)
        level.taken = None
        spare = (len(incumbent) - 1) * size - total
        while (filling := level.next()) is not None:
            state.steps -= 1
            waste = level.waste + level.room - sum(filling)
            if waste <= spare:
                break
        if filling is None:
            state.give(level.longest)
            stack.pop()
            continue
        level.taken = filling
        for x in filling:
            state.take(x)
        if state.there:
            stack.append(Level(state, waste))
        else:
            incumbent = [[x.longest, *x.taken] for x in stack]
            if len(incumbent) <= least:
                break
    return incumbent


def place(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; lengths of a bin follow one another without gaps."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    waiting: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        waiting.setdefault(int(lengths[i]), []).append(i)
    for k, bin_ in enumerate(complete_bins({x: len(v) for x, v in waiting.items()}, size) if len(lengths) else []):
        at = 0
        for x in bin_:
            i = waiting[x].pop()
            bins[i], offsets[i] = k, at
            at += x
    return bins, offsets


def pieces_of(docs: DataFrame, path: str, size: int, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids (if asked for), and its row's number in its partition."""
    rows = pick(docs, "doc_id", "text")
    schema = T.StructType([rows.schema[0], *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("row", T.LongType()), *[("ids", T.BinaryType())] * with_ids))])
    ending = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ids, row = kept_packing(path), 0
        for batch in batches:
            of, out = [], ([], [], [], [], [], [])[: 5 + with_ids]
            for i, value in enumerate(batch.column(1)):
                whole = ids.encode(value.as_py() or "") + ending
                for k, (start, length) in enumerate(cut(len(whole) // 4, size)):
                    part = whole[4 * start : 4 * (start + length)]
                    of.append(i)
                    for column, x in zip(out, (k, start, length, zlib.crc32(part), row, part)):
                        column.append(x)
                row += 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, k) for c, k in zip(out, kinds))], schema.names)

    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """All documents as pieces of at most size ids, placed in as few sequences as bin completion finds.

    Groups of about GROUP pieces, dealt by hash, are packed each by itself, so a task
    holds a few numbers for each of a bounded number of pieces, however many or long the
    documents are; with_ids adds the ids themselves (binary, little-endian 32-bit), at
    most GROUP x size of them on average. The pieces are written to the shared folder
    first, so a task that is run again finds the same ones. A null text counts as empty
    and gives one piece, the end id alone. Null doc_ids and repeated rows are packed like
    any other row; an empty table gives no rows; other columns are left out.
    """
    pieces = checkpointed(pieces_of(docs, path, size, end_id, with_ids))
    groups = max(1, math.ceil(pieces.count() / GROUP))
    pieces = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(groups))).drop("row")
    kept = [c for c in pieces.columns if c != "_group"]
    schema = T.StructType([*(pieces.schema[c] for c in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "start", "ids_crc32")])
        bins, offsets = place(table["length"].to_numpy(), size)
        ids = (table["_group"].to_numpy() << 32) + bins
        return table.select(kept).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    return pieces.groupBy("_group").applyInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves of pack(..., with_ids=True): sequence_id, n_ids, and the ids in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), joined.alias("ids"))
