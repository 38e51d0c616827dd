"""Packing of tokenised documents into sequences of a fixed length, by bin completion.

A sequence is filled around the largest piece left: the fillings of what is free that no
other filling dominates are enumerated, least waste first, and searched by branch and
bound. A branch ends when the waste so far rules out fewer sequences than the incumbent's;
the first incumbent is best-fit decreasing. A search that has looked at a stated number of fillings
keeps its incumbent. The pieces are packed in blocks of bounded size, so tasks are even and no group grows with the
table; what a block leaves in its emptiest sequence is packed again with that of other blocks.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bpe import WordEncoder
from ._common import checkpointed, frugal, sliced, small_batches, table, text_column

#: Pieces in a block, about.
BLOCK = 4096
#: Fillings that the search of a block looks at before it keeps its incumbent; a search that ends sooner is exact.
NODES = 4096
#: Bytes of text that are tokenised at once, about.
SLICE = 1 << 21

_encoders: dict[str, WordEncoder] = {}


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound on the bins that pieces, ``counts`` by length, need."""
    lengths = np.arange(len(counts))
    n, total = np.cumsum(counts[::-1])[::-1], np.cumsum((counts * lengths)[::-1])[::-1]
    n, total = np.append(n, 0), np.append(total, 0)
    half = capacity // 2 + 1
    best = -(-int(total[0]) // capacity)
    for k in np.flatnonzero(counts[:half]).tolist():
        large = int(n[capacity - k + 1])
        middle = int(n[half]) - large
        free = middle * capacity - int(total[half] - total[capacity - k + 1])
        best = max(best, large + middle + max(0, -(-(int(total[k] - total[half]) - free) // capacity)))
    return max(best, int(n[half]))


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins, as lists of lengths; ``lengths`` come in falling order."""
    by_room: dict[int, list[list[int]]] = defaultdict(list)
    rooms, bins = 0, []
    for x in lengths:
        above = rooms >> x
        if above:
            room = x + (above & -above).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, own = capacity, []
            bins.append(own)
        own.append(x)
        room -= x
        if room:
            by_room[room].append(own)
            rooms |= 1 << room
    return bins


def _dominated(own: tuple[int, ...], slack: int, present: int) -> bool:
    """Whether some elements of a filling, or none, can give way to one longer or equal piece that is free.

    ``present`` has the bits of the free lengths, ``slack`` is what the filling leaves. One element that
    gives way to another of its own length changes nothing and does not count.
    """
    one = more = 0
    for x in own:
        more |= (more | one) << x
        one |= 1 << x
    return bool(_spread(more | 1, slack) & present) or slack > 0 and bool(_spread(one << 1, slack - 1) & present)


def _spread(bits: int, most: int) -> int:
    """Each bit, and the ``most`` above it."""
    width = 0
    while width < most:
        step = min(width + 1, most - width)
        bits |= bits << step
        width += step
    return bits


def fillings(room: int, counts: list[int], present: int):
    """(sum, filling) of all undominated fillings of ``room``, least waste first; None in place of a dominated one.

    ``counts`` has how many pieces of each length are free, ``present`` the bits of these lengths. Fillings of one
    sum are found by a walk over the counts of distinct lengths, which the sums that are still reachable guide.
    """
    lengths, fits = [], present & ((1 << room + 1) - 1)
    while fits:
        lengths.append(fits.bit_length() - 1)
        fits ^= 1 << lengths[-1]
    whole = (1 << room + 1) - 1
    reach = [1]
    for x in reversed(lengths):
        sums, left, copies = reach[-1], min(counts[x], room // x), 1
        while left:
            copies = min(copies, left)
            sums |= sums << copies * x & whole
            left -= copies
            copies *= 2
        reach.append(sums)
    reach.reverse()
    sums = reach[0]
    while sums:
        target = sums.bit_length() - 1
        sums ^= 1 << target
        taken = [0] * len(lengths)
        k, left, most = 0, target, -1
        while k >= 0:
            if left == 0:
                own = tuple(x for x, c in zip(lengths, taken, strict=True) if c for _ in range(c))
                free = present
                for x in set(own):
                    if counts[x] == own.count(x):
                        free ^= 1 << x
                yield target, None if _dominated(own, room - target, free) else own
            elif k < len(lengths):
                if most < 0 and lengths[k] > left:
                    k = bisect.bisect_left(lengths, -left, k, key=lambda x: -x)
                    continue
                c = min(counts[lengths[k]], left // lengths[k]) if most < 0 else most - 1
                while c >= 0 and not reach[k + 1] >> left - c * lengths[k] & 1:
                    c -= 1
                if c >= 0:
                    taken[k], left, k, most = c, left - c * lengths[k], k + 1, -1
                    continue
            # the last length of which some are taken, and one fewer of it
            k -= 1
            while k >= 0 and not taken[k]:
                k -= 1
            if k >= 0:
                most, left = taken[k], left + taken[k] * lengths[k]
                taken[k] = 0


def complete_bins(lengths: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Bins, as lists of lengths: the fewest possible, or the fewest found after ``nodes`` fillings were looked at.

    Depth first; a branch keeps only how many of its fillings it has tried and finds the next one anew.
    """
    lengths = sorted(lengths, reverse=True)
    best = best_fit_decreasing(lengths, capacity)
    counts = np.bincount(lengths, minlength=capacity + 1) if lengths else np.zeros(capacity + 1, np.int64)
    least = least_bins(counts, capacity)
    if len(best) <= least:
        return best
    total, counts = sum(lengths), counts.tolist()
    present = sum(1 << x for x, c in enumerate(counts) if c)

    def take(own):
        nonlocal present
        for x in own:
            counts[x] -= 1
            if not counts[x]:
                present ^= 1 << x

    def put_back(own):
        nonlocal present
        for x in own:
            if not counts[x]:
                present |= 1 << x
            counts[x] += 1

    path: list[tuple[int, ...]] = []
    tried, waste = [0], 0
    while tried and nodes > 0:
        first = present.bit_length() - 1
        own = None
        if present:
            take((first,))
            for at, (size, found) in enumerate(fillings(capacity - first, counts, present)):
                nodes -= 1
                if waste + capacity - first - size > (len(best) - 1) * capacity - total or nodes < 0:
                    break
                if found is not None and at >= tried[-1]:
                    own, tried[-1] = (first, *found), at + 1
                    break
            put_back((first,))
        if own is None:
            tried.pop()
            if path:
                own = path.pop()
                waste -= capacity - sum(own)
                put_back(own)
            continue
        take(own)
        path.append(own)
        waste += capacity - sum(own)
        tried.append(0)
        if not present:
            best = [list(p) for p in path]
            if len(best) <= least:
                break
    return best


def pack_pieces(pieces: DataFrame, capacity: int = 4096, block: int = BLOCK, nodes: int = NODES) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (doc_id, piece, length and any other columns).

    ``pieces`` must be stable when read twice (a table or a checkpoint); no piece is longer than
    ``capacity``. Rows are dealt to blocks by their place, so that repeated rows spread. Each block hands the pieces of
    its emptiest sequence on to a next round of fewer blocks, until one block is left.
    Pieces of one block that are alike in length are placed in order of doc_id and piece.
    """
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    rest, done = pieces, []
    while True:
        blocks = max(1, -(-rest.count() // block))
        dealt = rest.withColumn("__block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
        placed = dealt.groupBy("__block").applyInArrow(_block_packer(capacity, nodes, len(done) << 56, blocks == 1), schema)
        if blocks == 1:
            return reduce(DataFrame.unionAll, done, placed)
        placed = checkpointed(placed)
        done.append(placed.filter("sequence_id >= 0"))
        rest = placed.filter("sequence_id < 0").select(*pieces.columns)


def _block_packer(capacity: int, nodes: int, first: int, last: bool):
    """Places one block's pieces; those of its emptiest sequence get sequence_id -1 unless it is the ``last`` block."""

    def pack(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        ids = pc.fill_null(group.column("doc_id"), -(1 << 63)).to_numpy()
        order = np.lexsort((group.column("piece").to_numpy(), ids, -lengths))
        group, lengths = group.take(pa.array(order)), lengths[order]
        free = {int(x): iter(range(a, b)) for x, a, b in _runs(lengths)}
        whole = lengths == capacity
        bins = [[capacity]] * int(whole.sum()) + complete_bins(lengths[~whole].tolist(), capacity, nodes)
        filled = [sum(own) for own in bins]
        handed_on = -1 if last or min(filled) == capacity else int(np.argmin(filled))
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = first + (group.column("__block")[0].as_py() << 24)
        for k, own in enumerate(bins):
            at = 0
            for x in own:
                row = next(free[x])
                sequence[row], offset[row] = -1 if k == handed_on else base + k, at
                at += x
        return group.drop_columns("__block").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return pack


def _runs(values: np.ndarray):
    edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))
    return ((values[a], a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def tokenised_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document, cut where it exceeds ``capacity``.

    A document's ids are the tokenizer's, then ``end``; a null or empty text has that one id.
    ``with_ids`` adds the ids themselves.
    """
    path = tokenizer or tokenizer_file()
    small_batches(docs.sparkSession)

    def cut(batches):
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        encoder = _encoders[path]
        for batch in _gathered(batches):
            for row, part in sliced(batch.column(1), SLICE):
                ids, bounds = encoder.encode(part, end)
                raw = ids.astype("<u4")
                whole = -(-np.diff(bounds) // capacity)
                doc = np.repeat(np.arange(len(part)), whole)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
                lows = bounds[doc] + piece * capacity
                highs = np.minimum(bounds[doc + 1], lows + capacity)
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip(lows.tolist(), highs.tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(row + doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(highs - lows), pa.array(crcs, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    lists = pa.ListArray.from_arrays(pa.array(np.append(lows, bounds[-1]), pa.int32()), pa.array(raw.view(np.int32)))
                    columns, names = [*columns, lists], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).mapInArrow(frugal(cut), schema)


def _gathered(batches):
    """Batches joined to about SLICE bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= SLICE:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end: int = 1, with_ids: bool = False) -> DataFrame:
    """One row for every piece of every row of ``docs`` with its place: sequence_id and offset.

    Null or empty text: one piece, the end id alone. Null doc_ids and repeated rows are packed like
    others. Other columns are ignored. An empty table gives an empty result. Ties: see ``pack_pieces``.
    """
    return pack_pieces(checkpointed(tokenised_pieces(docs, tokenizer, capacity, end, with_ids)), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
