"""Similarity self-join on word shingles by adaptive multi-match prefixes.

All shingles are put in one global order, rare before frequent (document frequencies are
counted over every document). Two documents whose Jaccard similarity reaches the threshold
must share at least l shingles among the first |x| - ceil(t|x|) + l of each. A document whose
prefix is expected to meet many candidates takes a larger l: a longer prefix, and more shared
prefix shingles asked for before a pair is verified on the full sets.

A posting list is led by the document of smallest hash in it, and documents meet in their leaders' groups:
two that share a list are both in its leader's group, and lists of one family have few leaders, so a set is
shipped a few times and not once for each pair. In a large group each member is first compared with the leader; those that link
with it are connected, and only pairs with one that does not are compared further.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpointed, components, frugal, mixed, plan_bytes, release, shingle_hashes, small_batches, table, text_column, text_slices, word_hashes

#: Bits of the fixed-size maps that are broadcast (2 MB each).
MAP_BITS = 24
#: Bits of the fixed-size map of shingles in two documents or more (16 MB); only these are posted.
PAIR_BITS = 27
#: A shingle in more documents than this counts as frequent; raised until the frequent ones fill an eighth of a map.
FREQUENT = 32
#: Each further class of frequency starts at so many times the one before.
CLASS_STEP = 16
#: The largest number of shared prefix shingles that is asked for.
MOST_MATCHES = 8
#: Cost of verifying a pair, in posting-list entries read.
VERIFY_COST = 20.0
#: A leader's group is cut in tiles of about so many documents, and shingles; each two tiles are compared in a task of their own.
TILE, TILE_SHINGLES = 512, 1 << 20
#: Rows (leader, tiles) that are broadcast at most; more are joined by shuffling.
BROADCAST_ROWS = 1 << 19
#: Distinct shingles that a task compares at once.
COLUMNS = 4096


def _sets(batch_texts: pa.Array, width: int):
    for row, data, offsets in text_slices(batch_texts):
        yield row, shingle_hashes(*word_hashes(data, offsets), width)


def _signature(s: np.ndarray) -> tuple[int, int, int]:
    """A set's size and two sums of hashes of its shingles."""
    again = mixed(s ^ np.uint64(0x5851F42D4C957F2D))
    return len(s), *(int(x.sum(dtype=np.uint64).view(np.int64)) for x in (s, again))


def _place(fingerprints: np.ndarray, bits: int = MAP_BITS) -> np.ndarray:
    return (mixed(fingerprints + np.uint64(1)) >> np.uint64(64 - bits)).astype(np.int64)


def _marked(map_bytes: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (map_bytes[places >> 3] >> (places & 7).astype(np.uint8)) & 1


def _map_of(places: np.ndarray) -> np.ndarray:
    flags = np.zeros(1 << MAP_BITS, bool)
    flags[places] = True
    return np.packbits(flags, bitorder="little")


def _packed(tokens: np.ndarray, counts: np.ndarray, bucket_bits: int) -> list[dict]:
    """One row for each bucket of leading bits: the trailing bits of its distinct tokens, and (token, further occurrences) of those that repeat."""
    rest = (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    again = counts > 1
    repeats = np.stack([rest[again].astype(np.int64), counts[again] - 1], axis=1)
    firsts = np.arange(1 << bucket_bits, dtype=np.uint64) << np.uint64(32)
    parts = np.split(rest, np.searchsorted(tokens, firsts)[1:])
    more = np.split(repeats, np.searchsorted(tokens[again], firsts)[1:])
    return [{"bucket": k, "packed": p.tobytes(), "repeats": m.tobytes()} for k, (p, m) in enumerate(zip(parts, more, strict=True)) if len(p)]


def _frequencies(docs: DataFrame, width: int, bucket_bits: int, above: int) -> DataFrame:
    """(token, n) of the shingles in more than ``above`` documents; a token is a shingle hash's leading bits.

    Besides, one row for each bucket has in ``marks`` its share of a map of the shingles in two documents or more.

    Tasks pack the trailing 32 bits of the distinct tokens of many documents in one row for each bucket
    of leading bits, and how often those come that come more than once: the shuffle moves four bytes for a shingle of a
    document, and a few bytes for millions of a shingle that all documents have.
    """
    shift = np.uint64(64 - 32 - bucket_bits)
    schema = pa.schema([("bucket", pa.int64()), ("packed", pa.binary()), ("repeats", pa.binary())])

    def pack(batches):
        held: list[np.ndarray] = []

        def emit():
            tokens, counts = np.unique(np.concatenate(held) >> shift, return_counts=True)
            held.clear()
            return pa.RecordBatch.from_pylist(_packed(tokens, counts, bucket_bits), schema)

        count = 0
        for batch in batches:
            for _, sets in _sets(batch.column(0), width):
                held.extend(s for s in sets if len(s))
                count += sum(map(len, sets))
                if count >= 1 << 21:
                    yield emit()
                    count = 0
        if count:
            yield emit()

    def count(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        tokens, n = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group.column("packed")]), return_counts=True)
        more = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group.column("repeats")]).reshape(-1, 2)
        np.add.at(n, np.searchsorted(tokens, more[:, 0].astype(np.uint32)), more[:, 1])
        keep = n > above
        flags = np.zeros(1 << PAIR_BITS - bucket_bits, bool)
        flags[_place(tokens[n > 1].astype(np.uint64), PAIR_BITS - bucket_bits)] = True
        found = {"token": [*(tokens[keep].astype(np.int64) | (bucket << 32)).tolist(), bucket], "n": [*n[keep].tolist(), 0], "marks": [None] * int(keep.sum()) + [np.packbits(flags, bitorder="little").tobytes()]}
        return pa.table(found, schema=pa.schema([("token", pa.int64()), ("n", pa.int64()), ("marks", pa.binary())]))

    return docs.select(text_column()).mapInArrow(frugal(pack), "bucket long, packed binary, repeats binary").groupBy("bucket").applyInArrow(count, "token long, n long, marks binary")


def _frequency_maps(docs: DataFrame, width: int, bucket_bits: int) -> tuple[list[np.ndarray], np.ndarray, int]:
    """Maps of frequent shingles by class, the map of shingles in two documents or more, and the first class's threshold."""
    every = checkpointed(_frequencies(docs, width, bucket_bits, FREQUENT))
    counted = every.filter("n > 0").select("token", "n")
    least, most = FREQUENT, 1 << (MAP_BITS - 3)
    by_size = {r["k"]: r["c"] for r in counted.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("c")).collect()}
    while sum(c for k, c in by_size.items() if 2 ** (k + 1) > least) > most:
        least *= 2
    maps = []
    for level in range(3):
        rows = counted.filter(F.col("n") > least * CLASS_STEP**level).select("token").toPandas()
        maps.append(_map_of(_place(rows["token"].to_numpy(np.int64).astype(np.uint64))))
    share = 1 << PAIR_BITS - bucket_bits - 3
    paired = np.zeros(1 << PAIR_BITS - 3, np.uint8)
    for r in every.filter("n = 0").select("token", "marks").toLocalIterator():
        paired[r["token"] * share : (r["token"] + 1) * share] = np.frombuffer(r["marks"], np.uint8)
    return maps, paired, least


class ShingleOrder:
    """The global order of shingles, and which of them several documents have, in maps of fixed size."""

    def __init__(self, maps: list[np.ndarray], paired: np.ndarray, bucket_bits: int):
        self.maps, self.paired, self.shift, self.region = maps, paired, np.uint64(32 - bucket_bits), PAIR_BITS - bucket_bits

    def look_up(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each shingle's class of frequency, and whether two documents or more have it."""
        tokens = shingles >> self.shift
        places = _place(tokens)
        level = sum((_marked(m, places) for m in self.maps), np.zeros(len(shingles), np.uint8))
        at = (tokens >> np.uint64(32)).astype(np.int64) << self.region | _place(tokens & np.uint64(0xFFFFFFFF), self.region)
        return level, _marked(self.paired, at).astype(bool)


def shingle_order(docs: DataFrame, width: int) -> tuple[ShingleOrder, int]:
    """The order, from the frequencies of all shingles of all documents, and the threshold of its first class."""
    small_batches(docs.sparkSession)
    bucket_bits = min(20, max(5, int(np.log2(max(1, plan_bytes(docs) >> 23))) + 1))
    maps, paired, least = _frequency_maps(docs, width, bucket_bits)
    release(docs.sparkSession)
    return ShingleOrder(maps, paired, bucket_bits), least


def shingle_index(docs: DataFrame, width: int, percent: int, shared: Broadcast, least: int) -> DataFrame:
    """(doc_id, n, s1, s2, matches, prefix): set size, set signature, shared prefix shingles asked for, prefix.

    Shingles that no other document has are left out of the prefix, and a document of which too many are
    such has no prefix at all: it cannot link.
    """
    cost_of = least * float(CLASS_STEP) ** np.arange(4) / 2
    cost_of[0] = 1.0
    asked = np.arange(1, MOST_MATCHES + 1)

    def index(batches):
        order_of = shared.value
        for batch in batches:
            ids, n, s1, s2, matches, prefixes = batch.column(0), [], [], [], [], []
            for _, sets in _sets(batch.column(1), width):
                sizes = np.array([len(s) for s in sets])
                level, posted = order_of.look_up(np.concatenate(sets))
                ends = np.cumsum(sizes)
                for k, s in enumerate(sets):
                    for own, x in zip((n, s1, s2), _signature(s), strict=True):
                        own.append(x)
                    if not len(s):
                        matches.append(0), prefixes.append(np.zeros(0, np.int64))
                        continue
                    part = slice(ends[k] - len(s), ends[k])
                    least_shared = -(-percent * len(s) // 100)
                    if np.count_nonzero(posted[part]) < least_shared:
                        matches.append(0), prefixes.append(np.zeros(0, np.int64))
                        continue
                    free = len(s) - least_shared
                    own = level[part]
                    order = np.argsort(own, kind="stable")[: free + MOST_MATCHES] if own.any() else np.arange(min(len(s), free + MOST_MATCHES))
                    costs = np.cumsum(cost_of[own[order]])
                    choices = asked[: len(order) - free]
                    reads = costs[free + choices - 1]
                    most = int(choices[np.argmin(reads + VERIFY_COST * reads / choices)])
                    matches.append(most)
                    order = order[: free + most]
                    prefixes.append(s[order[posted[part][order]]].view(np.int64))
            lengths = np.concatenate(([0], np.cumsum([len(p) for p in prefixes])))
            lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(matches, pa.int32()), lists], ["doc_id", "n", "s1", "s2", "matches", "prefix"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return checkpointed(kept.mapInArrow(frugal(index), "doc_id long, n long, s1 long, s2 long, matches int, prefix array<long>"))


def _id_map(ids: DataFrame) -> np.ndarray:
    """A fixed-size map of hashed ids."""
    rows = ids.select((F.shiftrightunsigned(F.xxhash64("id"), 64 - MAP_BITS)).alias("p")).distinct().toPandas()
    return _map_of(rows["p"].to_numpy(np.int64))


def _set_store(docs: DataFrame, wanted: DataFrame, width: int, shared: Broadcast) -> DataFrame:
    """(class, shingles) of the documents whose id is in ``wanted``, and of few others that share a place of the map.

    Shingles are in the global order, without those that no other document has: no intersection holds them.
    """
    marks_of = docs.sparkSession.sparkContext.broadcast(_id_map(wanted))

    def keep(batches):
        marks, order_of = marks_of.value, shared.value
        for batch in batches:
            texts = batch.column(1).filter(pa.array(_marked(marks, batch.column(0).to_numpy()).astype(bool)))
            signatures, out = [], []
            for _, sets in _sets(texts, width):
                for s in sets:
                    level, posted = order_of.look_up(s)
                    signatures.append(_signature(s))
                    out.append(s[posted][np.argsort(level[posted], kind="stable")].tobytes())
            columns = [pa.array([x[k] for x in signatures], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], ["n", "s1", "s2", "shingles"])

    rows = docs.filter("doc_id is not null").select(F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long")), 64 - MAP_BITS).alias("place"), text_column().alias("text"))
    sets = rows.mapInArrow(frugal(keep), "n long, s1 long, s2 long, shingles binary")
    return sets.select(F.xxhash64("n", "s1", "s2").alias("class"), "shingles").dropDuplicates(["class"])


def _common(rows: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
    """How many tokens each two of ``n`` rows share, by products of bounded column blocks."""
    _, column, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    keep = counts[column] > 1
    rows = rows[keep]
    _, column = np.unique(column[keep], return_inverse=True)
    kind = np.float32 if len(column) < 1 << 24 else np.float64
    out = np.zeros((n, n), kind)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        block = np.zeros((n, COLUMNS), kind)
        block[rows[a:b], column[a:b] - lo] = 1
        out += block @ block.T
    return out


def _linked(groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what the pairs within each group (leader, t1, t2) connect that reach the threshold.

    A pair is a candidate if it shares as many prefix shingles as both ask for; candidates are verified by
    the intersection of their whole sets. Of two tiles only pairs across are looked at.
    """

    def verify(group: pa.Table) -> pa.Table:
        ids, n, asked, posted = (group.column(c).to_numpy() for c in ("id", "n", "matches", "prefix_size"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        prefixes = [s[:p] for s, p in zip(sets, posted, strict=True)]
        m = len(ids)
        near = _common(np.repeat(np.arange(m), posted), np.concatenate(prefixes), m) >= np.minimum(asked[:, None], asked[None, :])
        near &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
        near &= np.triu(np.ones((m, m), bool), 1)
        if group.column("t1")[0].as_py() != group.column("t2")[0].as_py():
            tile = group.column("tile").to_numpy()
            near &= tile[:, None] != tile[None, :]
        a, b = np.nonzero(near)
        if len(a):
            used = np.unique(np.concatenate((a, b)))
            place = np.full(m, -1)
            place[used] = np.arange(len(used))
            shared = _common(np.repeat(np.arange(len(used)), [len(sets[k]) for k in used]), np.concatenate([sets[k] for k in used]), len(used))
            inter = shared[place[a], place[b]].astype(np.int64)
            linked = (inter > 0) & (100 * inter >= percent * (n[a] + n[b] - inter))
            a, b = a[linked], b[linked]
        root = list(range(m))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        kept = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                kept.append((x, y))
        one, two = ([ids[k[i]] for k in kept] for i in (0, 1))
        return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})

    return groups.groupBy("leader", "t1", "t2").applyInArrow(verify, "a long, b long")


def _leader_links(members: DataFrame, store: DataFrame, percent: int) -> DataFrame:
    """(leader, class, id, of): members of many-tiled groups that link with their leader itself, and the leader's id."""
    heads = members.filter(F.col("leader") == F.col("class")).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rest = members.filter(F.col("leader") != F.col("class")).withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")))
    columns = ["leader", "tile", "class", "id", "n"]

    def verify(group: pa.Table) -> pa.Table:
        classes, n = group.column("class").to_numpy(), group.column("n").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        head = int(np.flatnonzero(classes == group.column("leader")[0].as_py())[0])
        own = np.sort(sets[head])
        inter = np.array([np.isin(s, own, assume_unique=True).sum() for s in sets])
        linked = (inter > 0) & (100 * inter >= percent * (n + n[head] - inter))
        linked[head] = False
        ids = group.column("id")
        return pa.table({"leader": group.column("leader"), "class": group.column("class"), "id": ids, "of": pa.array([ids[head].as_py()] * len(ids), pa.int64())}).filter(pa.array(linked))

    both = heads.select(columns).unionByName(rest.select(columns)).join(store, "class")
    return both.groupBy("leader", "tile").applyInArrow(verify, "leader long, class long, id long, of long")


def _tiles(count: Column, shingles: Column) -> Column:
    """Tiles of a bounded number of documents, and of shingles but for the longest texts."""
    return F.least(F.ceil(F.greatest(count / TILE, shingles / TILE_SHINGLES)), count)


def _by_leader(members: DataFrame, counts: DataFrame) -> DataFrame:
    """``members`` with what ``counts`` has of their leader, if anything."""
    return members.join(F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts, "leader", "left")


def _tiled_groups(members: DataFrame) -> DataFrame:
    """``members`` (with linked) in groups (leader, t1, t2) in which all pairs meet but those of two that link with their leader.

    Members that do not link with it have the first tiles, ``open``, the others the next ones; a tile meets all open ones.
    """

    def part(own: Column) -> Column:
        return F.coalesce(_tiles(F.count(F.when(own, 1)), F.sum(F.when(own, F.col("n")))), F.lit(0).cast("long"))

    counts = members.groupBy("leader").agg(part(~F.col("linked")).alias("open"), part(F.col("linked")).alias("closed"))
    members = _by_leader(members, checkpointed(counts.filter("open + closed <> 1"))).fillna({"open": 1, "closed": 0}).filter("open > 0")
    tile = F.when(F.col("linked"), F.col("open") + F.pmod(F.xxhash64("class"), F.col("closed"))).otherwise(F.pmod(F.xxhash64("class"), F.col("open")))
    last = F.when(F.col("linked"), F.col("open")).otherwise(F.col("open") + F.col("closed")) - 1
    members = members.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return members.select("leader", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "class", "id", "n", "matches", "prefix_size")


def link_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) for every row of ``docs``.

    ``width``: words in a shingle; ``percent``: documents link when 100 * intersection >= percent * union.
    Equal sets are one class, compared once. Text null, empty or without words: no shingles, linked
    with nothing. Rows that repeat a doc_id are one document of the graph, which has the links of all their texts;
    each row has its own text's n_shingles. Fewer words than ``width``: the whole sequence is the one shingle. A null doc_id
    links with nothing and is its own (null)
    component. Columns other than doc_id and text are ignored. An empty table gives an empty result.
    """
    order, least = shingle_order(docs, width)
    shared = docs.sparkSession.sparkContext.broadcast(order)
    index = shingle_index(docs, width, percent, shared, least).withColumn("class", F.xxhash64("n", "s1", "s2"))
    classes = index.filter("n > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("id"))
    candidates = index.filter("size(prefix) > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("n", "matches", "prefix")))
    candidates = checkpointed(candidates)
    postings = candidates.select("class", F.explode("prefix").alias("token"))
    lists = postings.groupBy("token").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("class").alias("h"), "class")).alias("first"))
    lists = checkpointed(lists.filter("m > 1").select("token", F.col("first")["class"].alias("leader")))
    meetings = postings.join(lists, "token").select("leader", "class").distinct()
    members = checkpointed(meetings.join(candidates.select("class", "id", "n", "matches", F.size("prefix").alias("prefix_size")), "class"))
    release(docs.sparkSession)
    sizes = checkpointed(members.groupBy("leader").agg(_tiles(F.count("*"), F.sum("n")).alias("tiles")).filter("tiles > 1"))
    members, edges = members.withColumn("linked", F.lit(False)), []
    if not sizes.isEmpty():
        large = _by_leader(members, sizes).filter("tiles > 1")
        stars = checkpointed(_leader_links(large, _set_store(docs, large, width, shared), percent))
        edges.append(stars.select(F.col("of").alias("a"), F.col("id").alias("b")))
        members = members.drop("linked").join(stars.select("leader", "class", F.lit(True).alias("linked")), ["leader", "class"], "left")
        members = checkpointed(members.withColumn("linked", F.coalesce("linked", F.lit(False))))
        release(docs.sparkSession)
    groups = _tiled_groups(members).join(_set_store(docs, members, width, shared), "class")
    edges.append(checkpointed(_linked(groups, percent)))
    release(docs.sparkSession)
    repeated = index.filter("doc_id is not null").groupBy("doc_id").agg(F.min("class").alias("least"), F.max("class").alias("most"))
    repeated = checkpointed(repeated.filter("least <> most").select("doc_id"))
    again = not repeated.isEmpty()
    if again:
        own = index.filter("n > 0").select("doc_id", "class").join(repeated, "doc_id").distinct()
        edges.append(own.join(classes, "class").select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    groups = components(reduce(DataFrame.unionAll, edges))
    named = classes.join(groups, "id", "left").select("class", F.coalesce("component", "id").alias("component"))
    rows = index.select("doc_id", F.col("n").alias("n_shingles"), "class")
    has_links = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = rows.filter(has_links).join(named, "class").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    out = out.unionByName(rows.filter(~has_links).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    if again:
        of_doc = groups.join(repeated, groups["id"] == repeated["doc_id"], "left_semi").select(F.col("id").alias("doc_id"), "component")
        out = out.join(of_doc, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))
    return out


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"), width=3, percent=90)
