"""N-gram Jaccard join over a token-group matrix.

Documents are sets of distinct five-word shingles; two link at a Jaccard
similarity of 0.8 and more.  The join is exact (up to collisions of 64-bit
hashes) and returns connected components of links.

1.  Documents with equal sets form a class; one of them stands for it.
2.  Classes with the same least shingle hash under one of three orders form
    first groups, split into blocks of bounded size that share a pivot.  All pairs of a block are
    checked; linked classes become one similar group.
3.  The token-group matrix has the union of each group's tokens.  Only prefix
    tokens are needed: in a global order, rarest first, sets that link share
    one of their first ``n - ceil(0.8 n) + 1``.  The number of a query's prefix
    tokens in a group's union, and the place of the first, bound its overlap
    with every member.
4.  Groups that could hold a partner, by that bound and their sizes, are opened
    block by block, and the query is checked against the members.  Query and
    group are never in the same component, so groups of thousands of near
    copies are not compared again.
5.  Components of all links are spread to the members of each class.

The order of tokens puts shingles that a mergeable summary of all documents
found frequent last; it only decides cost.  No step gathers more than a block
and a bounded share of its queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialised
from tickloom.llm.components import components

WORDS = 5
#: Orders under which a least hash is taken: a near copy whose edits cost it the
#: least shingle of its original under one order likely has that of another.
ORDERS = 3
#: Classes in a block, queries that meet a block in one task.
BLOCK, QUERIES = 256, 1000
#: Frequent shingles a task reports, and those the order knows (512 KB).
TASK_FREQUENT, FREQUENT = 8192, 32768
#: Document numbers that may be broadcast (8 bytes each before hashing).
MAX_BROADCAST = 1_000_000
#: Rows and bytes of text worked on at once.
ROWS, SLAB = 500, 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slab_sets(texts: list[bytes]) -> list[np.ndarray]:
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    raw = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    blank = _BLANK[raw]
    inside = np.flatnonzero(~blank)
    empty = np.zeros(0, np.uint64)
    if not len(inside):
        return [empty] * len(texts)
    opens = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    first = np.searchsorted(inside, opens)
    length = np.diff(np.append(first, len(inside)))
    place = np.arange(len(inside)) - np.repeat(first, length)
    word = mixed(np.add.reduceat(mixed(raw[inside].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1)), first))
    bounds = np.searchsorted(opens, np.append(0, np.cumsum(sizes)))
    rolled = np.zeros(len(word), np.uint64)
    for k in range(WORDS):
        rolled[: len(word) - k] += mixed(word[k:] + np.uint64(k + 1))
    rolled = mixed(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            whole = sum((mixed(word[a + k : a + k + 1] + np.uint64(k + 1)) for k in range(b - a)), np.full(1, 100 + b - a, np.uint64))
            out.append(mixed(whole))
        else:
            out.append(empty)
    return out


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text; none for null or wordless ones."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append((text or "").encode())
        size += len(held[-1])
        if size >= SLAB:
            yield from _slab_sets(held)
            held, size = [], 0
    if held:
        yield from _slab_sets(held)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _fingerprint(s: np.ndarray) -> tuple[int, int, list[int]]:
    """Two sums that name a set, and its least hashes under other orders."""
    under = [mixed(s ^ mixed(np.uint64(k + 11) * np.ones(1, np.uint64))) for k in range(ORDERS)]
    return *(int(h.sum().astype(np.int64)) for h in under[:2]), [int(h.min().astype(np.int64)) for h in under]


class _Frequent:
    """A Misra-Gries summary: what is more frequent than 1 / capacity is surely in it."""

    def __init__(self, capacity: int):
        self.capacity, self.held, self.n = capacity, [], 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, s: np.ndarray) -> None:
        self.held.append(s)
        self.n += len(s)
        if self.n > 500_000:
            self.fold()

    def fold(self) -> None:
        keys = np.concatenate([self.keys, *self.held])
        weights = np.concatenate([self.counts, np.ones(self.n, np.int64)])
        self.held, self.n = [], 0
        keys, at = np.unique(keys, return_inverse=True)
        counts = np.bincount(at, weights, len(keys)).astype(np.int64)
        if len(keys) > self.capacity:
            counts -= np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1]
        self.keys, self.counts = keys[counts > 0], counts[counts > 0]


def sets_table(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Per row: ``doc_id, n, f1, f2, least``; and frequent shingles, in rising order of frequency."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _Frequent(TASK_FREQUENT)
        names = ["doc_id", "n", "f1", "f2", "least", "shingle", "count"]
        for batch in _slices(batches):
            rows = []
            for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist()), strict=True):
                rows.append((doc_id, len(s), *(_fingerprint(s) if len(s) else (0, 0, []))))
                frequent.add(s)
            cols = list(zip(*rows, strict=True)) or [()] * 5
            none = pa.nulls(len(rows), pa.int64())
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols, kinds), none, none], names=names)
        frequent.fold()
        keep = frequent.counts > 1
        k = int(keep.sum())
        none = pa.nulls(k, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(k, pa.list_(pa.int64())), pa.array(frequent.keys[keep].view(np.int64)), pa.array(frequent.counts[keep])], names=names)

    out = docs.select("doc_id", "text").mapInArrow(read, "doc_id long, n long, f1 long, f2 long, least array<long>, shingle long, count long")
    out = materialised(out, "shingles")
    top = out.where("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("c")).orderBy(F.desc("c"), "shingle").limit(FREQUENT)
    ranked = [r.shingle for r in top.collect()]  # at most FREQUENT
    return out.where("n is not null").drop("shingle", "count"), np.asarray(ranked[::-1], np.int64).view(np.uint64)


def ordered(s: np.ndarray, keys: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """A set in the global order: unknown shingles by hash, then known ones by frequency."""
    if not len(keys):
        return s
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    return s[np.argsort(np.where(keys[at] == s, ranks[at] + 1, 0), kind="stable")]


def _prefixes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``doc_id, prefix``: the tokens of which linked sets share one."""
    order = np.argsort(frequent)
    keys = frequent[order]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = []
            for s in shingle_sets(batch.column(1).to_pylist()):
                n = len(s)
                rows.append(ordered(s, keys, order)[: n - (4 * n + 4) // 5 + 1].view(np.int64) if n else np.zeros(0, np.int64))
            offsets = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
            values = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(read, "doc_id long, prefix array<long>")


def _sized(df: DataFrame) -> DataFrame:
    """A written table, with a broadcast hint where its count proves it small."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def _placed_sets(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (``cid`` and a struct ``place``) with the ``tokens`` of each class, as 8-byte words.

    Sets are read from the texts and move once, to where they are needed.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sets, pa.binary())], names=["cid", "places", "tokens"])

    kind = places.schema["place"].dataType.simpleString()
    per_class = materialised(places.groupBy("cid").agg(F.collect_set("place").alias("places")), "places")
    mine = docs.join(_sized(per_class), F.col("doc_id") == F.col("cid")).select("cid", "text", "places")
    moved = mine.mapInArrow(read, f"cid long, places array<{kind}>, tokens binary")
    return moved.select("cid", "tokens", F.explode("places").alias("place")).select("cid", "tokens", "place.*")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left set with every right set."""
    tokens = np.concatenate(right)
    owner = np.repeat(np.arange(len(right)), [len(r) for r in right])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for i, s in enumerate(left):
        a, b = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
        size = b - a
        if total := int(size.sum()):
            at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(total)
            out[i] = np.bincount(owner[at], minlength=len(right))
    return out


def _linked(overlap: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * overlap >= 80 * (n[:, None] + m[None, :] - overlap)


def _sets_in(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    sets = [np.frombuffer(t, np.uint64) for t in table["tokens"].to_pylist()]
    return table["cid"].to_numpy(), sets, np.fromiter(map(len, sets), np.int64, len(sets))


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    u, v = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _block_links(group: pa.Table) -> pa.Table:
    """Enough links of a block to connect all that are linked within it."""
    ids, sets, sizes = _sets_in(group)
    label, out = np.arange(len(ids)), []
    overlap = _overlaps(sets, sets)
    for i, j in zip(*np.nonzero(np.triu(_linked(overlap, sizes, sizes), 1)), strict=True):
        if label[i] != label[j]:
            label[label == label[j]] = label[i]
            out.append((ids[i], ids[j]))
    return _links(out)


def _open_block(group: pa.Table) -> pa.Table:
    """One link from each component among the queries to the block's members, if there is any."""
    asks = group["comp"].is_valid()
    members, queries = group.filter(pc.invert(asks)), group.filter(asks).sort_by("comp")
    out = []
    if members.num_rows and queries.num_rows:
        ids, inside, sizes = _sets_in(members)
        comps = queries["comp"].to_numpy()
        starts = np.flatnonzero(np.append(True, comps[1:] != comps[:-1]))
        for begin, end in zip(starts, np.append(starts[1:], len(comps)), strict=True):
            for at in range(begin, end, 32):
                own, asked, lengths = _sets_in(queries.slice(at, min(32, end - at)))
                hit = np.argwhere(_linked(_overlaps(asked, inside), lengths, sizes))
                if len(hit):
                    out.append((own[hit[0][0]], ids[hit[0][1]]))
                    break
    return _links(out)


def _first_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links inside groups of one least hash, block by block; a large group's blocks share its pivot."""
    signed = classes.select("cid", F.posexplode("least").alias("order", "least"))
    groups = signed.groupBy("order", "least").agg(F.count("*").alias("size"), F.min("cid").alias("pivot")).where("size > 1")
    placed = signed.join(groups, ["order", "least"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    own = F.array(F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    blocks = placed.select("cid", "order", "least", F.explode(F.when(F.col("cid") == F.col("pivot"), every).otherwise(own)).alias("block"))
    sets = _placed_sets(docs, blocks.select("cid", F.struct("order", "least", "block").alias("place")))
    return sets.groupBy("order", "least", "block").applyInArrow(_block_links, "u long, v long")


def _cross_links(docs: DataFrame, classes: DataFrame, labels: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Links between classes of different components of the first links."""
    known = classes.select("cid", F.col("n").cast("int").alias("n")).join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    known = known.select("cid", "n", F.coalesce("label", "cid").alias("comp"))
    # the union of a group is kept per block of it
    sized = known.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    known = known.join(sized, "comp").select("cid", "n", "comp", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block"))
    known = materialised(known, "groups")

    prefixes = _prefixes(docs, frequent).withColumnRenamed("doc_id", "cid").join(_sized(known), "cid")
    tokens = prefixes.select("cid", "n", "comp", "block", F.posexplode("prefix").alias("pos", "token"))
    # tokens of a single component need no further look, and most are; prefixes
    # are read again for the others, which is cheaper than moving them all
    met_tokens = tokens.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("token")
    shared = materialised(tokens.join(_sized(materialised(met_tokens, "mixed")), "token", "left_semi"), "tokens")

    matrix = shared.groupBy("token", "comp", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    matrix = matrix.select("token", F.col("comp").alias("group"), "block", "lo", "hi")
    met = shared.select("cid", "n", "comp", "pos", "token").join(matrix, "token").where("comp < group and 100 * n >= 80 * lo and 100 * hi >= 80 * n")
    bound = met.groupBy("cid", "n", "comp", "group", "block").agg(
        F.count("*").alias("c"), F.min("pos").alias("pos"), F.greatest(F.min("lo"), F.floor(0.8 * F.col("n"))).alias("a"), F.least(F.max("hi"), F.ceil(1.25 * F.col("n"))).alias("b")
    )
    # a member of size m in [a, b] links if 180 * overlap >= 80 * (n + m).  The
    # overlap is at most n - pos; and at most the c shared prefix tokens plus
    # what follows the prefix that ends first, 0.8 of a set.  What the latter
    # leaves for c to reach is least at an end of [a, b].
    enough = "180 * c >= least(80 * (n + a) - 144 * greatest(n, a), 80 * (n + b) - 144 * greatest(n, b))"
    asked = bound.where("180 * (n - pos) >= 80 * (n + a)").where(enough).select("cid", "comp", "group", "block")
    asked = materialised(asked, "asked")

    shares = asked.groupBy("group", "block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shares"))
    asking = asked.join(shares, ["group", "block"]).withColumn("share", F.pmod(F.xxhash64("cid"), F.col("shares")).cast("int"))
    members = known.select("cid", F.col("comp").alias("group"), "block").join(shares, ["group", "block"])
    members = members.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("comp", F.lit(None).cast("long"))
    place = F.struct("group", "block", "share", "comp").alias("place")
    sets = _placed_sets(docs, asking.select("cid", place).unionByName(members.select("cid", place)))
    return sets.groupBy("group", "block", "share").applyInArrow(_open_block, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_shingles, component_id``.

    ``component_id`` is the least id that links reach.  Rows without words link
    with nothing; rows without id reach no other and get null.  An id names one
    text: equal rows give equal results, and texts under one id count as linked.
    """
    sets, frequent = sets_table(docs)
    filled = sets.where("n > 0 and doc_id is not null")
    key = ["n", "f1", "f2"]
    classes = materialised(filled.groupBy(*key).agg(F.min("doc_id").alias("cid"), F.first("least").alias("least")), "classes")
    first = materialised(_first_links(docs, classes), "first")
    labels = components(first)
    cross = _cross_links(docs, classes, labels, frequent)
    # members hang on their class; rows that share an id join their classes
    member = filled.join(classes, key).select(F.col("doc_id").alias("u"), F.col("cid").alias("v")).where("u <> v")
    found = materialised(components(first.unionByName(cross).unionByName(member)), "components")
    return sets.join(found, sets["doc_id"] == found["node"], "left").select(
        sets["doc_id"],
        F.col("n").alias("n_shingles"),
        F.coalesce(F.col("label"), sets["doc_id"]).alias("component_id"),
    )


def without_copies(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``docs`` without the ids that ``texts`` (``doc_id``, ``text``) shows as near duplicates of a lesser id.

    Rows without id or words are no one's copies and stay; rows of one id stay or go together.
    """
    others = near_duplicates(texts).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(others, F.col("doc_id") == F.col("__gone"), "left_anti")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one of the least id; columns unchanged.

    Rows without id or words are no one's copies and stay; equal rows stay together.
    """
    return without_copies(docs, docs)
