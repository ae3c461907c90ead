"""Near-duplicate detection: an inverted join over MinHash signature coordinates, confirmed on full shingle sets.

1. Texts with equal shingle sets form a class (hot groups shrink in the partial aggregate, before the shuffle); only
   class representatives, their smallest ids, go on.
2. A signature has K coordinates. Each (coordinate, value) pair is a posting token. A linked pair agrees in at least T
   coordinates, but for a chance of `miss` (T from the binomial tail). Tokens are counted; a representative with fewer
   than T tokens that occur twice can't be linked and is skipped.
3. Prefix: two representatives that agree in T of K tokens share one among their K - T + 1 rarest, in a common order of
   rarity, so only those are posted, and very common passages are mostly not. A pair is handled only under its first
   common token; its other collisions are skipped.
4. Posting lists are dealt in blocks of bounded size, in the order of set sizes, and only pairs of blocks whose sizes
   can reach the similarity become groups (token, block i, block j); a list that holds a third of all rows is many
   tasks. A task counts collisions between two blocks with vectorised comparisons and keeps the pairs that reach T; it
   emits which representatives still matter, never the pairs.
5. Their texts join in, pairs are confirmed on the full sets (64-bit hashes; no sampling), and each block emits a
   spanning forest of its links. Connected components follow. No partner or candidate cap anywhere.

Defined results: a null or blank text has an empty set and links with nothing; a null id links with nothing, its
component is null and it is kept; rows that repeat an id are one node, so they share one component and are all kept or
none; very long texts are hashed in steps and compared whole; a component is named by its smallest id, whatever the
order of rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_BATCHES, lean, returned, scratch, settings, whole_text, written
from .components import components
from .filters import bounded, maybe_in, without
from .shingles import _random, mixed, shingle_sets

COORDINATES = 32
MISS = 1e-6
#: Representatives and shingles in a block of a posting list, about.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 2_000_000

FACTORS, SHIFTS = _random(COORDINATES) | np.uint64(1), _random(COORDINATES)


@cache
def match_threshold(k: int, similarity: float, miss: float = MISS) -> int:
    """The largest T such that Binomial(k, similarity) stays below T with probability `miss` at most."""
    below = 0.0
    for t in range(k + 1):
        below += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if below > miss:
            return max(1, t)
    return k


def signature(hashes: np.ndarray) -> np.ndarray:
    """COORDINATES 32-bit minima of the set under as many permutations."""
    low = np.full(COORDINATES, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048, None] * FACTORS + SHIFTS
        np.minimum(low, part.min(axis=0), out=low)
    return (mixed(low) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, tag, n_shingles, cls, sig): tag is a hash of the raw text; cls a digest of the shingle set, null where
    that is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, sigs = [], [], []
            for hashes in shingle_sets(batch.column(1), k):
                sizes.append(len(hashes))
                classes.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                sigs.append(signature(hashes))
            values = pa.array(np.concatenate(sigs) if sigs else np.empty(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1) * COORDINATES, pa.int32()), values)
            columns = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "n_shingles", "cls", "sig"])

    return texts_of(docs).mapInArrow(lean(run), "doc_id long, tag long, n_shingles long, cls binary, sig array<int>")


def texts_of(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))


def candidates(classes: DataFrame, least: int) -> DataFrame:
    """(node, tag, n, sig, prefix) of representatives that can reach `least` matches; prefix: its rarest shared tokens, in order."""
    token = F.shiftleft(F.col("coordinate").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    postings = classes.select("node", "tag", F.posexplode("sig").alias("coordinate", "value")).select("node", "tag", token.alias("token"))
    # counts are written, so that Spark can split the join's large partitions: a token may be in a third of all rows
    counts = written(postings.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).filter("freq > 1"), "tokens")
    shared = postings.join(counts, "token").groupBy("node", "tag").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("tokens"))
    shared = shared.filter(F.size("tokens") >= least)
    prefix = F.slice(F.col("tokens.token"), F.lit(1), F.size("tokens") - least + 1)
    return classes.join(shared, ["node", "tag"]).select("node", "tag", "n", "sig", prefix.alias("prefix"))


def blocked(found: DataFrame, num: int, den: int) -> DataFrame:
    """Candidates under each of their prefix tokens, dealt to pairs (i, j), i <= j, of blocks of the token's list.

    Blocks follow set sizes, from a histogram of the list's sizes. A row goes to the pairs of its block with those of the
    sizes that it can be linked to, in steps of a millionth of a logarithm; linked rows always meet.
    """
    posted = found.select("node", "tag", "n", "sig", "prefix", F.posexplode("prefix").alias("place", "token"))
    weight = F.greatest(F.lit(1.0), F.col("n") * float(BLOCK_ROWS / BLOCK_SHINGLES))
    sizes = posted.groupBy("token", "n").agg(F.count(F.lit(1)).alias("rows")).withColumn("weight", F.col("rows") * weight)
    by_size = Window.partitionBy("token").orderBy("log")
    reach = int(1e6 * math.log(den / num)) + 2
    sizes = sizes.withColumn("log", (F.log(F.col("n").cast("double")) * 1e6).cast("long"))
    sizes = sizes.withColumn("list", F.sum("rows").over(Window.partitionBy("token"))).filter("list > 1")
    upto = F.sum("weight").over(by_size.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sizes.withColumn("first", F.floor((upto - F.col("weight")) / BLOCK_ROWS + 1e-9).cast("int"))
    sizes = sizes.withColumn("last", F.greatest(F.col("first"), (F.ceil(upto / BLOCK_ROWS - 1e-9) - 1).cast("int")))
    near = by_size.rangeBetween(-reach, reach)
    sizes = sizes.withColumn("low", F.min("first").over(near)).withColumn("high", F.max("last").over(near))
    sizes = written(sizes.select("token", "n", "first", "last", "low", "high"), "lists")
    posted = posted.join(sizes, ["token", "n"])
    own = (F.col("first") + F.pmod(F.xxhash64("node", "tag"), F.col("last") - F.col("first") + 1)).cast("int")
    pairs = F.transform(F.sequence("low", "high"), lambda other: F.struct(F.least("own", other).alias("i"), F.greatest("own", other).alias("j")))
    posted = posted.withColumn("own", own).withColumn("at", F.explode(pairs))
    return posted.select("token", "at.i", "at.j", "own", "node", "tag", "n", "sig", F.slice("prefix", 1, F.col("place")).alias("earlier"))


KEY = ("token", "i", "j")
NONE = np.empty(0, np.uint64)
#: Posting lists of at most so many rows are handled many at a time.
SMALL = 64


class Group:
    """Rows of one (token, i, j), or, if small, of many short lists (i = j), which start at `starts` and have `sizes` rows."""

    def __init__(self, table: pa.Table, starts: np.ndarray | None = None, sizes: np.ndarray | None = None):
        self.table, self.starts, self.sizes, self.small = table, starts, sizes, starts is not None

    def numbers(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Group]:
    """Batches that are sorted by KEY, as groups; a list that is long, or cut by the end of a batch, has a group of its own."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in KEY])
        change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        starts = np.concatenate(([0], change))
        sizes = np.diff(starts, append=batch.num_rows)
        short = (sizes <= SMALL) & (keys[1, starts] == keys[2, starts])
        short[[0, -1]] = False
        if short.any():
            yield Group(pa.Table.from_batches([batch]), starts[short], sizes[short])
        for a, size in zip(starts[~short].tolist(), sizes[~short].tolist()):
            now = tuple(keys[:, a])
            if held and now != last:
                yield Group(pa.Table.from_batches(held))
                held = []
            last = now
            held.append(batch.slice(a, size))
    if held:
        yield Group(pa.Table.from_batches(held))


def _pairs_within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs l < r of each short list."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for size in np.unique(sizes).tolist():
        l, r = np.triu_indices(size, 1)
        at = starts[sizes == size][:, None]
        left.append((at + l).ravel())
        right.append((at + r).ravel())
    return np.concatenate(left), np.concatenate(right)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a - offsets[0] : b - offsets[0]] for a, b in zip(offsets[:-1], offsets[1:])]


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set: products of 0/1 matrices over shared elements."""
    sizes = [len(x) for x in left], [len(x) for x in right]
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    known = np.intersect1d(a, b)
    total = np.zeros((len(left), len(right)), np.float32)
    rows = [np.repeat(np.arange(len(s)), s) for s in sizes]
    spots = [np.searchsorted(known, x) for x in (a, b)]
    keep = [(np.append(known, known[-1:])[s] == x) if len(known) else np.zeros(len(x), bool) for s, x in zip(spots, (a, b))]
    order = [np.argsort(s[k], kind="stable") for s, k in zip(spots, keep)]
    places = [(r[k][o], s[k][o]) for r, s, k, o in zip(rows, spots, keep, order)]
    for at in range(0, len(known), 2048):
        tiles = []
        for (r, s), count in zip(places, (len(left), len(right))):
            lo, hi = np.searchsorted(s, [at, at + 2048])
            tile = np.zeros((count, 2048), np.float32)
            tile[r[lo:hi], s[lo:hi] - at] = 1
            tiles.append(tile)
        total += tiles[0] @ tiles[1].T
    return total


class Similar:
    """den * intersection >= num * union."""

    def __init__(self, num: int, den: int, least: int):
        self.num, self.den, self.least = num, den, least

    def open_pairs(self, group: Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Left rows, right rows, and the pairs of their places that reach the match threshold under this token first."""
        node, n = group.numbers("node"), group.numbers("n")
        sig = group.table.column("sig").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)
        earlier = _lists(group.table.column("earlier"))
        if group.small:
            left, right = _pairs_within(group.starts, group.sizes)
            keep = (np.minimum(n[left], n[right]) * self.den >= np.maximum(n[left], n[right]) * self.num) & (node[left] != node[right])
            left, right = left[keep], right[keep]
            keep = np.concatenate([(sig[left[a : a + 65536]] == sig[right[a : a + 65536]]).sum(axis=1) >= self.least for a in range(0, max(1, len(left)), 65536)])
            left, right = left[keep], right[keep]
            keep = np.array([not np.isin(earlier[l], earlier[r]).any() if len(earlier[l]) and len(earlier[r]) else True for l, r in zip(left, right)], bool)
            places = np.arange(int(keep.sum()))
            return left[keep], right[keep], np.column_stack([places, places])
        own = group.numbers("own")
        i, j = (int(group.table.column(c)[0].as_py()) for c in ("i", "j"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        small, large = np.minimum(n[left, None], n[right]), np.maximum(n[left, None], n[right])
        open_ = small * self.den >= large * self.num
        open_ &= (node[left, None] < node[right]) if i == j else (node[left, None] != node[right])
        matches = np.zeros(open_.shape, np.uint8)
        for c in range(COORDINATES):
            matches += sig[left, c][:, None] == sig[right, c]
        open_ &= matches >= self.least
        l, r = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        left, right, open_ = left[l], right[r], open_[np.ix_(l, r)]
        if len(l):
            open_ &= _common([earlier[x] for x in left], [earlier[x] for x in right]) == 0
        return left, right, np.argwhere(open_)

    def linked_pairs(self, left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
        common = _common(left, right)[pairs[:, 0], pairs[:, 1]].astype(np.int64)
        union = np.array([len(x) for x in left])[pairs[:, 0]] + np.array([len(x) for x in right])[pairs[:, 1]] - common
        return pairs[self.den * common >= self.num * union]

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        spots = np.searchsorted(b, a)
        common = int((b[np.minimum(spots, len(b) - 1)] == a).sum())
        return self.den * common >= self.num * (len(a) + len(b) - common)


def _forest(node: np.ndarray, left: np.ndarray, right: np.ndarray, links) -> list[tuple[int, int]]:
    """Links between rows that join different trees; pairs of one tree are skipped unseen."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for l, r in zip(left.tolist(), right.tolist()):
        a, b = root(int(node[l])), root(int(node[r]))
        if a != b and links(l, r):
            parent[a] = b
            kept.append((int(node[l]), int(node[r])))
    return kept


def _links(docs: DataFrame, classes: DataFrame, k: int, similar: Similar) -> DataFrame:
    """Written edges (a, b) between representatives of classes(node, tag, n, sig) that are similar enough, or a chain of such."""
    spark = docs.sparkSession
    found = written(candidates(classes, similar.least), "candidates")

    def needed(batches):
        for group in _groups(batches):
            left, right, pairs = similar.open_pairs(group)
            rows = np.union1d(left[pairs[:, 0]], right[pairs[:, 1]])
            if len(rows):
                yield from group.table.take(rows).combine_chunks().to_batches()

    kinds = "token long, i int, j int, own int, node long, tag long, n long, sig array<int>, earlier array<long>"
    groups = blocked(found, similar.num, similar.den).repartition(*KEY).sortWithinPartitions(*KEY)
    open_rows = written(groups.mapInArrow(needed, kinds), "open")

    wanted = written(open_rows.select("node", "tag").distinct(), "wanted")
    table, words = bounded(wanted.select(F.struct("node", "tag").alias("key")), "key")
    rows = texts_of(docs).withColumnRenamed("doc_id", "node")
    texts = maybe_in(rows, F.struct(rows["node"], rows["tag"]), table, words).join(wanted, ["node", "tag"], "left_semi")
    texts = written(texts.dropDuplicates(["node", "tag"]), "texts")

    def links(batches):
        for group in _groups(batches):
            left, right, pairs = similar.open_pairs(group)
            if not len(pairs):
                continue
            node, used = group.numbers("node"), np.union1d(left[pairs[:, 0]], right[pairs[:, 1]])
            sets = dict(zip(used.tolist(), shingle_sets(group.table.column("text").take(used).combine_chunks(), k)))
            dense = not group.small and len(pairs) > 4 * (len(left) + len(right))
            if dense:
                pairs = similar.linked_pairs([sets.get(x, NONE) for x in left.tolist()], [sets.get(x, NONE) for x in right.tolist()], pairs)
            edges = _forest(node, left[pairs[:, 0]], right[pairs[:, 1]], lambda a, b: dense or similar.linked(sets[a], sets[b]))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], names=["a", "b"])
        returned()

    together = open_rows.join(texts, ["node", "tag"]).select(*KEY, "own", "node", "n", "sig", "earlier", "text")
    edges = together.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(links, "a long, b long")
    with settings(spark, **SMALL_BATCHES):
        return written(edges, "links")


def _grouped(docs: DataFrame, k: int, similarity: tuple[int, int]) -> DataFrame:
    """(doc_id, n_shingles, component) for every row of docs."""
    spark = docs.sparkSession
    num, den = similarity
    with scratch(spark) as keep:
        with settings(spark, **SMALL_BATCHES):
            signed = written(signatures(docs, k), "signatures")
        first = F.min(F.struct("doc_id", "tag", "n_shingles", "sig"))
        classes = signed.filter("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy("cls").agg(first.alias("first"))
        classes = written(classes.select("cls", F.col("first.doc_id").alias("node"), "first.tag", F.col("first.n_shingles").alias("n"), "first.sig"), "classes")
        edges = _links(docs, classes.drop("cls"), k, Similar(num, den, match_threshold(COORDINATES, num / den)))

        # rows that repeat an id are one node: the representatives of their classes are linked
        ids = signed.filter("doc_id IS NOT NULL").select("doc_id", "cls")
        digest = F.coalesce("cls", F.lit(b""))
        again = ids.groupBy("doc_id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).filter("a <> b").select("doc_id")
        again = written(ids.join(again, "doc_id", "left_semi").filter("cls IS NOT NULL").join(classes.select("cls", "node"), "cls").select("doc_id", "node").distinct(), "again")
        several = not again.isEmpty()
        if several:
            edges = edges.unionByName(again.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
        labels = components(edges)
        nodes = classes.select("cls", "node").join(labels, "node", "left").select("cls", F.coalesce("component", "node").alias("component"))
        nodes = written(nodes, "nodes")
        keep += [signed, nodes]
        if several:
            shared = written(again.join(labels, again["node"] == labels["node"], "left").groupBy("doc_id").agg(F.min(F.coalesce("component", again["node"])).alias("shared")), "shared")
            keep.append(shared)

    result = signed.select("doc_id", "n_shingles", "cls").join(nodes, "cls", "left")
    if several:  # rows without words, too, are their id's node
        result = result.join(shared, "doc_id", "left").withColumn("component", F.coalesce("shared", "component"))
    return result.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text)."""
    found = _grouped(docs, shingle_words, similarity)
    component = F.col("component")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, shingle_words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs without the documents that aren't their component's smallest id. Only rows that may go are shuffled; the
    columns of docs stay, whatever their names, and odd rows are as in near_duplicates()."""
    dropped = near_duplicates(docs, shingle_words, similarity).filter("NOT kept").select(F.col("doc_id").alias("key")).distinct()
    return without(docs, F.col("doc_id").cast("long"), written(dropped, "dropped"))
