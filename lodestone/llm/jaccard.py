"""N-gram Jaccard join: R-trees of count vectors, searched inside cells that no linked pair can miss."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import components, durable, fresh, small, small_batches, space_words

#: What ``op5_jaccard`` is fixed to: words of a shingle, and two sets link when 100 * intersection >= LINK * union.
SHINGLE, LINK = 3, 90
#: Below this threshold, neighbouring bands of sizes don't hold all linked sets any more.
LEAST_LINK = 75
#: Coordinates of a count vector (shingles are hashed into so many groups) of a set below WIDE; twice as many from there
#: on for each doubling of the set, so that the counts of unlike sets keep apart. A coordinate is a byte.
GROUPS, WIDE = 256, 2048
#: Sizes of one band differ by less than this factor; sets of one band are cut into equally many slices.
BAND = 1.5
#: Ways to cut a set into slices, of which the next is taken where too many slices are empty.
CUTS = 16
#: Points in a leaf of the R-tree.
LEAF = 32
#: Points, and searches, that one tree holds of a cell at a time.
TILE = 512
#: Pairs that a task remembers to have given.
REMEMBERED = 200_000
#: Partners of one text that are verified in one run.
RUN = 128
#: So many ids (16 bytes each) may be broadcast; with more, rows are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingles(text: str | None, size: int = SHINGLE) -> set[bytes]:
    """Distinct shingles of ``size`` words joined by a space; a shorter text is one shingle, one without words none."""
    w = space_words(text)
    if len(w) < size:
        return {b" ".join(w)} if w else set()
    return {b" ".join(x) for x in zip(*(w[k:] for k in range(size)))}


def most_apart(least: int, link: int = LINK) -> int:
    """Shingles in which two linked sets may differ at most, if the smaller one has ``least``.

    With 100 I >= link U and I <= least, U - I <= I (100 - link) / link.
    """
    return least * (100 - link) // link


def _edges_of_bands(most: int = 1 << 40) -> list[int]:
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * BAND)))
    return out


_BANDS = _edges_of_bands()


def cells_of(hashes: np.ndarray, link: int = LINK) -> list[tuple[int, np.ndarray]]:
    """(quota, numbers of cells) for each way in which a set with these shingle hashes meets its linked sets.

    The hash space is cut into S slices; a cell is (band, cut, slice, everything the set has there), and empty slices
    have none: they would be shared by unlike sets. Linked sets of a band differ in D shingles at most, so at most D cells
    of either are not the other's. Hence, if they share any, the first D + 1 of both (the quota) share one, in whatever
    order all sets agree on. They do share one if either has more than D cells, since S - D slices agree and those that
    are empty are empty in both. A set with fewer takes the next cut besides, as then do all sets it isn't sure to meet;
    the last cut keeps empty slices.

    A set near the low end of its band may link with one of the band below and is given that band's cells too. Where
    D is 0, linked sets are equal and need no cell.
    """
    n, out = len(hashes), []
    band = int(np.searchsorted(_BANDS, n, side="right")) - 1
    for k in (band - 1, band):
        if k < 0 or k < band and n * link > 100 * (_BANDS[band] - 1):
            continue
        apart = most_apart(_BANDS[k + 1] - 1, link)
        if not apart:
            continue
        slices = apart + 1 + max(1, apart // 2)
        for cut in range(CUTS):
            mixed = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (cut + 1) % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
            at = ((mixed >> np.uint64(33)) % np.uint64(slices)).astype(np.int64)
            sizes = np.bincount(at, minlength=slices)
            order = np.argsort(at, kind="stable")
            sums = np.cumsum(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53))[order])
            sums = np.concatenate([np.zeros(1, np.uint64), sums])[np.concatenate([[0], np.cumsum(sizes)])]
            content = sums[1:] - sums[:-1]
            place = np.arange(slices, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(((k + 1) * 0x165667B19E3779F9 + cut) % 2**64)
            code = (content ^ place) + sizes.astype(np.uint64)
            code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            code = (code ^ (code >> np.uint64(32))).view(np.int64)
            full = sizes > 0
            out.append((apart + 1, code if cut == CUTS - 1 else code[full]))
            if int(full.sum()) > apart:
                break
    return out


def count_vector(hashes: np.ndarray) -> np.ndarray:
    """Shingles by group; the number of groups is a power of two, so that a longer vector folds to a shorter one."""
    groups = GROUPS << max(0, len(hashes).bit_length() - WIDE.bit_length() + 1)
    while True:
        counts = np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if counts.max() < 256:
            return counts.astype(np.uint8)
        groups *= 2


def _lists(offsets: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _point(batches, shingle: int, link: int):
    """(key, text) -> (key, n, digest, counts, cells)."""
    for batch in batches:
        n, digests, counts, quotas, codes = [], [], [], [], []
        ways, ends = [0], [0]
        for text in batch.column(1):
            found = shingles(text.as_py(), shingle)
            n.append(len(found))
            if found:
                h = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))
                for quota, cells in cells_of(h, link):
                    quotas.append(quota)
                    codes.append(cells)
                    ends.append(ends[-1] + len(cells))
            # equal digests are equal sets: 128 bits over the sorted hashes of all shingles
            digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if found else None)
            counts.append(count_vector(h).tobytes() if found else None)
            ways.append(len(quotas))
        cells = _lists(ends, pa.array(np.concatenate(codes) if codes else np.zeros(0, np.int64)))
        cells = _lists(ways, pa.StructArray.from_arrays([pa.array(quotas, pa.int32()), cells], ["quota", "codes"]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(counts, pa.binary()), cells], ["key", "n", "digest", "counts", "cells"])


def _vectors(column: list[bytes]) -> np.ndarray:
    """Count vectors as rows, folded to the shortest of them."""
    groups = min(map(len, column))
    if max(map(len, column)) > groups:
        return np.stack([np.frombuffer(c, np.uint8).reshape(-1, groups).sum(axis=0, dtype=np.uint16) for c in column])
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, groups)


def _sum(points: np.ndarray) -> np.ndarray:
    return points.sum(axis=1, dtype=np.int64)


def _may_link(overlap: np.ndarray, total: np.ndarray, link: int) -> np.ndarray:
    """Whether an overlap of at most ``overlap`` can reach the threshold for sizes that add up to ``total``."""
    return 100 * overlap >= link * (total - overlap)


class RTree:
    """A packed R-tree over count vectors: points sorted by size and heaviest coordinates, leaves of LEAF, and their boxes."""

    def __init__(self, points: np.ndarray, link: int = LINK):
        self.link = link
        self.order = np.arange(len(points))
        if len(points) > LEAF:
            spread = np.argsort(-points.var(axis=0), kind="stable")[:3]
            self.order = np.lexsort((*[points[:, k] for k in spread], _sum(points)))
        self.points = points[self.order]
        self.sizes = _sum(self.points)
        self.levels = []
        low = high = self.points
        while len(low) > LEAF:
            cut = np.arange(0, len(low), LEAF)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((high, _sum(low)))

    def search(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the points whose summed coordinate minima with ``point`` can reach the threshold, and these sums."""
        size = int(point.sum())
        at = np.arange(len(self.levels[-1][0]) if self.levels else len(self.points))
        for level in range(len(self.levels) - 1, -1, -1):
            high, low = self.levels[level]
            at = at[_may_link(_sum(np.minimum(high[at], point)), size + low[at], self.link)]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < (len(self.levels[level - 1][0]) if level else len(self.points))]
        overlap = _sum(np.minimum(self.points[at], point))
        keep = _may_link(overlap, size + self.sizes[at], self.link)
        return self.order[at[keep]], overlap[keep]


def _runs(batches, keys: int):
    """The rows of sorted batches as one table for each run of equal values in the first ``keys`` columns."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for x in columns:
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(x[a] for x in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _pairs(hubs: list[int], ids: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(ids, pa.int64())], ["hub", "id"])


#: What a row of a tile is for: it searches, it is found, or both.
ASKS, FOUND, BOTH = 0, 1, 2


def _nearest(batches, link: int):
    """(cell, tile, id, role, counts), sorted by tile -> (hub, id): for each searching point the nearest point that the
    tree can't rule out (the largest similarity that the bound allows) and the one with the smallest id."""
    hubs, askers = [], []
    for run in _runs(batches, 2):
        ids, role = (run.column(c).to_numpy() for c in ("id", "role"))
        points = _vectors(run.column("counts").to_pylist())
        there = np.flatnonzero(role != ASKS)
        tree, sizes = RTree(points[there], link), _sum(points)
        for k in np.flatnonzero(role != FOUND):
            near, overlap = tree.search(points[k])
            near = there[near]
            other = ids[near] != ids[k]
            if other.any():
                near, overlap = near[other], overlap[other]
                likeness = overlap / (sizes[near] + sizes[k] - overlap)
                chosen = {int(ids[near].min()), int(ids[near][likeness == likeness.max()].min())}
                hubs += chosen
                askers += [int(ids[k])] * len(chosen)
        if len(hubs) > 50_000:
            yield _pairs(hubs, askers)
            hubs, askers = [], []
    yield _pairs(hubs, askers)


def _others(batches, link: int):
    """(cell, points, searches, id, component, large, role, counts), sorted -> (hub, id): pairs of different components
    that the tree can't rule out, each once while the task remembers it. ``large`` points, of the cell's largest component,
    are found but don't search."""
    met: set[tuple[int, int]] = set()
    for run in _runs(batches, 3):
        ids, comp, large, role = (run.column(c).to_numpy(zero_copy_only=False) for c in ("id", "component", "large", "role"))
        points = _vectors(run.column("counts").to_pylist())
        own, there = np.flatnonzero(role == ASKS), np.flatnonzero(role == FOUND)
        if not len(own) or not len(there):
            continue
        tree = RTree(points[there], link)
        for k in own:
            near = there[tree.search(points[k])[0]]
            near = near[(comp[near] != comp[k]) & (large[near] | (ids[near] > ids[k]))]
            new = {(min(int(ids[k]), j), max(int(ids[k]), j)) for j in ids[near].tolist()} - met
            if new:
                met = met | new if len(met) < REMEMBERED else new
                yield _pairs([a for a, _ in new], [b for _, b in new])


def _tiles(number: str) -> F.Column:
    return F.ceil(F.col(number) / TILE).cast("int")


def _dealt(value, tiles):
    return F.pmod(F.xxhash64(value), tiles).cast("int")


def _every(tiles):
    return F.explode(F.sequence(F.lit(0), tiles - 1))


def first_search(members: DataFrame, link: int) -> DataFrame:
    """(hub, id), each pair once: what a search of each cell's R-tree by each of its points finds first.

    ``members``: (cell, m: points of the cell, id, counts). The tree of a cell with at most TILE points holds them all. Of
    a larger cell it holds about TILE, chosen by a hash, and is given to as many tasks as the searches are dealt to.
    """
    tiles = _tiles("m")
    one = members.where(F.col("m") <= TILE).select("cell", F.lit(0).alias("tile"), "id", F.lit(BOTH).alias("role"), "counts")
    hot = members.where(F.col("m") > TILE)
    found = hot.where(_dealt(F.struct("cell", "id"), tiles) == 0).select("cell", _every(tiles).alias("tile"), "id", F.lit(FOUND).alias("role"), "counts")
    asks = hot.select("cell", _dealt("id", tiles).alias("tile"), "id", F.lit(ASKS).alias("role"), "counts")
    rows = one.union(found).union(asks).repartition("cell", "tile").sortWithinPartitions("cell", "tile")
    pairs = rows.mapInArrow(lambda batches: _nearest(batches, link), "hub long, id long")
    return pairs.groupBy(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).agg(F.min("hub").alias("hub")).select("hub", (F.col("a") + F.col("b") - F.col("hub")).alias("id"))


def further_search(members: DataFrame, found: DataFrame, link: int) -> DataFrame:
    """(hub, id), each pair once: all that the R-trees can't rule out between the components that cells still hold.

    ``found``: (node, component) so far. The points outside a cell's largest component search it. A cell's points are
    dealt into tiles of about TILE by a hash of their ids, and so are its searches; each tile of searches meets each tile
    of points, so that no tree grows with a hot cell. Cells of two points have been searched whole before.
    """
    rows = members.where("m > 2").join(found, members["id"] == found["node"], "left").select("cell", "id", "counts", F.coalesce("component", "id").alias("component"))
    sizes = rows.groupBy("cell", "component").agg(F.count("*").alias("n")).groupBy("cell").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts"))
    mixed = sizes.where("parts > 1").select("cell", F.col("top.component").alias("largest"), _tiles("n").alias("np"), F.ceil((F.col("n") - F.col("top.n")) / TILE).cast("int").alias("ns"))
    rows = rows.join(small(durable(mixed, "mixed"), BROADCAST_IDS), "cell").withColumn("large", F.col("component") == F.col("largest"))
    rest = ("id", "component", "large")
    point = rows.select("cell", _dealt("id", F.col("np")).alias("points"), _every(F.col("ns")).alias("searches"), *rest, F.lit(FOUND).alias("role"), "counts")
    search = rows.where("not large").select("cell", _every(F.col("np")).alias("points"), _dealt("id", F.col("ns")).alias("searches"), *rest, F.lit(ASKS).alias("role"), "counts")
    tiles = ("cell", "points", "searches")
    return point.union(search).repartition(*tiles).sortWithinPartitions(*tiles).mapInArrow(lambda batches: _others(batches, link), "hub long, id long").distinct()


def _verified(batches, shingle: int, link: int):
    """(hub, run, other, id, text), sorted, the hub's own row (other = 0) first in each run -> the pairs that link."""
    now, hub = None, set()
    for batch in batches:
        a, b = [], []
        for h, r, other, i, t in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
            if not other:
                now, hub = (h, r), shingles(t.as_py(), shingle)
            elif now == (h, r):
                own = shingles(t.as_py(), shingle)
                both = len(hub & own)
                if 100 * both >= link * (len(hub) + len(own) - both):
                    a.append(h)
                    b.append(i)
        yield _pairs(a, b)


def verify(pairs: DataFrame, texts: DataFrame, shingle: int, link: int) -> DataFrame:
    """Pairs (hub, id) whose texts link, word by word. ``texts``: (id, text), one row each.

    A hub's text is brought once for each run of about RUN partners, and a task holds one hub's shingles at a time.
    """
    ids = durable(pairs.select(F.explode(F.array("hub", "id")).alias("id")).distinct(), "ids")
    texts = texts.join(small(ids, BROADCAST_IDS), "id", "left_semi")
    hot = durable(pairs.groupBy("hub").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs")).where("runs > 1"), "hubs")
    dealt = pairs.join(small(hot, BROADCAST_IDS), "hub", "left").select("hub", F.coalesce(_dealt("id", F.col("runs")), F.lit(0)).alias("run"), "id")
    hubs = dealt.select("hub", "run").distinct().select("hub", "run", F.lit(0).alias("other"), F.col("hub").alias("id"))
    rows = hubs.union(dealt.select("hub", "run", F.lit(1).alias("other"), "id")).join(texts, "id").select("hub", "run", "other", "id", "text")
    rows = rows.repartition("hub", "run").sortWithinPartitions("hub", "run", "other")
    return durable(rows.mapInArrow(lambda batches: _verified(batches, shingle, link), "hub long, id long"), "links")


def shared_cells(nodes: DataFrame) -> DataFrame:
    """(cell, m, id): for each set its rarest cells, as many as its quota, where another set chose the same.

    ``nodes``: (id, cells). Cells are counted over all sets, and the order in which a quota is filled is by that count:
    a cell that unlike sets share too, as by a frequent passage, comes last. Cells of one set alone fill quotas first
    and are dropped; so a set with more such cells than it may differ in links with none. All cells are shuffled once:
    each is counted where its rows meet, and no table of counts is joined to them. Of cells with the same points one is
    left; they are compared by number, smallest, largest and 128 bits of hash of their points.
    """
    ways = nodes.select("id", F.posexplode("cells").alias("way", "c"))
    # the cells that a way has beyond its quota go beside its number: each row of the one large shuffle is three numbers
    spare = F.greatest(F.size("c.codes") - F.col("c.quota"), F.lit(0))
    ways = ways.select("id", F.shiftleft(F.col("way").cast("long"), 32).bitwiseOR(spare.cast("long")).alias("way"), F.explode("c.codes").alias("cell"))
    inside = ways.withColumn("often", F.count("*").over(Window.partitionBy("cell"))).where("often > 1")
    own = Window.partitionBy("id", "way")
    left = F.count("*").over(own) - F.row_number().over(own.orderBy("often", "cell"))
    ranked = inside.select("id", "cell", (left >= F.col("way").bitwiseAND(F.lit(2**32 - 1))).alias("fits"))
    kept = durable(ranked.where("fits").select("id", "cell"), "kept")
    h = F.xxhash64("id")
    cells = kept.groupBy("cell").agg(F.count("*").alias("m"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("y")).where("m > 1")
    cells = durable(cells.groupBy("m", "lo", "hi", "x", "y").agg(F.min("cell").alias("cell")).select("cell", "m"), "shared")
    return kept.join(small(cells, BROADCAST_IDS), "cell").select("cell", "m", "id")


def link_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, link: int = LINK) -> DataFrame:
    """Links documents whose sets of ``shingle``-word shingles have a Jaccard similarity of at least ``link`` %, exactly.

    1. Each text becomes a point (counts of its shingles by hashed group) and a list of cells of which linked sets share
       one. Equal sets are one node, named by the smallest key among them.
    2. ``first_search``: the R-tree of each cell is searched by each of its points; boxes and points whose summed
       coordinate minima can't reach the threshold are left out. The nearest point and the one with the smallest key
       are verified on whole shingle sets, and the links joined into components.
    3. ``further_search``: in cells that still hold several components, every pair of different ones that the trees can't
       rule out is verified too. A hot group of near copies is one component by then and isn't expanded into its pairs.

    Returns (key, n_shingles, component, joining_links): a row per row of ``docs``; ``component`` is the smallest key
    reachable, ``joining_links`` the verified links of the row's set, and its copies, that were looked up to join
    components: not every link inside one. Null and empty texts have no shingles and are their own component. Rows
    with equal keys are one document, whose text is the smallest of theirs; rows with a null key have a null component.
    ``key`` is a column of whole numbers, ``link`` is 75 to 100.
    """
    if shingle < 1 or not LEAST_LINK <= link <= 100:
        raise ValueError(f"shingle must be 1 or more and link {LEAST_LINK} to 100")
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise ValueError(f"{key} must be a column of whole numbers: components are named by the smallest")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    keyed, source = rows.where("key is not null"), rows
    repeated = bool(keyed.groupBy("key").count().where("count > 1").limit(1).count())
    if repeated:
        source = keyed.groupBy("key").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).union(rows.where("key is null"))
    point = "key long, n long, digest binary, counts binary, cells array<struct<quota:int,codes:array<long>>>"
    points = durable(source.mapInArrow(lambda batches: _point(batches, shingle, link), point), "points")
    sets = points.where("n > 0 and key is not null")
    classes = durable(sets.groupBy("digest").agg(F.min("key").alias("id"), F.count("*").alias("copies")), "classes")
    # one row for each set: the others with its digest are dropped before their cells are unfolded
    copied = small(durable(classes.where("copies > 1").select("digest", F.col("id").alias("first")), "copied"), BROADCAST_IDS)
    nodes = sets.join(copied, "digest", "left").where("first is null or first = key").select(F.col("key").alias("id"), "counts", "cells")
    members = durable(shared_cells(nodes.select("id", "cells")).join(nodes.select("id", "counts"), "id"), "members")
    texts = source.where("key is not null").select(F.col("key").alias("id"), "text")
    pairs = durable(first_search(members, link), "pairs")
    links = verify(pairs, texts, shingle, link)
    found = components(links.toDF("a", "b"))
    more = further_search(members, found, link)
    tried = pairs.select(F.least("hub", "id").alias("hub"), F.greatest("hub", "id").alias("id"))
    more = durable(more.join(tried, ["hub", "id"], "left_anti"), "more")
    if more.limit(1).count():
        further = verify(more, texts, shingle, link)
        if further.limit(1).count():
            links = links.union(further)
            found = components(links.toDF("a", "b"))
    degree = links.select(F.explode(F.array("hub", "id")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    of_class = classes.join(found, classes["id"] == found["node"], "left").drop("node").join(degree, classes["id"] == degree["node"], "left")
    of_class = of_class.select("digest", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = points.select("key", "n", "digest").join(of_class, "digest", "left")
    out = out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("component", "key")).alias("component"), F.coalesce("links", F.lit(0)).cast("long").alias("joining_links"))
    return keyed.select(F.col("key").alias(key)).join(out, key).unionByName(out.where(F.col(key).isNull())) if repeated else out


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, link: int = LINK) -> DataFrame:
    """The rows of ``docs`` without those that are linked to one with a smaller key; repeated rows of a key stay one.

    Rows with a null key stay.
    """
    gone = fresh(docs, "gone")
    found = link_documents(docs, text, key, shingle, link)
    linked = durable(found.where(F.col(key) != F.col("component")).select(F.col(key).alias(gone)).distinct(), "gone")
    return docs.join(small(linked, BROADCAST_IDS), F.col(key) == F.col(gone), "left_anti")


def op5_jaccard(spark, sf_dir: str) -> DataFrame:
    """The operator over all documents."""
    found = link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"))
