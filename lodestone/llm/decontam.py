"""Benchmark decontamination: a prefix-filtered set join of document shingles with benchmark windows."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import alnum_words, fresh, small_batches

WINDOW = 10
SHINGLE = 3
#: Words of one slice of texts that are matched at a time; bounds the memory of a task besides its longest text.
SLICE_WORDS = 200_000
#: Benchmark words in one block, hence the bound on what is sent to the executors at once (about 100 bytes a word).
BLOCK_WORDS = 500_000


class _Windows:
    """The windows of one block of benchmark items, as arrays of word numbers, and their shingles."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.words: dict[bytes, int] = {}
        rows, owners = {}, []
        for item, words in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words]
            for k in range(max(1, len(ids) - WINDOW + 1)) if ids else ():
                at = rows.setdefault(tuple(ids[k : k + WINDOW]), len(rows))
                owners.append((at, item))
        self.base = len(self.words) + 2
        self.table = np.full((len(rows), WINDOW), -9, np.int64)
        for w, k in rows.items():
            self.table[k, : len(w)] = w
        self.length = (self.table >= 0).sum(axis=1)
        self.names = sorted({x for _, x in owners})
        number = {x: k for k, x in enumerate(self.names)}
        pairs = np.array(sorted({(a, number[x]) for a, x in owners}), np.int64).reshape(-1, 2)
        self.owner, self.owner_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))
        # one shingle size for all windows of at least that many words
        self.size = np.minimum(self.length, SHINGLE)
        self.shingles = {}
        for s in sorted(set(self.size.tolist())):
            got = [self.codes(self.table[k, : self.length[k]], s) for k in np.flatnonzero(self.size == s)]
            self.shingles[s] = np.unique(np.concatenate(got))
        self.prefix = None

    def codes(self, ids: np.ndarray, size: int) -> np.ndarray:
        """A number for each run of ``size`` words, 0 where one isn't a benchmark word."""
        n = len(ids) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out, known = ids[:n].copy(), ids[:n] > 0
        for k in range(1, size):
            out = out * self.base + ids[k : k + n]
            known &= ids[k : k + n] > 0
        return np.where(known, out, 0)

    def rank(self, counts: dict[tuple[int, int], int]) -> None:
        """Order each window's shingles by rarity in the corpus; keep the rarest, which every occurrence must hold."""
        entries = {s: [] for s in self.shingles}
        for k in range(len(self.table)):
            s = int(self.size[k])
            c = self.codes(self.table[k, : self.length[k]], s)
            offset = min(range(len(c)), key=lambda j: (counts.get((s, int(c[j])), 0), j))
            entries[s].append((int(c[offset]), k, offset))
        self.prefix = {s: np.array(sorted(e), np.int64).reshape(-1, 3) for s, e in entries.items() if e}


def _slices(texts):
    """Runs of texts of about SLICE_WORDS words: lists of their words."""
    part, n = [], 0
    for t in texts:
        part.append(alnum_words(t))
        n += len(part[-1])
        if n >= SLICE_WORDS:
            yield part
            part, n = [], 0
    if part:
        yield part


def _numbers(part: list[list[bytes]], words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of the texts one after the other, each followed by a -1 that no window crosses; where texts start."""
    get, flat, starts = words.get, [], [0]
    for t in part:
        flat += [get(w, 0) for w in t]
        flat.append(-1)
        starts.append(len(flat))
    return np.array(flat, np.int64), np.array(starts, np.int64)


def _matches(ids: np.ndarray, index: _Windows, size: int, prefix: np.ndarray):
    """(start, window) of the occurrences whose rarest shingle has ``size`` words."""
    codes = index.codes(ids, size)
    at = np.flatnonzero(codes)
    lo = np.searchsorted(prefix[:, 0], codes[at])
    found = lo < len(prefix)
    found[found] = prefix[lo[found], 0] == codes[at[found]]
    at, lo = at[found], lo[found]
    hi = np.searchsorted(prefix[:, 0], codes[at], side="right")
    for k in range(0, len(at), 50_000):  # many windows may start with one shingle
        a, n = at[k : k + 50_000], (hi - lo)[k : k + 50_000]
        which = np.repeat(lo[k : k + 50_000] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        window, start = prefix[which, 1], np.repeat(a, n) - prefix[which, 2]
        length = index.length[window]
        fits = (start >= 0) & (start + length <= len(ids))  # length and position
        window, start, length = window[fits], start[fits], length[fits]
        good = np.ones(len(start), bool)
        for j in range(WINDOW):
            more = np.flatnonzero(good & (length > j))
            good[more] = ids[start[more] + j] == index.table[window[more], j]
        yield start[good], window[good]


def _found(part: list[list[bytes]], index: _Windows):
    """For each text: the ranges of its words that occurrences cover, and the items."""
    ids, starts = _numbers(part, index.words)
    cover, items = np.zeros(len(ids) + 1, np.int64), [set() for _ in part]
    for size, prefix in index.prefix.items():
        for start, window in _matches(ids, index, size, prefix):
            np.add.at(cover, start, 1)
            np.add.at(cover, start + index.length[window], -1)
            doc = np.searchsorted(starts, start, side="right") - 1
            for d, w in set(zip(doc.tolist(), window.tolist())):
                items[d].update(index.owner[index.owner_at[w] : index.owner_at[w + 1]].tolist())
    inside = np.cumsum(cover)[:-1] > 0
    for d, words in enumerate(part):
        own = np.concatenate([[False], inside[starts[d] : starts[d] + len(words)], [False]])
        edges = np.flatnonzero(np.diff(own.astype(np.int8)))
        yield len(words), [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])], sorted(index.names[k] for k in items[d])


def _blocks(benchmark: DataFrame, item: str, text: str, most: int):
    """Items (as string, words) in blocks of about ``most`` words, streamed to the driver a partition at a time."""
    block, n = [], 0
    for row in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null").toLocalIterator():
        words = alnum_words(row.t)
        if words:
            block.append((row.i, words))
            n += len(words)
            if n >= most:
                yield block
                block, n = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Marks the words of each document that lie in an occurrence of a benchmark window.

    A window is ten consecutive words of an item, or the whole item if it has fewer. Each window's three-word shingles
    are ordered by how often they occur in all documents; documents are joined with the rarest one alone, then
    length, position and every word are checked. The benchmark is taken in blocks of ``block_words`` words, which
    bounds what is broadcast; every document meets every block.

    Returns all columns of ``docs`` and ``decontamination``: struct(n_words, spans: array of [start, end) in words,
    items: array of item ids as strings, sorted). Texts that are null or empty have no words; items without words or
    with a null id match nothing; repeated items count once; repeated document rows each get their own result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = fresh(docs, "decontamination")
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))])
    done = None
    result = docs
    for block in _blocks(benchmark, item, item_text, block_words):
        index = _Windows(block)
        # the rarity of this block's shingles in the whole corpus; as many sums as the block has shingles
        sent = spark.sparkContext.broadcast(index)

        def counted(batches):
            ix = sent.value
            for batch in batches:
                total = Counter()
                for part in _slices(x.as_py() for x in batch.column(0)):
                    ids, _ = _numbers(part, ix.words)
                    for s, known in ix.shingles.items():
                        c = ix.codes(ids, s)
                        c = c[c > 0]
                        k = np.minimum(np.searchsorted(known, c), len(known) - 1)
                        k = k[known[k] == c]
                        n = np.bincount(k, minlength=len(known)) if len(k) else np.zeros(len(known), np.int64)
                        total.update({(s, int(known[j])): int(n[j]) for j in np.flatnonzero(n)})
                if total:
                    yield pa.RecordBatch.from_pydict({"s": [k[0] for k in total], "c": [k[1] for k in total], "n": list(total.values())}, schema=pa.schema([("s", pa.int64()), ("c", pa.int64()), ("n", pa.int64())]))

        sums = docs.select(text).mapInArrow(counted, "s long, c long, n long").groupBy("s", "c").agg(F.sum("n").alias("n"))
        index.rank({(r.s, r.c): r.n for r in sums.toLocalIterator()})
        ready = spark.sparkContext.broadcast(index)
        schema = T.StructType([*result.schema.fields, *([] if done else [T.StructField(out, kind)])])
        position, names = docs.columns.index(text), result.columns

        def marked(batches, ready=ready, again=bool(done), position=position):
            ix = ready.value
            for batch in batches:
                got = [x for part in _slices(x.as_py() for x in batch.column(position)) for x in _found(part, ix)]
                if again:
                    old = batch.column(batch.num_columns - 1).to_pylist()
                    got = [(n, _joined([(s["start"], s["end"]) for s in o["spans"]], spans), sorted({*o["items"], *items})) for o, (n, spans, items) in zip(old, got)]
                column = pa.array([{"n_words": n, "spans": [{"start": a, "end": b} for a, b in spans], "items": items} for n, spans, items in got], ARROW)
                columns = batch.columns[:-1] if again else batch.columns
                yield pa.RecordBatch.from_arrays([*columns, column], [*batch.schema.names[: len(columns)], "decontamination"])

        result = result.mapInArrow(marked, schema)
        done = True
    if not done:
        words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("long")
        result = docs.withColumn(out, F.struct(words.alias("n_words"), F.array().cast(kind["spans"].dataType).alias("spans"), F.array().cast("array<string>").alias("items")))
    return result


ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _joined(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted([*a, *b]):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """The operator over all documents, with hits and items as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d = F.col("decontamination")
    n_hit = F.aggregate(d["spans"], F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id", d["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(d["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(d["items"], ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
