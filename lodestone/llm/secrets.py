"""Secret scans: an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import durable, fresh, small_batches

#: The base rules, in the order of their kinds. (kind, pattern, group whose length counts, least length)
BASE_RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further rules: header of a private key, personal and chat tokens, signed web tokens, credentials in an address.
MORE_RULES = (
    ("private_key", r"-----BEGIN (?:[A-Z]{2,12} )?PRIVATE KEY-----", 0, 1),
    ("forge_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("url_password", r"://[^\s:/@]+:([^\s:/@]{3,})@", 1, 3),
)
RULES = BASE_RULES + MORE_RULES
#: Changes whenever a rule changes, so that old blobs are scanned again.
RULE_VERSION = "3"
FINDINGS = "array<struct<kind:string,start:long,end:long>>"
_KINDS = [r[0] for r in RULES]
_COMPILED = [(k, re.compile(p, re.ASCII), g, n) for k, p, g, n in RULES]
_ARROW = pa.schema([("blob", pa.binary()), ("findings", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def findings(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by the order of the rules."""
    found = [
        (m.start(), k, m.end())
        for k, (_, pattern, group, least) in enumerate(_COMPILED)
        for m in pattern.finditer(text or "")
        if m.end(group) - m.start(group) >= least
    ]
    return [(_KINDS[k], a, b) for a, k, b in sorted(found)]


#: Blobs (32 bytes each, about 100 in memory) that may be broadcast, and that a task keeps as met.
BROADCAST_BLOBS = 500_000


def _scan(batches):
    """(blob, content) -> (blob, findings), each blob once while its task remembers it."""
    met: set[bytes] = set()
    for batch in batches:
        blobs, got = [], []
        for blob, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            if blob not in met:
                if len(met) >= BROADCAST_BLOBS:
                    met.clear()
                met.add(blob)
                blobs.append(blob)
                got.append([{"kind": k, "start": a, "end": b} for k, a, b in findings(content.as_py())])
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(got, _ARROW.field(1).type)], schema=_ARROW)


def _due(rows: DataFrame, blobs: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """The ``rows`` (blob, row, content) to scan: of each unseen blob one row, by joins in place where they are bounded.

    ``blobs``: (blob, n: its rows, row: the smallest of them) over all rows. Copies of a blob that no join in place can
    tell are left in; each task still scans a blob once.
    """
    if ledger is None:
        copied = blobs.where("n > 1").select("blob", F.col("row").alias("first"))
        if copied.limit(BROADCAST_BLOBS + 1).count() > BROADCAST_BLOBS:
            return rows
        return rows.join(F.broadcast(copied), "blob", "left").where("first is null or first = row")
    seen = blobs.join(ledger, "blob", "left_semi").select("blob")
    new = durable(blobs.join(ledger, "blob", "left_anti").select("blob", F.col("row").alias("first")), "new_blobs")
    if new.limit(BROADCAST_BLOBS + 1).count() > BROADCAST_BLOBS:
        seen = durable(seen, "seen_blobs")
        if seen.limit(BROADCAST_BLOBS + 1).count() <= BROADCAST_BLOBS:
            return rows.join(F.broadcast(seen), "blob", "left_anti")
        return rows.join(new, "blob").where("first = row")  # neither is bounded: these texts are shuffled
    return rows.join(F.broadcast(new), "blob").where("first = row")


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text", version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Finds secrets in every row, scanning each content once for each version of the rules.

    ``docs`` holds every historical version of every file as a row; its columns besides the text, such as a path and a
    commit, are carried along. A row's blob is the SHA-256 of its text (null counts as empty). Blobs that ``ledger``
    (blob, rule_version, findings) holds for ``version`` aren't scanned; the others are and join the ledger. Findings
    are then joined back to all rows with that blob, whatever their path or version of history.

    Texts stay where they are: blobs are counted by digest, and the one row that is scanned of each (the smallest by a
    hash of its other columns; of rows equal in all columns, each task's first) is told by a broadcast of bounded size.
    Only where both the seen and the unseen blobs outgrow that are the unseen texts shuffled.

    Returns (rows, ledger): all columns of ``docs`` but the text, with ``blob`` (64 hexadecimal digits) and ``findings``
    (never null), and the ledger with the new blobs. Repeated rows each get their findings; empty tables give empty
    results.
    """
    blob, out = fresh(docs, "blob"), fresh(docs, "findings")
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(content, 256)
    others = [F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != text]))] if len(docs.columns) > 1 else []
    rows = docs.select(F.unhex(digest).alias("blob"), F.xxhash64(F.lit(0), *others).alias("row"), content.alias("content"))
    small_batches(docs.sparkSession)
    blobs = durable(rows.groupBy("blob").agg(F.count("*").alias("n"), F.min("row").alias("row")), "blobs")
    known = None if ledger is None else ledger.where(F.col("rule_version") == version).select(F.unhex("blob").alias("blob")).distinct()
    due = _due(rows, blobs, known).select("blob", "content")
    found = due.mapInArrow(_scan, f"blob binary, findings {FINDINGS}").dropDuplicates(["blob"])
    new = durable(found.select(F.lower(F.hex("blob")).alias("blob"), F.lit(version).alias("rule_version"), "findings"), "ledger")
    whole = new if ledger is None else ledger.select("blob", "rule_version", "findings").unionByName(new)
    hits = whole.where((F.col("rule_version") == version) & (F.size("findings") > 0)).select(F.col("blob").alias(blob), F.col("findings").alias(out)).dropDuplicates([blob])
    rows = docs.withColumn(blob, digest).drop(text).join(hits, blob, "left")
    return rows.select(*[c for c in docs.columns if c != text], blob, F.coalesce(out, F.array().cast(FINDINGS)).alias(out)), whole


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """The operator over all documents with an empty ledger, spans as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows, _ = scan_secrets(docs)
    base = F.filter("findings", lambda x: x["kind"].isin("assign", "access", "hex"))
    text = lambda found: F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"))
