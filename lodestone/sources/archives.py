"""Result archives (ZIP with a JSON manifest) as tables, and tables as archives.

Archives are read with Spark's ``binaryFile`` source, so any file system that Spark reads will do. Every table is one
narrow pass over the archives: directories, manifests and members never meet in one task. What is wrong with an
archive becomes rows, never an exception.
"""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = "manifest.json"
#: Element types of binary members, as NumPy names them (little-endian, C order).
DTYPES = {"int8": "<i1", "int16": "<i2", "int32": "<i4", "int64": "<i8", "uint8": "<u1", "uint16": "<u2", "uint32": "<u4", "uint64": "<u8", "float32": "<f4", "float64": "<f8"}
#: Caps that readers keep to unless told otherwise: bytes of JSON members, and how deeply they nest.
MOST_JSON_BYTES, MOST_JSON_DEPTH = 256 << 20, 64

ENTRIES = "archive string, ordinal int, name string, usize long, csize long, method int, crc long"
MANIFESTS = "archive string, manifest string, code string, message string"
MEMBERS = (
    "archive string, section int, section_id string, kind string, role_ordinal int, role string, path string, format string, dtype string, "
    "shape string, declared_size long, declared_sha256 string, well_formed boolean, found boolean, entry_size long, size long, sha256 string, "
    "content binary, text string, json string, code string, message string"
)


def read_archives(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(archive, content) of every file below ``path`` whose name fits the glob ``pattern``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("archive"), "content")


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _table(archives: DataFrame, ddl: str, rows_of) -> DataFrame:
    """A table of what ``rows_of(archive, content)`` yields for each archive."""
    schema = _arrow(archives.sparkSession, ddl)

    def work(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = [dict(zip(schema.names, r)) for r in rows_of(name.as_py(), content.as_py())]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.select("archive", "content").mapInArrow(work, ddl)


def _opened(content: bytes | None) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(io.BytesIO(content or b""))
    except Exception:  # noqa: BLE001  whatever a broken directory raises
        return None


def depth_of(text: str) -> int:
    """How deeply brackets nest outside strings."""
    depth = most = 0
    quoted = escaped = False
    for c in text:
        if quoted:
            quoted, escaped = (True, False) if escaped else (c != '"', c == "\\")
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
            most = max(most, depth)
        elif c in "]}":
            depth -= 1
    return most


def parsed(text: str) -> str:
    """The JSON text in one form: the last of equal keys wins, numbers that aren't finite become strings."""
    return json.dumps(json.loads(text, parse_constant=lambda c: c), ensure_ascii=False)


def _entries(name: str, content: bytes):
    z = _opened(content)
    for k, e in enumerate(z.infolist() if z else []):
        yield name, k, e.filename, e.file_size, e.compress_size, e.compress_type, e.CRC


def entries(archives: DataFrame) -> DataFrame:
    """The container directory, one row per entry in order; unreadable archives have none."""
    return _table(archives, ENTRIES, _entries)


def _manifest(name: str, content: bytes, most_bytes: int = MOST_JSON_BYTES, most_depth: int = MOST_JSON_DEPTH):
    z = _opened(content)
    if z is None:
        return name, None, "E_ZIP_UNREADABLE", "the container directory can't be read"
    if MANIFEST not in z.namelist():
        return name, None, "E_MANIFEST_MISSING", "there is no manifest.json"
    entry = z.getinfo(MANIFEST)  # the last of several
    if entry.file_size > most_bytes:
        return name, None, "E_JSON_TOO_LARGE", f"the manifest has {entry.file_size} bytes"
    try:
        text = z.read(entry).decode("utf-8")
    except UnicodeDecodeError:
        return name, None, "E_MANIFEST_JSON", "the manifest isn't UTF-8"
    except Exception as e:  # noqa: BLE001
        return name, None, "E_ZIP_UNREADABLE", f"the manifest can't be read: {e}"
    if depth_of(text) > most_depth:
        return name, None, "E_JSON_TOO_DEEP", f"the manifest nests deeper than {most_depth}"
    try:
        whole = parsed(text)
    except ValueError as e:
        return name, None, "E_MANIFEST_JSON", f"the manifest isn't JSON: {e}"
    if not whole.startswith("{"):
        return name, None, "E_MANIFEST_JSON", "the manifest isn't an object"
    return name, whole, None, None


def manifests(archives: DataFrame, most_bytes: int = MOST_JSON_BYTES, most_depth: int = MOST_JSON_DEPTH) -> DataFrame:
    """(archive, manifest, code, message): the current manifest as JSON text, or what is wrong with it."""
    return _table(archives, MANIFESTS, lambda name, content: [_manifest(name, content, most_bytes, most_depth)])


def sections(manifest_rows: DataFrame) -> DataFrame:
    """(archive, section, value): the sections of each manifest in order, as VARIANT."""
    spark = manifest_rows.sparkSession
    return spark.sql(
        "select m.archive, cast(t.pos as int) as section, t.value as value from {m} m, "
        "lateral variant_explode(variant_get(parse_json(m.manifest), '$.sections')) t where m.manifest is not null and t.pos is not null",
        m=manifest_rows,
    )


def _members(name: str, content: bytes, wanted: tuple[str, ...] | None, payloads: bool, most_bytes: int, most_depth: int):
    _, text, _, _ = _manifest(name, content, most_bytes, most_depth)
    z = _opened(content)
    listed = json.loads(text).get("sections") if text else None
    for k, s in enumerate(listed if isinstance(listed, list) else []):
        own = s.get("members") if isinstance(s, dict) else None
        if not isinstance(own, dict):
            continue
        sid, kind = (s.get(x) if isinstance(s.get(x), str) else None for x in ("id", "kind"))
        if wanted and kind not in wanted:
            continue
        for j, (role, m) in enumerate(own.items()):
            formed = isinstance(m, dict) and isinstance(m.get("path"), str)
            m = m if isinstance(m, dict) else {}
            string = lambda key: m.get(key) if isinstance(m.get(key), str) else None  # noqa: E731,B023
            number = m.get("size") if isinstance(m.get("size"), int) and not isinstance(m.get("size"), bool) else None
            shape = json.dumps(m["shape"]) if "shape" in m else None
            row = [name, k, sid, kind, j, role, string("path"), string("format"), json.dumps(m["dtype"]) if "dtype" in m else None, shape, number, string("sha256"), formed]
            found = formed and m["path"] in z.namelist()
            entry = z.getinfo(m["path"]) if found else None
            rest = [found, entry.file_size if found else None, None, None, None, None, None, None, None]
            if found and payloads:
                if m.get("format") == "json" and entry.file_size > most_bytes:
                    rest[7:] = "E_JSON_TOO_LARGE", f"{entry.file_size} bytes"
                else:
                    try:
                        raw = z.read(entry)
                    except Exception as e:  # noqa: BLE001
                        rest[7:] = "E_ZIP_UNREADABLE", str(e)
                    else:
                        rest[2:4] = len(raw), hashlib.sha256(raw).hexdigest()
                        rest[4] = raw
                        try:
                            rest[5] = raw.decode("utf-8") if m.get("format") != "binary" else None
                        except UnicodeDecodeError:
                            pass
                        if m.get("format") == "json":
                            if rest[5] is not None and depth_of(rest[5]) > most_depth:
                                rest[7:] = "E_JSON_TOO_DEEP", f"nests deeper than {most_depth}"
                            else:
                                try:
                                    rest[6] = parsed(raw.decode("utf-8"))
                                except ValueError as e:
                                    rest[7:] = "E_JSON_INVALID", str(e)
            yield (*row, *rest)


def members(archives: DataFrame, kinds: list[str] | None = None, payloads: bool = True, most_bytes: int = MOST_JSON_BYTES, most_depth: int = MOST_JSON_DEPTH) -> DataFrame:
    """The members that the current manifests declare, with what reading each found; each is read once.

    ``kinds`` reads those sections' members only; without ``payloads`` nothing is decompressed.
    """
    wanted = tuple(kinds) if kinds else None
    return _table(archives, MEMBERS, lambda name, content: _members(name, content, wanted, payloads, most_bytes, most_depth))


def tensors(member_rows: DataFrame) -> DataFrame:
    """(archive, section_id, kind, role, flat, idx, value): binary members in long form; those that don't fit their shape have no rows."""
    ddl = "archive string, section_id string, kind string, role string, flat long, idx array<int>, value double"

    def work(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dtype = DTYPES.get((r["dtype"] or "").strip('"'))
                shape = json.loads(r["shape"] or "[]")
                if dtype is None or not isinstance(shape, list) or not all(isinstance(n, int) and n >= 0 for n in shape):
                    continue
                if len(r["content"]) != np.dtype(dtype).itemsize * int(np.prod(shape, dtype=np.int64)):
                    continue
                values = np.frombuffer(r["content"], dtype).astype(float)
                index = np.stack(np.unravel_index(np.arange(len(values)), shape), axis=1).astype(np.int32) if shape else np.zeros((1, 0), np.int32)
                for k in range(0, len(values), 100_000):
                    n = len(values[k : k + 100_000])
                    same = [pa.array([r[c]] * n) for c in ("archive", "section_id", "kind", "role")]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(range(k, k + n), pa.int64()), pa.array(index[k : k + n].tolist(), pa.list_(pa.int32())), pa.array(values[k : k + n])], ["archive", "section_id", "kind", "role", "flat", "idx", "value"])

    rows = member_rows.where("format = 'binary' and dtype is not null and content is not null")
    return rows.select("archive", "section_id", "kind", "role", "dtype", "shape", "content").mapInArrow(work, ddl)


def diagonals(member_rows: DataFrame) -> DataFrame:
    """(archive, section, dtype, n, ao, value): the diagonals of square binary members; others have no rows."""

    def work(batches):
        for batch in batches:
            for r in batch.to_pylist():
                name, shape = (r["dtype"] or "").strip('"'), json.loads(r["shape"] or "[]")
                size = len(shape) == 2 and shape[0] == shape[1] and isinstance(shape[0], int) and shape[0]
                if not size or name not in DTYPES or len(r["content"]) != np.dtype(DTYPES[name]).itemsize * size * size:
                    continue
                values = np.frombuffer(r["content"], DTYPES[name])[:: size + 1].astype(float)
                same = [pa.array([r[c]] * size, t) for c, t in (("archive", pa.string()), ("section", pa.int32()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array([name] * size), pa.array([size] * size, pa.int64()), pa.array(range(size), pa.int64()), pa.array(values)], ["archive", "section", "dtype", "n", "ao", "value"])

    rows = member_rows.where("format = 'binary' and dtype is not null and content is not null")
    return rows.select("archive", "section", "dtype", "shape", "content").mapInArrow(work, "archive string, section int, dtype string, n long, ao long, value double")


def _contents(name: str, content: bytes):
    z = _opened(content)
    for entry in dict.fromkeys(z.namelist()) if z else ():
        if not entry.endswith("/"):
            try:
                yield name, entry, z.read(entry)  # the last of several
            except Exception:  # noqa: BLE001,S112  a broken entry is a finding, not a part of the new archive
                continue


def contents(archives: DataFrame) -> DataFrame:
    """(archive, name, content): the last of the entries of each name."""
    return _table(archives, "archive string, name string, content binary", _contents)


def repack(archives: DataFrame, folder: str, stored: bool = False) -> DataFrame:
    """Writes each archive anew with its current manifest and the members that declares, nothing else.

    Archives without a readable manifest aren't written. Returns what ``write_archives`` does; names are the file names.
    """
    used = members(archives, payloads=False).where("found").select("archive", F.col("path").alias("name")).distinct()
    sound = manifests(archives).where("manifest is not null").select("archive", F.lit(MANIFEST).alias("name"))
    parts = contents(archives).join(used.union(sound), ["archive", "name"], "left_semi").join(sound.select("archive"), "archive", "left_semi")
    return write_archives(parts.withColumn("archive", F.element_at(F.split("archive", "/"), -1)), folder, stored)


def extract(archives: DataFrame, section_id: str, role: str) -> DataFrame:
    """(archive, content) of one member whose size and hash are as declared."""
    m = members(archives).where((F.col("section_id") == section_id) & (F.col("role") == role) & F.col("code").isNull())
    right = F.coalesce(F.col("declared_sha256") == F.col("sha256"), F.lit(True)) & F.coalesce(F.col("declared_size") == F.col("size"), F.lit(True))
    return m.where(right & F.col("content").isNotNull()).select("archive", "content")


def write_archives(parts: DataFrame, folder: str, stored: bool = False) -> DataFrame:
    """Writes archives and returns (archive, path, bytes, sha256).

    ``parts``: (archive, name, content), one row per entry; the row named manifest.json is written last and stored.
    Each archive is one group, so its entries must fit a task. Files appear under their names only when complete, and
    an existing file is an error. ``folder`` must be a path that all executors share.
    """
    import os

    def write(key, table):
        archive = key[0].as_py()
        rows = sorted(table.select(["name", "content"]).to_pylist(), key=lambda r: (r["name"] == MANIFEST, r["name"]))
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, archive)
        temporary = os.path.join(folder, f".{archive}.{os.getpid()}.part")
        with zipfile.ZipFile(temporary, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
            for r in rows:
                z.writestr(zipfile.ZipInfo(r["name"]), r["content"], zipfile.ZIP_STORED if r["name"] == MANIFEST else None)
        try:
            os.link(temporary, path)
        finally:
            os.unlink(temporary)
        with open(path, "rb") as f:
            digest = hashlib.file_digest(f, "sha256").hexdigest()
        return pa.table({"archive": [archive], "path": [path], "bytes": [os.path.getsize(path)], "sha256": [digest]})

    return parts.select("archive", "name", "content").groupBy("archive").applyInArrow(write, "archive string, path string, bytes long, sha256 string")
