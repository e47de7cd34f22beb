"""Validation: each rule is a DataFrame of findings over the archive tables; their union is the report.

A finding is (archive, section, severity, code, location, message). Rules read the tables of ``lodestone.sources.archives``:
entries, manifests, sections and members. Reference rules are anti-joins, cardinality rules grouped counts, payload
rules predicates over VARIANT; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import LEGACY_UNITS, UNITS, path_problem
from ..sources import archives as A
from ..sources.tables import durable
from . import catalog

LEVELS = ("container", "manifest", "payloads", "semantics", "references")


@dataclass(frozen=True)
class Limits:
    most_entry_bytes: int = 8 << 30
    most_total_bytes: int = 64 << 30
    most_ratio: float | None = None
    most_json_bytes: int = A.MOST_JSON_BYTES
    most_json_depth: int = A.MOST_JSON_DEPTH


def finding(rows: DataFrame, code: str | Column, location: Column, message: Column, section: Column | None = None) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    severity = F.when(F.startswith(code, F.lit("W_")), F.lit("warning")).otherwise(F.lit("error"))
    return rows.select("archive", (section if section is not None else F.lit(None)).cast("int").alias("section"), severity.alias("severity"), code.alias("code"), location.alias("location"), message.alias("message"))


def get(value: Column, path: str, kind: str = "string") -> Column:
    """The value at a path if it is there and of that type, else null."""
    return F.try_variant_get(value, path, kind)


def kind_at(value: Column, path: str) -> Column:
    """STRING, BIGINT, BOOLEAN, DOUBLE, DECIMAL..., ARRAY..., OBJECT..., VOID for JSON null; null where absent."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def string_at(value: Column, path: str) -> Column:
    return F.when(kind_at(value, path) == "STRING", get(value, path))


def here(*parts: Column) -> Column:
    return F.concat(F.lit("/sections/"), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


class Corpus:
    """The tables of a set of archives, and the rules over them.

    ``stored`` writes the tables once, so that each archive is opened three times however many rules are asked.
    """

    def __init__(self, archives: DataFrame, limits: Limits = Limits(), payloads: bool = True):
        self.archives, self.limits, self.payloads = archives, limits, payloads

    def stored(self) -> Corpus:
        """The same corpus with its tables written; of the members' bytes only those that rules read are kept."""
        needed = ((F.col("kind") == "preview") | ((F.col("kind") == "run.record") & F.col("role").isin("input", "log")) | (F.col("kind").isin("trajectory", "reaction.path") & (F.col("role") == "energies")) | ((F.col("kind") == "wavefunction.gto") & (F.col("role") == "overlap")))
        out = Corpus(self.archives, self.limits, self.payloads)
        out.__dict__ |= {
            "entries": durable(self.entries, "entries"),
            "manifests": durable(self.manifests, "manifests"),
            "members": durable(self.members.withColumn("content", F.when(needed, F.col("content"))).withColumn("text", F.lit(None).cast("string")), "members"),
        }
        out.__dict__["sections"] = durable(out.sections.withColumn("value", F.to_json("value")), "sections").withColumn("value", F.parse_json("value"))
        return out

    @cached_property
    def entries(self) -> DataFrame:
        return A.entries(self.archives)

    @cached_property
    def manifests(self) -> DataFrame:
        return A.manifests(self.archives, self.limits.most_json_bytes, self.limits.most_json_depth)

    @cached_property
    def roots(self) -> DataFrame:
        return self.manifests.where("manifest is not null").select("archive", F.parse_json("manifest").alias("root"))

    @cached_property
    def sections(self) -> DataFrame:
        s = A.sections(self.manifests)
        return s.withColumns({"id": string_at(F.col("value"), "$.id"), "kind": string_at(F.col("value"), "$.kind")})

    @cached_property
    def named(self) -> DataFrame:
        """(archive, id, kind) of the first section with each id: references resolve to the first."""
        first = self.sections.where("id is not null").groupBy("archive", "id").agg(F.min_by("kind", "section").alias("kind"))
        return first.select(F.col("archive").alias("_a"), F.col("id").alias("_id"), F.col("kind").alias("_kind"))

    @cached_property
    def members(self) -> DataFrame:
        return A.members(self.archives, None, self.payloads, self.limits.most_json_bytes, self.limits.most_json_depth)

    def documents(self, *pairs: tuple[str, str]) -> DataFrame:
        """(archive, section, section_id, kind, role, doc) of JSON members of the given (kind, role)."""
        wanted = reduce(lambda a, b: a | b, [(F.col("kind") == k) & (F.col("role") == r) for k, r in pairs])
        return self.members.where("json is not null").where(wanted).select("archive", "section", "section_id", "kind", "role", F.parse_json("json").alias("doc"))

    # --- container ---------------------------------------------------------------------------------------------------

    def unreadable(self) -> DataFrame:
        return finding(self.manifests.where("code is not null"), F.col("code"), F.lit("manifest.json"), F.col("message"))

    def duplicate_entries(self) -> DataFrame:
        n = self.entries.groupBy("archive", "name").agg(F.count("*").alias("n")).where("n > 1")
        twice = finding(n.where(F.col("name") != A.MANIFEST), "E_ZIP_DUPLICATE_ENTRY", F.concat(F.lit("entry:"), "name"), F.concat(F.lit("entry occurs "), F.col("n"), F.lit(" times")))
        old = n.where(F.col("name") == A.MANIFEST).withColumn("k", F.explode(F.sequence(F.lit(1), (F.col("n") - 1).cast("int"))))
        return twice.union(finding(old, "W_ORPHAN_MEMBER", F.lit("entry:manifest.json"), F.concat(F.lit("superseded manifest "), F.col("k"))))

    def entry_paths(self) -> DataFrame:
        why = path_problem(F.col("name"))
        return finding(self.entries.withColumn("why", why).where("why is not null"), "E_MEMBER_PATH", F.concat(F.lit("entry:"), "name"), F.col("why"))

    def entry_sizes(self) -> DataFrame:
        lim, at = self.limits, F.concat(F.lit("entry:"), "name")
        out = finding(self.entries.where(F.col("usize") > lim.most_entry_bytes), "E_MEMBER_TOO_LARGE", at, F.concat(F.col("usize"), F.lit(" bytes")))
        total = self.entries.groupBy("archive").agg(F.sum("usize").alias("total")).where(F.col("total") > lim.most_total_bytes)
        out = out.union(finding(total, "E_TOTAL_TOO_LARGE", F.lit(""), F.concat(F.col("total"), F.lit(" bytes"))))
        if lim.most_ratio is not None:
            much = (F.col("method") != 0) & (F.col("usize") >= 1 << 20) & (F.col("usize") > lim.most_ratio * F.greatest("csize", F.lit(1)))
            out = out.union(finding(self.entries.where(much), "E_COMPRESSION_RATIO", at, F.concat(F.col("usize"), F.lit(" bytes from "), F.col("csize"))))
        return out

    # --- manifest ----------------------------------------------------------------------------------------------------

    def version(self) -> DataFrame:
        key = F.filter(F.map_keys(F.from_json("manifest", "map<string,string>")), lambda k: k.rlike("^[a-z]+_version$"))[0]
        value = F.from_json("manifest", "map<string,string>")[key]
        rows = self.manifests.where("manifest is not null").withColumns({"key": F.coalesce(key, F.lit("version")), "value": value})
        code = F.when(F.col("value") == "2", F.lit("W_VERSION_WITHDRAWN")).when((F.col("value") == "1"), F.lit(None)).otherwise(F.lit("E_VERSION"))
        rows = rows.withColumn("what", code).where("what is not null")
        return finding(rows, F.col("what"), F.concat(F.lit("/"), "key"), F.concat(F.lit("format version "), F.coalesce("value", F.lit("absent"))))

    def byte_order(self) -> DataFrame:
        stated = kind_at(F.col("root"), "$.byte_order").isNotNull() & (F.coalesce(get(F.col("root"), "$.byte_order"), F.lit("")) != "little")
        return finding(self.roots.where(stated), "E_SCHEMA", F.lit("/byte_order"), F.lit("members are little-endian; no other byte order can be stated"))

    def source(self) -> DataFrame:
        out, isobject = [], F.startswith(kind_at(F.col("root"), "$.source"), F.lit("OBJECT"))
        rows = self.roots
        out.append(finding(rows.where(kind_at(F.col("root"), "$.source").isNotNull() & ~isobject), "E_SOURCE", F.lit("/source"), F.lit("source must be an object")))
        for k in ("program", "version", "calculation"):
            out.append(finding(rows.where(kind_at(F.col("root"), f"$.source.{k}").isNull()), "E_SOURCE", F.lit("/source"), F.lit(f"source.{k} is missing")))
        empty = (F.coalesce(get(F.col("root"), "$.source.program"), F.lit("")) == "") | (F.coalesce(get(F.col("root"), "$.source.version"), F.lit("")) == "")
        out.append(finding(rows.where(empty), "E_SOURCE", F.lit("/source"), F.lit("source.program and source.version must not be empty")))
        return reduce(DataFrame.union, out)

    def section_shape(self) -> DataFrame:
        v, s = F.col("value"), self.sections
        isobject = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
        out = [finding(s.where(~isobject), "E_SECTION_MALFORMED", here(F.col("section")), F.lit("a section must be an object"), F.col("section"))]
        for k in ("id", "kind"):
            out.append(finding(s.where(isobject & F.col(k).isNull()), "E_SECTION_MALFORMED", here(F.col("section")), F.lit(f"{k} must be a string"), F.col("section")))
        nomembers = ~F.coalesce(F.startswith(kind_at(v, "$.members"), F.lit("OBJECT")), F.lit(False))
        out.append(finding(s.where(isobject & nomembers), "E_SECTION_MALFORMED", here(F.col("section")), F.lit("members must be an object"), F.col("section")))
        roots = self.roots.where(kind_at(F.col("root"), "$.sections").isNotNull() & ~F.startswith(kind_at(F.col("root"), "$.sections"), F.lit("ARRAY")))
        out.append(finding(roots, "E_SECTION_MALFORMED", F.lit("/sections"), F.lit("sections must be an array")))
        return reduce(DataFrame.union, out)

    def section_ids(self) -> DataFrame:
        s = self.sections.where("id is not null")
        first = s.groupBy("archive", "id").agg(F.min("section").alias("first"), F.count("*").alias("n")).where("n > 1")
        again = s.join(first, ["archive", "id"]).where("section > first")
        out = finding(again, "E_SECTION_ID_DUPLICATE", here(F.col("section"), "/id"), F.concat(F.lit("duplicate section id "), "id"), F.col("section"))
        reserved = s.where(F.col("id").isin(*catalog.RESERVED_IDS))
        return out.union(finding(reserved, "E_RESERVED_ID", here(F.col("section"), "/id"), F.concat(F.lit("reserved section id "), "id"), F.col("section")))

    def section_kinds(self) -> DataFrame:
        s = self.sections.where("kind is not null")
        vendor = F.startswith(F.col("kind"), F.lit("x_"))
        unknown = s.where(~F.col("kind").isin(*catalog.KINDS) & ~vendor)
        out = finding(unknown, "E_KIND_UNKNOWN", here(F.col("section"), "/kind"), F.concat(F.lit("unknown kind "), "kind"), F.col("section"))
        declared = self.manifests.where("manifest is not null").select("archive", F.explode(F.map_keys(F.from_json(F.get_json_object("manifest", "$.extensions"), "map<string,string>"))).alias("space"))
        critical = s.where(vendor & F.coalesce(get(F.col("value"), "$.critical", "boolean"), F.lit(False))).withColumn("space", F.split_part("kind", F.lit("."), F.lit(1)))
        gone = critical.join(declared.distinct(), ["archive", "space"], "left_anti")
        return out.union(finding(gone, "E_CRITICAL_UNDECLARED", here(F.col("section"), "/critical"), F.concat(F.lit("undeclared extension "), "space"), F.col("section")))

    def provenance_units(self) -> DataFrame:
        stated = self.manifests.where("manifest is not null").select("archive", F.explode(F.from_json(F.get_json_object("manifest", "$.provenance"), "map<string,string>")).alias("key", "text"))
        value = F.from_json("text", "struct<value:string,units:string>")
        rows = stated.withColumn("unit", value["units"]).where(value["value"].isNotNull() & F.col("unit").isNotNull() & ~F.col("unit").isin(*UNITS, *LEGACY_UNITS))
        return finding(rows, "W_UNIT_UNKNOWN", F.concat(F.lit("/provenance/"), "key", F.lit("/units")), F.concat(F.lit("unknown unit "), "unit"))

    def member_specs(self) -> DataFrame:
        at, m = here(F.col("section"), "/members/", F.col("role")), self.members
        say = lambda rows, code, text: finding(rows, code, at, text, F.col("section"))
        why = path_problem(F.col("path"))
        ok = m.where("well_formed")
        legal = ok.where(why.isNull())
        return reduce(DataFrame.union, [
            say(m.where("not well_formed"), "E_MEMBER_MALFORMED", F.lit("malformed member")),
            say(ok.where(why.isNotNull()), "E_MEMBER_PATH", why),
            say(legal.where("not found"), "E_MEMBER_MISSING", F.concat(F.lit("not in the archive: "), "path")),
            say(legal.where("found and declared_size is not null and declared_size <> entry_size"), "E_BINARY_SIZE", F.concat(F.lit("declared size "), F.col("declared_size"), F.lit(", stored "), F.col("entry_size"))),
        ])

    def orphans(self) -> DataFrame:
        there = self.entries.where((F.col("name") != A.MANIFEST) & ~F.endswith("name", F.lit("/"))).select("archive", "name").distinct()
        there = there.join(self.manifests.where("manifest is not null").select("archive"), "archive", "left_semi")
        used = self.members.where("path is not null").select("archive", F.col("path").alias("name")).distinct()
        return finding(there.join(used, ["archive", "name"], "left_anti"), "W_ORPHAN_MEMBER", F.concat(F.lit("entry:"), "name"), F.lit("no section declares this entry"))

    # --- payloads ----------------------------------------------------------------------------------------------------

    def payload_bytes(self) -> DataFrame:
        at, m = here(F.col("section"), "/members/", F.col("role")), self.members
        say = lambda rows, code, text: finding(rows, code, at, text, F.col("section"))
        size = F.create_map(*[F.lit(x) for k, v in A.DTYPES.items() for x in (k, int(v[2:]))])
        binary = m.where("format = 'binary' and dtype is not null and size is not null").withColumns({"item": size[F.get_json_object(F.concat(F.lit('{"d":'), "dtype", F.lit("}")), "$.d")], "dims": F.from_json(F.coalesce("shape", F.lit("[]")), "array<long>")})
        formed = F.coalesce(F.col("shape"), F.lit("[]")).rlike(r"^\[(\d+(, ?\d+)*)?\]$")
        expected = F.aggregate("dims", F.col("item").cast("long"), lambda a, n: a * n)
        png, jpeg = F.startswith("content", F.unhex(F.lit("89504E470D0A1A0A"))), F.startswith("content", F.unhex(F.lit("FFD8FF")))
        svg = F.coalesce(F.contains(F.col("content").try_cast("string"), F.lit("<svg")), F.lit(False))
        preview = m.where("kind = 'preview' and content is not null and role in ('thumbnail', 'image')")
        return reduce(DataFrame.union, [
            say(m.where("code is not null"), F.col("code"), F.col("message")),
            say(m.where("declared_sha256 is not null and sha256 is not null and declared_sha256 <> sha256"), "E_SHA256_MISMATCH", F.lit("sha256 differs")),
            say(binary.where("item is null"), "E_DTYPE", F.concat(F.lit("bad dtype "), "dtype")),
            say(binary.where(F.col("item").isNotNull() & ~formed), "E_MEMBER_MALFORMED", F.concat(F.lit("bad shape "), "shape")),
            say(binary.where(F.col("item").isNotNull() & formed & (expected != F.col("size"))), "E_BINARY_SIZE", F.concat(F.col("size"), F.lit(" bytes, not "), expected)),
            say(m.where("kind = 'run.record' and role in ('input', 'log') and content is not null").where(~F.is_valid_utf8("content")), "E_UTF8", F.lit("must be UTF-8")),
            say(preview.where(~(png | jpeg | svg)), "E_MEMBER_MALFORMED", F.lit("neither PNG nor JPEG nor SVG")),
        ])

    # --- semantics ---------------------------------------------------------------------------------------------------

    def periodicity(self) -> DataFrame:
        rows, d = self.documents(("structure", "structure")), F.col("doc")
        pbc, lattice, dim = F.from_json(F.to_json(F.try_variant_get(d, "$.pbc", "variant")), "array<boolean>"), kind_at(d, "$.lattice_vectors"), get(d, "$.dimensionality", "double")
        rows = rows.withColumns({"pbc_kind": kind_at(d, "$.pbc"), "pbc": pbc, "lattice": lattice, "dim": dim})
        absent = F.col("pbc_kind").isNull() | (F.col("pbc_kind") == "VOID")
        three = F.coalesce((F.size("pbc") == 3) & (F.col("pbc_kind") == "ARRAY<BOOLEAN>"), F.lit(False))
        n = F.size(F.filter("pbc", lambda x: x))
        has_lattice = F.coalesce(F.startswith("lattice", F.lit("ARRAY")), F.lit(False))
        given = F.col("lattice").isNotNull() & (F.col("lattice") != "VOID")
        tests = [
            (absent & given, "lattice vectors without pbc"),
            (absent & (F.coalesce("dim", F.lit(0.0)) != 0), "dimensionality without pbc"),
            (~absent & ~three, "pbc must be three booleans"),
            (~absent & three & (n > 0) & ~has_lattice, "periodic axes without lattice vectors"),
            (~absent & three & F.col("dim").isNotNull() & (F.col("dim") != n), "dimensionality differs from the periodic axes"),
        ]
        return reduce(DataFrame.union, [finding(rows.where(t), "E_STRUCTURE_PERIODICITY", here(F.col("section"), "/members/", F.col("role")), F.lit(m), F.col("section")) for t, m in tests])

    def charge_multiplicity(self) -> DataFrame:
        docs = self.documents(("structure", "structure"))
        z = F.from_json(F.to_json(F.try_variant_get("doc", "$.atoms", "variant")), "array<struct<atomic_number:bigint>>")
        sums = docs.withColumn("z", z).where(F.forall("z", lambda a: a["atomic_number"].isNotNull() & (a["atomic_number"] >= 0))).select("archive", "section", F.aggregate("z", F.lit(0).cast("long"), lambda s, a: s + a["atomic_number"]).alias("sum_z"))
        v = F.col("value")
        whole = lambda k: F.when(kind_at(v, f"$.{k}") == "BIGINT", get(v, f"$.{k}", "bigint"))
        rows = self.sections.where("kind = 'structure'").withColumns({"charge": whole("charge"), "mult": whole("multiplicity")}).join(sums, ["archive", "section"]).where("charge is not null")
        rows = rows.withColumn("electrons", F.col("sum_z") - F.col("charge"))
        odd = (F.col("mult") >= 1) & ((F.col("mult") - 1 > F.col("electrons")) | ((F.col("electrons") - (F.col("mult") - 1)) % 2 != 0))
        at = lambda f: here(F.col("section"), "/" + f)
        return finding(rows.where("electrons < 0"), "E_CHARGE_MULTIPLICITY", at("charge"), F.concat(F.lit("leaves electrons: "), F.col("electrons")), F.col("section")).union(
            finding(rows.where((F.col("electrons") >= 0) & odd), "E_CHARGE_MULTIPLICITY", at("multiplicity"), F.concat(F.lit("impossible with electrons: "), F.col("electrons")), F.col("section")))

    def spectrum_lengths(self) -> DataFrame:
        rows = self.documents(*((k, "spectrum") for k in catalog.SPECTRA))
        size = lambda p: F.when(F.startswith(kind_at(F.col("doc"), p), F.lit("ARRAY")), F.size(F.from_json(F.to_json(F.try_variant_get("doc", p, "variant")), "array<string>")))
        pairs = [("$.frequencies", "$.intensities"), ("$.frequencies", "$.x")]
        return reduce(DataFrame.union, [finding(rows.where(size(a) != size(b)), "E_PAYLOAD_SCHEMA", here(F.col("section"), "/members/spectrum"), F.lit(f"{a} and {b} differ in length"), F.col("section")) for a, b in pairs])

    def bond_indices(self) -> DataFrame:
        pairs = F.from_json(F.to_json(F.try_variant_get("doc", "$.pairs", "variant")), "array<struct<i:bigint,j:bigint>>")
        atoms = self.documents(("structure", "structure")).select("archive", F.col("section_id").alias("_s"), F.size(F.from_json(F.to_json(F.try_variant_get("doc", "$.atoms", "variant")), "array<string>")).alias("n"))
        targets = self.sections.select("archive", "section", F.coalesce(string_at(F.col("value"), "$.structure_ref"), F.when(F.col("kind") == "structure", F.col("id"))).alias("_s"))
        rows = self.documents(("bonds", "bonds"), ("structure", "bonds")).withColumn("pair", F.explode(pairs)).join(targets, ["archive", "section"]).join(atoms, ["archive", "_s"])
        out = rows.where("pair.i is null or pair.j is null or pair.i < 0 or pair.j < 0 or pair.i >= n or pair.j >= n")
        return finding(out, "E_MEMBER_MALFORMED", here(F.col("section"), "/members/", F.col("role")), F.concat(F.lit("bond outside the atoms: "), F.col("pair.i"), F.lit("-"), F.col("pair.j")), F.col("section"))

    def excited_order(self) -> DataFrame:
        states = F.from_json(F.to_json(F.try_variant_get("doc", "$.states", "variant")), "array<struct<index:bigint>>")
        rows = self.documents(("excited_states", "states")).withColumn("index", F.transform(states, lambda s: s["index"]))
        back = F.exists(F.zip_with(F.slice("index", 1, F.greatest(F.size("index") - 1, F.lit(0))), F.slice("index", 2, F.greatest(F.size("index"), F.lit(1))), lambda a, b: b < a), lambda x: F.coalesce(x, F.lit(False)))
        at = here(F.col("section"), "/members/states")
        return finding(rows.where(F.size("index") != F.size(F.array_distinct("index"))), "E_MEMBER_MALFORMED", at, F.lit("a state index occurs twice"), F.col("section")).union(finding(rows.where((F.size("index") > 1) & back), "E_MEMBER_MALFORMED", at, F.lit("state indices must ascend"), F.col("section")))

    def elastic_symmetry(self, rtol: float = 1e-6) -> DataFrame:
        m = F.from_json(F.to_json(F.try_variant_get("doc", "$.stiffness", "variant")), "array<array<double>>")
        rows = self.documents(("properties.elastic", "properties")).withColumn("m", m).where("size(m) = 6")
        most = F.array_max(F.transform(F.flatten("m"), F.abs))
        skew = F.exists(F.sequence(F.lit(0), F.lit(5)), lambda i: F.exists(F.sequence(F.lit(0), F.lit(5)), lambda j: F.abs(F.get(F.get("m", i), j) - F.get(F.get("m", j), i)) > rtol * most))
        return finding(rows.where(skew), "E_MEMBER_MALFORMED", here(F.col("section"), "/members/properties"), F.lit("the stiffness matrix isn't symmetric"), F.col("section"))

    def kpoint_weights(self, atol: float = 1e-6) -> DataFrame:
        w = F.from_json(F.to_json(F.try_variant_get("doc", "$.weights", "variant")), "array<double>")
        rows = self.documents(("wavefunction.bloch", "kpoints")).withColumn("sum", F.aggregate(w, F.lit(0.0), lambda s, x: s + x))
        return finding(rows.where(F.abs(F.col("sum") - 1) > atol), "E_MEMBER_MALFORMED", here(F.col("section"), "/members/kpoints"), F.concat(F.lit("weights add up to "), F.col("sum")), F.col("section"))

    def files_index(self) -> DataFrame:
        names = self.documents(("run.record", "files")).withColumn("role_", F.explode(F.map_keys(F.from_json(F.to_json("doc"), "map<string,string>"))))
        own = self.members.select("archive", "section", F.col("role").alias("role_"))
        return finding(names.join(own, ["archive", "section", "role_"], "left_anti"), "E_FILES_INDEX", here(F.col("section"), "/members/files"), F.concat(F.lit("no member "), "role_"), F.col("section"))

    def declared_units(self) -> DataFrame:
        rows = self.members.where("json is not null").where(F.col("kind").isin(*catalog.KINDS))
        stated = rows.select("archive", "section", "role", F.explode(F.from_json(F.get_json_object("json", "$.units"), "map<string,string>")).alias("key", "unit"))
        return finding(stated.where(~F.col("unit").isin(*UNITS)), "W_UNIT_UNKNOWN", here(F.col("section"), "/members/", F.col("role")), F.concat("key", F.lit(": unknown unit "), "unit"), F.col("section"))

    # --- references --------------------------------------------------------------------------------------------------

    @cached_property
    def references(self) -> DataFrame:
        """(archive, section, field, ref, kinds, location): every reference that must resolve; ref null if ill-typed or absent but required."""
        out, v = [], F.col("value")
        for kind, field, kinds, required in catalog.SECTION_REFS:
            rows = self.sections if kind is None else self.sections.where(F.col("kind") == kind)
            stated = kind_at(v, f"$.{field}").isNotNull() & (kind_at(v, f"$.{field}") != "VOID")
            rows = rows if required else rows.where(stated)
            out.append(rows.select("archive", "section", F.lit(field).alias("field"), string_at(v, f"$.{field}").alias("ref"), F.array(*[F.lit(k) for k in kinds]).cast("array<string>").alias("kinds"), here(F.col("section"), "/" + field).alias("location")))
        for kind, role, path, kinds in catalog.PAYLOAD_REFS:
            rows = self.members.where((F.col("kind") == kind) & (F.col("role") == role) & F.col("json").isNotNull())
            rows = rows.withColumn("ref", F.get_json_object("json", path)).where("ref is not null")
            out.append(rows.select("archive", "section", F.lit(path[2:]).alias("field"), "ref", F.array(*[F.lit(k) for k in kinds]).alias("kinds"), here(F.col("section"), "/members/" + role).alias("location")))
        return reduce(DataFrame.union, out)

    def unresolved(self) -> DataFrame:
        fits = (F.col("archive") == F.col("_a")) & (F.col("ref") == F.col("_id")) & ((F.size("kinds") == 0) | F.array_contains(F.col("kinds"), F.col("_kind")))
        gone = self.references.join(self.named, fits, "left_anti")
        return finding(gone, "E_REF_UNRESOLVED", F.col("location"), F.concat("field", F.lit(" doesn't resolve: "), F.coalesce("ref", F.lit("not a string"))), F.col("section"))

    RULES = {
        "container": ("unreadable", "duplicate_entries", "entry_paths", "entry_sizes"),
        "manifest": ("version", "byte_order", "source", "section_shape", "section_ids", "section_kinds", "member_specs", "orphans"),
        "payloads": ("payload_bytes",),
        "semantics": ("periodicity", "charge_multiplicity", "spectrum_lengths", "bond_indices", "excited_order", "elastic_symmetry", "kpoint_weights", "files_index", "declared_units", "provenance_units"),
        "references": ("unresolved",),
    }

    def findings(self, level: str = "references") -> DataFrame:
        """All findings of the rules up to ``level``; only those rules are planned."""
        from . import orbitals, semantics

        levels = LEVELS[: LEVELS.index(level) + 1]
        own = [getattr(self, n)().withColumn("rule", F.lit(n)) for k in levels for n in self.RULES[k]]
        more = [f(self).withColumn("rule", F.lit(f.__name__)) for k in levels for m in (semantics, orbitals) for f in m.RULES.get(k, ())]
        return reduce(DataFrame.union, own + more)

    def report(self, level: str = "references") -> DataFrame:
        """(archive, ok, n_sections, n_errors, n_warnings, errors, warnings) for every archive."""
        f = self.findings(level)
        text = F.struct("section", F.concat("code", F.lit(": "), "message").alias("text"))
        said = f.groupBy("archive").agg(*[F.array_sort(F.collect_list(F.when(F.col("severity") == s, text))).alias(s + "s") for s in ("error", "warning")])
        n = self.sections.groupBy("archive").agg(F.count("*").alias("n"))
        rows = self.archives.select("archive").distinct().join(said, "archive", "left").join(n, "archive", "left")
        texts = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<section:int,text:string>>")), lambda x: x["text"])
        rows = rows.withColumns({"errors": texts("errors"), "warnings": texts("warnings")})
        return rows.select("archive", (F.size("errors") == 0).alias("ok"), F.coalesce("n", F.lit(0)).alias("n_sections"), F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), "errors", "warnings")
