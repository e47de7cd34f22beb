"""Semantic rules that compare members with each other, with structures and with the manifest's root."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import BOHR_PER_ANGSTROM, PER_HARTREE
from . import catalog
from .rules import Corpus, finding, get, here, kind_at, string_at

TRAJECTORIES = ("trajectory", "reaction.path")
#: Rank, last extent and form of a volume's data.
VOLUME_SHAPES = {"volume.laplacian": (3, None), "volume.vector": (4, 3), "volume.complex": (4, 2), "volume.series": (4, None)}
#: The factor that reaction energies are stated with.
REACTION_KCAL = 627.509474
QUANTITIES = {"energy": "energy_eh", "enthalpy": "enthalpy_eh", "gibbs_free_energy": "gibbs_free_energy_eh"}


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _typed(doc: Column, path: str, ddl: str) -> Column:
    """The part of a document at a path as a typed column; null where it has another shape."""
    return F.from_json(F.to_json(F.try_variant_get(doc, path, "variant")), ddl)


def _say(rows: DataFrame, code: str, role: str | Column, message: str | Column) -> DataFrame:
    role = F.lit(role) if isinstance(role, str) else role
    message = F.lit(message) if isinstance(message, str) else message
    return finding(rows, code, here(F.col("section"), "/members/", role), message, F.col("section"))


def say_all(rows: DataFrame, *tests: tuple[Column, str, str, str | Column]) -> DataFrame:
    """Findings of several tests (condition, code, role, message) in one pass over the rows, however many there are."""
    said = [F.when(c, F.struct(F.lit(code).alias("code"), F.lit(role).alias("role"), (F.lit(m) if isinstance(m, str) else m.cast("string")).alias("text"))) for c, code, role, m in tests]
    found = rows.select("archive", "section", F.explode(F.filter(F.array(*said), lambda x: x.isNotNull())).alias("said"))
    return finding(found, F.col("said.code"), here(F.col("section"), "/members/", F.col("said.role")), F.col("said.text"), F.col("section"))


def shapes(corpus: Corpus, kinds: tuple[str, ...], roles: tuple[str, ...]) -> DataFrame:
    """(archive, section, section_id, kind, a column for each role): extents of the members, null where not well formed."""
    formed = F.col("shape").rlike(r"^\[(\d+(, ?\d+)*)?\]$")
    m = corpus.members.where(F.col("kind").isin(*kinds)).withColumn("dims", F.when(formed, F.from_json("shape", "array<long>")))
    return m.groupBy("archive", "section", "section_id", "kind").agg(*[F.first(F.when(F.col("role") == r, F.col("dims")), ignorenulls=True).alias(r) for r in roles])


def structures(corpus: Corpus) -> DataFrame:
    """(archive, structure, n_atoms, pbc, lattice) of the first structure section with each id."""
    d = corpus.documents(("structure", "structure")).where("section_id is not null")
    rows = d.select("archive", F.col("section_id").alias("structure"), "section", F.size(_typed(F.col("doc"), "$.atoms", "array<string>")).alias("n_atoms"), _typed(F.col("doc"), "$.pbc", "array<boolean>").alias("pbc"), _typed(F.col("doc"), "$.lattice_vectors", "array<array<double>>").alias("lattice"))
    return rows.groupBy("archive", "structure").agg(F.min_by(F.struct("n_atoms", "pbc", "lattice"), "section").alias("s")).select("archive", "structure", "s.*")


def with_structure(corpus: Corpus, rows: DataFrame, stated: str | None) -> DataFrame:
    """Rows (archive, section, ...) with their structure: the section's reference, else the payload's, else the only one."""
    own = corpus.sections.select("archive", "section", kind_at(F.col("value"), "$.structure_ref").isNotNull().alias("has_ref"), string_at(F.col("value"), "$.structure_ref").alias("own_ref"))
    only = corpus.sections.where("kind = 'structure' and id is not null").groupBy("archive").agg(F.count("*").alias("n"), F.min("id").alias("only_ref")).where("n = 1").select("archive", "only_ref")
    rows = rows.join(own, ["archive", "section"]).join(only, "archive", "left")
    ref = F.when(F.col("has_ref"), F.col("own_ref")).otherwise(F.coalesce(F.col(stated) if stated else F.lit(None), F.col("only_ref")))
    return rows.withColumn("structure", ref).join(structures(corpus), ["archive", "structure"], "left")


def roles(corpus: Corpus) -> DataFrame:
    """Members that a kind requires, and the format, element type and rank of those it names."""
    spark = corpus.archives.sparkSession
    table = F.broadcast(spark.createDataFrame(catalog.roles(), "kind string, role string, required boolean, wanted string, dtypes array<string>, low int, high int"))  # fixed: some 150 rows
    have = corpus.members.select("archive", "section", "role").distinct()
    need = corpus.sections.where("kind is not null").join(table.where("required"), "kind").select("archive", "section", "role")
    missing = need.join(have, ["archive", "section", "role"], "left_anti")
    m = corpus.members.where("well_formed").join(table, ["kind", "role"])
    rank = F.size(F.from_json("shape", "array<string>"))
    binary = F.col("wanted") == "binary"
    return _all([
        finding(missing, "E_SCHEMA", here(F.col("section"), "/members"), F.concat(F.lit("required member missing: "), "role"), F.col("section")),
        _say(m.where(F.col("wanted").isin("json", "binary") & (F.coalesce("format", F.lit("")) != F.col("wanted"))), "E_SCHEMA", F.col("role"), F.concat(F.lit("format must be "), "wanted")),
        _say(m.where(binary & (F.size("dtypes") > 0) & ~F.array_contains("dtypes", F.coalesce(F.replace(F.col("dtype"), F.lit('"'), F.lit("")), F.lit("")))), "E_SCHEMA", F.col("role"), F.concat(F.lit("element type must be "), F.concat_ws(" or ", "dtypes"))),
        _say(m.where(binary & ((rank < F.col("low")) | (rank > F.col("high")))), "E_SCHEMA", F.col("role"), F.concat(F.lit("wrong rank "), rank)),
    ])


def custom_roles(corpus: Corpus) -> DataFrame:
    """custom.* members of atom properties need an entry in meta."""
    stated = corpus.documents(("atom_properties", "meta")).select("archive", "section", F.explode(F.map_keys(F.from_json(F.to_json("doc"), "map<string,string>"))).alias("role"))
    nested = corpus.documents(("atom_properties", "meta")).select("archive", "section", F.explode(F.map_keys(_typed(F.col("doc"), "$.custom", "map<string,string>"))).alias("key")).select("archive", "section", F.concat(F.lit("custom."), "key").alias("role"))
    own = corpus.members.where("kind = 'atom_properties' and role like 'custom.%'").select("archive", "section", "role")
    return _say(own.join(stated.union(nested).union(stated.withColumn("role", F.concat(F.lit("custom."), "role"))), ["archive", "section", "role"], "left_anti"), "E_MEMBER_MALFORMED", F.col("role"), "a custom role needs an entry in meta")


def bands(corpus: Corpus) -> DataFrame:
    s = shapes(corpus, ("bands",), ("eigenvalues", "projections", "occupations")).where("size(eigenvalues) = 3")
    e, p, o = F.col("eigenvalues"), F.col("projections"), F.col("occupations")
    return _all([
        _say(s.where((F.size(p) == 4) & (F.slice(p, 1, 3) != e)), "E_MEMBER_MALFORMED", "projections", "extents differ from the eigenvalues"),
        _say(s.where((F.size(p) == 3) & (F.slice(p, 1, 2) != F.slice(e, 2, 2))), "E_MEMBER_MALFORMED", "projections", "extents differ from the eigenvalues"),
        _say(s.where((F.size(o) == 3) & (o != e)), "E_MEMBER_MALFORMED", "occupations", "extents differ from the eigenvalues"),
    ])


def trajectories(corpus: Corpus, atol: float = 1e-10) -> DataFrame:
    scalars = {"trajectory": ("times", "energies", "cell_volumes", "temperatures"), "reaction.path": ("times", "energies")}
    named = ("coords", "velocities", "gradient", "lattice", "times", "energies", "cell_volumes", "temperatures")
    s = shapes(corpus, TRAJECTORIES, named).withColumnRenamed("gradient", "gradient_").withColumnRenamed("velocities", "velocities_")
    c = s.where("size(coords) = 3 and coords[2] = 3")
    frames = F.array(F.col("coords")[0])
    square = F.array(F.lit(3), F.lit(3)).cast("array<bigint>")
    out = [_say(c.where(F.col(f"{r}_") != F.col("coords")), "E_MEMBER_MALFORMED", r, "extents differ from the coordinates") for r in ("velocities", "gradient")]
    out += [_say(c.where((F.col("kind") == k) & (F.col(r) != frames)), "E_MEMBER_MALFORMED", r, "must have a value for each frame") for k, rs in scalars.items() for r in rs]
    out.append(_say(c.where((F.col("lattice") != square) & (F.col("lattice") != F.concat(frames, square))), "E_MEMBER_MALFORMED", "lattice", "must be 3 x 3, or that for each frame"))
    meta = corpus.documents(*((k, "metadata") for k in TRAJECTORIES))
    meta = meta.select("archive", "section", "kind", F.coalesce(get(F.col("doc"), "$.precision"), F.lit("float64")).alias("precision"), kind_at(F.col("doc"), "$.pbc").alias("pbc_kind"), _typed(F.col("doc"), "$.pbc", "array<boolean>").alias("pbc"), _typed(F.col("doc"), "$.energies", "array<double>").alias("listed"))
    member = lambda r: corpus.members.where(F.col("kind").isin(*TRAJECTORIES) & (F.col("role") == r))
    dtype = member("coords").select("archive", "section", F.replace(F.col("dtype"), F.lit('"'), F.lit("")).alias("dtype"))
    out.append(_say(meta.join(dtype, ["archive", "section"]).where("dtype in ('float32', 'float64') and (dtype = 'float32') <> (precision = 'float32')"), "E_MEMBER_MALFORMED", "coords", "precision must name the element type of the coordinates"))
    has_lattice = member("lattice").select("archive", "section").distinct().withColumn("lattice", F.lit(True))
    cell = meta.where("kind = 'trajectory'").join(has_lattice, ["archive", "section"], "left")
    out.append(_say(cell.where("lattice and (pbc_kind is null or pbc_kind = 'VOID')"), "E_MEMBER_MALFORMED", "metadata", "a lattice needs pbc"))
    out.append(_say(cell.where("lattice is null and exists(pbc, x -> x)"), "E_MEMBER_MALFORMED", "metadata", "a periodic axis needs a lattice"))
    from ..sources.archives import tensors

    stored = tensors(member("energies").where("dtype = '\"float64\"' and section_id is not null"))
    ids = member("energies").groupBy("archive", "section_id").agg(F.min("section").alias("section"))
    frame = meta.where("listed is not null").select("archive", "section", F.posexplode("listed").alias("flat", "listed"))
    differ = stored.join(ids, ["archive", "section_id"]).join(frame, ["archive", "section", "flat"]).where(~(F.abs(F.col("value") - F.col("listed")) <= atol)).groupBy("archive", "section").agg(F.count("*").alias("n"))
    out.append(_say(differ, "E_MEMBER_MALFORMED", "energies", F.concat(F.lit("frames that differ from the metadata: "), "n")))
    count = meta.where("listed is not null").join(s.select("archive", "section", "energies"), ["archive", "section"]).where("size(energies) = 1 and energies[0] <> size(listed)")
    out.append(_say(count, "E_MEMBER_MALFORMED", "energies", "the metadata lists another number of energies"))
    return _all(out)


def derivatives(corpus: Corpus) -> DataFrame:
    s = shapes(corpus, ("forces", "hessian"), ("gradient", "stress", "matrix"))
    meta = corpus.documents(("forces", "meta"), ("hessian", "meta")).select("archive", "section", string_at(F.col("doc"), "$.structure_ref").alias("meta_ref"), F.size(_typed(F.col("doc"), "$.atom_masses_amu", "array<double>")).alias("masses"))
    s = with_structure(corpus, s.join(meta, ["archive", "section"], "left"), "meta_ref")
    g, m = F.col("gradient"), F.col("matrix")
    square = (F.size(m) == 2) & (m[0] == m[1])
    return _all([
        _say(s.where(g.isNotNull() & ((F.size(g) != 2) | (F.get(g, F.lit(1)) != 3))), "E_MEMBER_MALFORMED", "gradient", "must be atoms x 3"),
        _say(s.where((F.size(g) == 2) & (g[1] == 3) & (g[0] != F.col("n_atoms"))), "E_MEMBER_MALFORMED", "gradient", "another number of atoms than the structure"),
        _say(s.where("stress <> array(3L, 3L)"), "E_MEMBER_MALFORMED", "stress", "must be 3 x 3"),
        _say(s.where(m.isNotNull() & ~square), "E_MEMBER_MALFORMED", "matrix", "must be square"),
        _say(s.where(square & (m[0] % 3 != 0)), "E_MEMBER_MALFORMED", "matrix", "must have three rows for each atom"),
        _say(s.where(square & (m[0] % 3 == 0) & (m[0] != 3 * F.col("n_atoms"))), "E_MEMBER_MALFORMED", "matrix", "another number of atoms than the structure"),
        _say(s.where(square & (m[0] % 3 == 0) & (F.col("masses") >= 0) & (3 * F.col("masses") != m[0])), "E_MEMBER_MALFORMED", "meta", "another number of masses than atoms"),
    ])


def volumes(corpus: Corpus) -> DataFrame:
    s = shapes(corpus, tuple(VOLUME_SHAPES), ("data",))
    d, out, bad = F.col("data"), [], F.lit(False)
    for kind, (rank, last) in VOLUME_SHAPES.items():
        wrong = (F.size(d) != rank) if last is None else (F.size(d) != rank) | (F.element_at(d, -1) != last)
        bad = bad | ((F.col("kind") == kind) & wrong)
    out.append(_say(s.where(d.isNotNull() & bad), "E_MEMBER_MALFORMED", "data", "wrong extents for its kind"))
    axis = corpus.documents(("volume.series", "axis")).join(s.where("size(data) = 4").select("archive", "section", "data"), ["archive", "section"])
    for key in ("values", "labels"):
        n = F.size(_typed(F.col("doc"), f"$.{key}", "array<string>"))
        out.append(_say(axis.where((n >= 0) & (n != d[0])), "E_MEMBER_MALFORMED", "axis", f"{key} must have an entry for each slab"))
    return _all(out)


def grid_spans(corpus: Corpus, rtol: float = 1e-6) -> DataFrame:
    """A periodic grid axis must follow a periodic axis of its structure and span its cell."""
    docs = corpus.documents(*((k, "grid") for k in catalog.KINDS if k.startswith("volume.") or k == "basis.ao"), ("reaction.path", "volume_grid"))
    g = docs.select("archive", "section", "role", string_at(F.col("doc"), "$.structure_ref").alias("grid_ref"), _typed(F.col("doc"), "$.periodic", "array<boolean>").alias("periodic"), F.coalesce(get(F.col("doc"), "$.includes_endpoint", "boolean"), F.lit(True)).alias("endpoint"), _typed(F.col("doc"), "$.shape", "array<bigint>").alias("n"), _typed(F.col("doc"), "$.voxel_vectors", "array<array<double>>").alias("step"))
    rows = with_structure(corpus, g.where("size(periodic) = 3"), "grid_ref").where("n_atoms is not null").withColumn("axis", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("periodic[axis]")
    flat = F.coalesce(F.get("pbc", "axis"), F.lit(False))
    count = F.get("n", "axis") - F.when(F.col("endpoint"), 1).otherwise(0)
    span, cell = F.get("step", "axis"), F.get("lattice", "axis")
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    off = norm(F.zip_with(span, cell, lambda s, t: s * count - t * BOHR_PER_ANGSTROM)) > rtol * norm(F.transform(cell, lambda t: t * BOHR_PER_ANGSTROM))
    return _say(rows.where(~flat), "E_MEMBER_MALFORMED", F.col("role"), F.concat(F.lit("the structure isn't periodic along axis "), "axis")).union(
        _say(rows.where(flat & off), "E_MEMBER_MALFORMED", F.col("role"), F.concat(F.lit("the grid doesn't span the cell along axis "), "axis")))


def dielectric(corpus: Corpus, atol: float = 1e-6) -> DataFrame:
    d = corpus.documents(("properties.dielectric", "properties")).select("archive", "section", *[F.flatten(_typed(F.col("doc"), f"$.{k}", "array<array<double>>")).alias(k) for k in ("electronic", "ionic", "static")], F.size(_typed(F.col("doc"), "$.born_charges", "array<string>")).alias("born"))
    whole = d.where("size(electronic) = 9 and size(ionic) = 9 and size(static) = 9")
    off = whole.where(F.exists(F.sequence(F.lit(0), F.lit(8)), lambda k: F.abs(F.get("static", k) - F.get("electronic", k) - F.get("ionic", k)) > atol))
    born = with_structure(corpus, d.where("born >= 0"), None).where("born <> n_atoms")
    return _say(off, "E_MEMBER_MALFORMED", "properties", "static isn't electronic plus ionic").union(_say(born, "E_MEMBER_MALFORMED", "properties", "another number of Born tensors than atoms"))


def dipole(corpus: Corpus, atol: float = 1e-6) -> DataFrame:
    root = corpus.roots.select("archive", _typed(F.col("root"), "$.dipole_moment.vector_debye", "array<double>").alias("rv"), get(F.col("root"), "$.dipole_moment.total_debye", "double").alias("rt"))
    d = corpus.documents(("properties.electric", "properties")).select("archive", "section", _typed(F.col("doc"), "$.dipole.vector", "array<double>").alias("v"), get(F.col("doc"), "$.dipole.total", "double").alias("t")).join(root, "archive")
    vector = (F.size("v") == 3) & (F.size("rv") == 3) & F.exists(F.zip_with("v", "rv", lambda a, b: F.abs(a - b) > atol), lambda x: x)
    return _say(d.where(vector), "E_ROOT_INCONSISTENT", "properties", "the dipole differs from the root's").union(_say(d.where(F.abs(F.col("t") - F.col("rt")) > atol), "E_ROOT_INCONSISTENT", "properties", "the total dipole differs from the root's"))


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hartree(value: Column) -> Column:
    """A struct(value, units) in hartree; null in units that aren't energies."""
    factor = F.create_map(*[F.lit(x) for k, f in {"hartree": 1.0, "eh": 1.0, "ev": PER_HARTREE["ev"], "kcal_per_mol": PER_HARTREE["kcal_per_mol"], "kj_per_mol": PER_HARTREE["kj_per_mol"], "cm-1": PER_HARTREE["cm-1"]}.items() for x in (k, 1.0 / f)])
    return value["value"] * factor[_ascii_lower(value["units"])]


def root_energies(corpus: Corpus, atol: float = 1e-8) -> DataFrame:
    """Energies that the root states twice must agree."""
    e, r = "struct<value:double,units:string>", F.col("root")
    rows = corpus.roots.select("archive", string_at(r, "$.provenance.method").alias("method"), _hartree(_typed(r, "$.provenance.scf_energy", e)).alias("scf"), string_at(r, "$.energies.method").alias("own"), _hartree(_typed(r, "$.energies.total", e)).alias("total"), _typed(r, "$.energies.by_method", f"array<struct<method:string,total:{e}>>").alias("each"), get(r, "$.thermochemistry.zpve_eh", "double").alias("zpve"), _hartree(_typed(r, "$.energies.components.zpve", e)).alias("part"))
    same = lambda c: _ascii_lower(c) == _ascii_lower(F.col("method"))
    by = rows.select("archive", "method", "scf", F.posexplode("each").alias("k", "m"))
    return _all([
        finding(rows.where(same(F.col("own")) & (F.abs(F.col("total") - F.col("scf")) > atol)), "E_ROOT_INCONSISTENT", F.lit("/energies/total"), F.lit("differs from provenance.scf_energy")),
        finding(by.where(same(F.col("m.method")) & (F.abs(_hartree(F.col("m.total")) - F.col("scf")) > atol)), "E_ROOT_INCONSISTENT", F.concat(F.lit("/energies/by_method/"), "k", F.lit("/total")), F.lit("differs from provenance.scf_energy")),
        finding(rows.where(F.abs(F.col("part") - F.col("zpve")) > atol), "E_ROOT_INCONSISTENT", F.lit("/energies/components/zpve"), F.lit("differs from thermochemistry.zpve_eh")),
    ])


def root_identity(corpus: Corpus) -> DataFrame:
    """Charge and multiplicity of an archive's only structure must be those of the provenance."""
    one = corpus.sections.where("kind = 'structure'").groupBy("archive").agg(F.count("*").alias("n"), F.first("section").alias("section"), F.to_json(F.first("value")).alias("v")).where("n = 1")
    rows = one.join(corpus.roots, "archive").withColumn("value", F.parse_json("v"))
    whole = lambda c, k: F.when(kind_at(c, k) == "BIGINT", get(c, k, "bigint"))
    return _all([finding(rows.where(whole(F.col("value"), f"$.{k}") != whole(F.col("root"), f"$.provenance.{k}")), "E_ROOT_INCONSISTENT", here(F.col("section"), "/" + k), F.lit(f"differs from provenance.{k}"), F.col("section")) for k in ("charge", "multiplicity")])


def reactions(corpus: Corpus) -> DataFrame:
    """Schemes: participants resolve, ids are unique, terms carry signed coefficients, and changes add up."""
    part = "array<struct<structure_ref:string,coefficient:double>>"
    delta = "struct<value_eh:double,kcal_mol:double>"
    term = "array<struct<structure_ref:string,coefficient:double,run_ref:string,method:string,energy_eh:double,enthalpy_eh:double,gibbs_free_energy_eh:double>>"
    ddl = f"array<struct<id:string,arrow:string,reactants:{part},products:{part},reagents:{part},energies:struct<terms:{term},deltas:struct<energy:{delta},enthalpy:{delta},gibbs_free_energy:{delta}>>>>"
    steps = corpus.documents(("reaction.scheme", "scheme")).select("archive", "section", F.posexplode(_typed(F.col("doc"), "$.steps", ddl)).alias("step", "s"))
    say = lambda rows, code, text: _say(rows, code, "scheme", F.concat(F.lit(f"{text}: step "), F.col("step")))
    first = steps.where("s.id is not null").groupBy("archive", "section", "s.id").agg(F.min("step").alias("first"))
    again = steps.withColumn("id", F.col("s.id")).join(first, ["archive", "section", "id"]).where("step > first")
    used = _all([steps.select("archive", "section", "step", F.lit(r).alias("role"), F.explode(f"s.{r}").alias("p")) for r in ("reactants", "products", "reagents")]).where("p.structure_ref is not null").select("archive", "section", "step", "role", F.col("p.structure_ref").alias("ref"), F.coalesce("p.coefficient", F.lit(1.0)).alias("c"))
    names = lambda kind: corpus.named.where(F.col("_kind") == kind).select(F.col("_a").alias("archive"), F.col("_id").alias("ref"))
    twice = used.groupBy("archive", "section", "step", "role", "ref").count().where("count > 1")
    sign = F.when(F.col("role") == "reactants", -1.0).otherwise(1.0)
    expected = used.where("role <> 'reagents'").groupBy("archive", "section", "step", "ref").agg(F.sum(sign * F.col("c")).alias("want")).where("want <> 0")
    stated = steps.where("s.energies.terms is not null").select("archive", "section", "step", F.posexplode("s.energies.terms").alias("k", "t"))
    terms = stated.where("t.structure_ref is not null").withColumn("ref", F.col("t.structure_ref"))
    per = terms.groupBy("archive", "section", "step", "ref").agg(F.count("*").alias("n"), F.min_by("t.coefficient", "k").alias("got"))
    keys = ["archive", "section", "step", "ref"]
    with_terms = steps.where("s.energies.terms is not null").select("archive", "section", "step")
    meets = expected.join(with_terms, ["archive", "section", "step"]).join(per, keys, "full_outer")
    runs = terms.where("t.run_ref is not null").select("archive", "section", "step", F.col("t.run_ref").alias("ref"))
    methods = stated.where("t.method is not null").groupBy("archive", "section", "step").agg(F.count_distinct("t.method").alias("n")).where("n > 1")
    out = [
        say(again, "E_MEMBER_MALFORMED", "a step id occurs twice"), say(twice, "E_MEMBER_MALFORMED", "a participant is named twice"),
        say(used.join(names("structure"), ["archive", "ref"], "left_anti"), "E_REF_UNRESOLVED", "a participant doesn't resolve"),
        say(runs.join(names("run.record"), ["archive", "ref"], "left_anti"), "E_REF_UNRESOLVED", "a run doesn't resolve"),
        say(steps.where("s.arrow = 'resonance' and s.energies is not null"), "E_MEMBER_MALFORMED", "a resonance arrow has no energies"),
        say(meets.where("n > 1"), "E_MEMBER_MALFORMED", "a participant has several terms"), say(meets.where("n is null"), "E_MEMBER_MALFORMED", "a participant has no term"),
        say(meets.where("want is null"), "E_MEMBER_MALFORMED", "a term names no participant"),
        say(meets.where(F.abs(F.col("got") - F.col("want")) > 1e-9 * F.greatest(F.lit(1.0), F.abs(F.col("got")))), "E_MEMBER_MALFORMED", "a term has another coefficient"),
        say(methods, "E_MEMBER_MALFORMED", "terms have different methods"),
    ]
    for q, field in QUANTITIES.items():
        given = steps.select("archive", "section", "step", F.col(f"s.energies.deltas.{q}").alias("d")).where("d.value_eh is not null")
        sums = stated.groupBy("archive", "section", "step").agg(F.sum(F.col("t.coefficient") * F.col(f"t.{field}")).alias("sum"), F.count_if(F.col(f"t.{field}").isNull()).alias("gone"), F.count_if(F.col("t.coefficient").isNull()).alias("open"))
        both = given.join(sums, ["archive", "section", "step"])
        out.append(say(both.where("gone > 0"), "E_MEMBER_MALFORMED", f"{q} lacks a term's value"))
        out.append(say(both.where("gone = 0 and open = 0").where(F.abs(F.col("sum") - F.col("d.value_eh")) > 1e-8), "E_MEMBER_MALFORMED", f"{q} isn't the sum of its terms"))
        kcal = F.col("d.value_eh") * REACTION_KCAL
        out.append(say(given.where(F.abs(F.col("d.kcal_mol") - kcal) > 1e-6 * F.greatest(F.lit(1.0), F.abs(kcal))), "E_MEMBER_MALFORMED", f"{q} in kcal/mol isn't the conversion"))
    return _all(out)


def nto_weights(corpus: Corpus) -> DataFrame:
    """Weights of unrestricted natural transition orbitals are nonnegative and don't increase."""
    d = corpus.documents(("wavefunction.gto", "mo_metadata")).where((get(F.col("doc"), "$.orbital_kind") == "nto") & (get(F.col("doc"), "$.spin") == "unrestricted") & kind_at(F.col("doc"), "$.nto_role").isNotNull())
    out = []
    for ch in ("alpha", "beta"):
        w = _typed(F.col("doc"), f"$.{ch}.occupations", "array<double>")
        rows = d.withColumn("w", w).where("size(w) > 0")
        up = F.exists(F.sequence(F.lit(1), F.size("w")), lambda k: F.coalesce(F.get("w", k) > F.get("w", k - 1), F.lit(False)))
        out.append(_say(rows.where(F.exists("w", lambda x: x < 0) | up), "E_MEMBER_MALFORMED", "mo_metadata", f"{ch} weights must be nonnegative and not increase"))
    return _all(out)


#: Rules by level, beside those of ``Corpus``.
RULES = {"manifest": (roles,), "semantics": (custom_roles, bands, trajectories, derivatives, volumes, grid_spans, dielectric, dipole, root_energies, root_identity, reactions, nto_weights)}
