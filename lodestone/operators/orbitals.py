"""Semantic rules of wavefunctions, Bloch orbitals, natural transition orbitals (NTOs) and excited states.

A rule whose inputs are absent or of another type passes over the section: that is a finding of other rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import ao_count, component_factors
from ..sources import archives as A
from . import catalog, geometry
from .rules import Corpus, finding, get, here, kind_at, string_at
from .semantics import _all, _say, _typed, say_all, shapes, structures

BAD, GONE = "E_MEMBER_MALFORMED", "E_REF_UNRESOLVED"
COEFFICIENTS = ("mo_coefficients", "mo_coefficients_alpha", "mo_coefficients_beta")
MATRICES = ("overlap", "density_matrix", "density_matrix_alpha", "density_matrix_beta")
CHANNELS = ("alpha", "beta")
SECTION = ["archive", "section", "section_id"]
MOST_L = 7
#: Kinds that the references of a state may name.
STATE_REFS = {"nto_ref": ("wavefunction.gto",), "density_ref": ("volume.transition_density", "volume.difference")}
SHELL = "array<struct<l:bigint,pure:string,exponents:array<double>,coefficients:array<double>>>"


def _number(doc: Column, path: str) -> Column:
    """The JSON number at a path as a double, null for any other type."""
    return F.when(kind_at(doc, path).rlike("^(BIGINT|DOUBLE|DECIMAL)"), get(doc, path, "double"))


def _whole(doc: Column, path: str) -> Column:
    """The number at a path where it has no fraction."""
    n = _number(doc, path)
    return F.when(n == F.floor(n), n)


def _length(doc: Column, path: str) -> Column:
    """The number of entries of the array at a path, null where there is none."""
    return F.when(F.startswith(kind_at(doc, path), F.lit("ARRAY")), F.size(_typed(doc, path, "array<string>")))


def _numbers(doc: Column, path: str) -> Column:
    """The array at a path as doubles; null unless all entries are numbers."""
    values = _typed(doc, path, "array<double>")
    return F.when(F.startswith(kind_at(doc, path), F.lit("ARRAY")) & F.forall(values, lambda x: x.isNotNull()), values)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def basis_shells(corpus: Corpus) -> DataFrame:
    """(archive, section, section_id, shells, n_ao) of each basis; shells null unless every l and pure can be read.

    ``n_ao`` is then counted from the shells, else the one that is stated. Shells: array of (l, pure, exponents, coefficients).
    """
    d = F.col("doc")
    usual = F.when(kind_at(d, "$.pure").isNull(), F.lit(True)).when(kind_at(d, "$.pure") == "BOOLEAN", get(d, "$.pure", "boolean"))
    rows = corpus.documents(("wavefunction.gto", "basis")).select(*SECTION, _typed(d, "$.shells", SHELL).alias("raw"), usual.alias("usual"), _whole(d, "$.n_ao").alias("stated"))
    pure = lambda s: F.when(s["pure"].isNull(), F.col("usual")).when(s["pure"].isin("true", "false"), s["pure"] == "true")
    shells = F.transform("raw", lambda s: F.struct(s["l"].cast("int").alias("l"), pure(s).alias("pure"), s["exponents"].alias("exponents"), s["coefficients"].alias("coefficients")))
    sound = F.forall("shells", lambda s: F.coalesce(s["l"].between(0, MOST_L) & s["pure"].isNotNull(), F.lit(False)))
    rows = rows.withColumn("shells", shells).withColumn("shells", F.when(sound, F.col("shells")))
    counted = F.aggregate("shells", F.lit(0).cast("long"), lambda n, s: n + ao_count(s["l"], s["pure"]))
    return rows.select(*SECTION, "shells", F.coalesce(counted, F.when(F.col("stated") >= 0, F.col("stated").cast("long"))).alias("n_ao"))


def coefficient_ranks(corpus: Corpus) -> DataFrame:
    """Coefficients have a last axis (re, im) exactly where the metadata declare complex ones."""
    d = F.col("doc")
    encoding = F.when(string_at(d, "$.coefficient_encoding") == "complex_split_last_axis", True).when(string_at(d, "$.coefficient_encoding") == "real", False)
    declared = F.when(kind_at(d, "$.complex").isNotNull(), F.when(kind_at(d, "$.complex") == "BOOLEAN", get(d, "$.complex", "boolean"))).when(kind_at(d, "$.coefficient_encoding").isNotNull(), encoding).otherwise(F.lit(False))
    meta = corpus.documents(("wavefunction.gto", "mo_metadata")).select("archive", "section", declared.alias("complex"))
    rows = shapes(corpus, ("wavefunction.gto",), COEFFICIENTS).join(meta, ["archive", "section"])
    off = lambda role: F.when(F.col("complex"), (F.size(role) != 3) | (F.element_at(F.col(role), -1) != 2)).otherwise(F.size(role) != 2)
    return say_all(rows, *[(F.col(r).isNotNull() & F.col("complex").isNotNull() & off(r), BAD, r, F.concat(F.lit("wrong extents for complex = "), F.col("complex"))) for r in COEFFICIENTS])


def symmetry_labels(corpus: Corpus) -> DataFrame:
    """There is a label for each orbital energy."""
    rows, d = corpus.documents(("wavefunction.gto", "mo_metadata")), F.col("doc")
    return say_all(rows, *[(_length(d, f"$.{p}symmetry_labels") != _length(d, f"$.{p}energies"), BAD, "mo_metadata", f"{p}symmetry_labels and {p}energies differ in length") for p in ("", "alpha.", "beta.")])


def orbital_matrices(corpus: Corpus) -> DataFrame:
    """Overlap and densities are square in the basis; densities go with the coefficients of their own spin layout."""
    rows = shapes(corpus, ("wavefunction.gto",), MATRICES).join(basis_shells(corpus).select("archive", "section", "n_ao"), ["archive", "section"])
    have = corpus.members.where("kind = 'wavefunction.gto'").groupBy("archive", "section").agg(F.collect_set("role").alias("roles"))
    has = lambda role: F.array_contains("roles", role)
    both = has("mo_coefficients_alpha") & has("mo_coefficients_beta")
    tests = [(has("density_matrix") & ~has("mo_coefficients"), BAD, "density_matrix", "only beside mo_coefficients")]
    for ch, other in (CHANNELS, CHANNELS[::-1]):
        own = has(f"density_matrix_{ch}")
        tests.append((own & ~both, BAD, f"density_matrix_{ch}", "only beside coefficients of both spins"))
        tests.append((own & both & ~has(f"density_matrix_{other}"), BAD, f"density_matrix_{ch}", "the other spin's density is missing"))
    square = [(F.col(r) != F.array("n_ao", "n_ao"), BAD, r, F.concat(F.lit("not square in the basis functions: "), "n_ao")) for r in MATRICES]
    return say_all(rows, *square).union(say_all(have, *tests))


def electron_counts(corpus: Corpus, atol: float = 1e-6) -> DataFrame:
    """A basis' electrons are those of the occupations (but for transition weights) and of the provenance."""
    basis = corpus.documents(("wavefunction.gto", "basis")).select("archive", "section", _number(F.col("doc"), "$.n_electrons").alias("n")).where("n is not null")
    paths = ["$.occupations", *(f"$.{c}.occupations" for c in CHANNELS)]
    d = F.col("doc")
    given = F.lit(0) + sum((kind_at(d, p).isNotNull().cast("int") for p in paths), F.lit(0))
    read = sum((_numbers(d, p).isNotNull().cast("int") for p in paths), F.lit(0))
    total = sum((F.coalesce(_sum(_numbers(d, p)), F.lit(0.0)) for p in paths), F.lit(0.0))
    meta = corpus.documents(("wavefunction.gto", "mo_metadata")).where(F.coalesce(string_at(d, "$.occupation_semantics"), F.lit("")) != "transition_weight")
    meta = meta.select("archive", "section", given.alias("given"), read.alias("read"), total.alias("total")).where("given > 0 and given = read")
    root = corpus.roots.select("archive", _number(F.col("root"), "$.provenance.n_electrons").alias("stated"))
    return say_all(
        basis.join(meta, ["archive", "section"], "left").join(root, "archive", "left"),
        (F.abs(F.col("total") - F.col("n")) > atol, BAD, "basis", F.concat(F.lit("n_electrons isn't the sum of the occupations: "), "total")),
        (F.col("stated") != F.col("n"), "E_ROOT_INCONSISTENT", "basis", F.concat(F.lit("provenance.n_electrons is "), "stated")),
    )


def normalization(corpus: Corpus, rtol: float = 1e-6) -> DataFrame:
    """The diagonal of a stored overlap must be the basis functions' analytic self-overlaps."""
    square = A.diagonals(corpus.members.where("kind = 'wavefunction.gto' and role = 'overlap'")).where("dtype = 'float64'")
    shells = basis_shells(corpus).select("archive", "section", "n_ao", F.posexplode("shells").alias("shell", "s"))
    keys = ["archive", "section", "shell"]
    usable = (F.size("s.exponents") > 0) & (F.size("s.exponents") == F.size("s.coefficients")) & F.forall("s.exponents", lambda a: F.coalesce(a > 0, F.lit(False))) & F.forall("s.coefficients", lambda c: c.isNotNull())
    primitives = shells.where(usable).select(*keys, F.col("s.l").alias("l"), F.explode(F.arrays_zip(F.col("s.exponents").alias("a"), F.col("s.coefficients").alias("c"))).alias("p")).select(*keys, "l", F.col("p.a").alias("exponent"), F.col("p.c").alias("coefficient"))
    starts = geometry.ao_offsets(shells.select(*keys, "n_ao", "s", ao_count(F.col("s.l"), F.col("s.pure")).alias("n")), ["archive", "section"])
    functions = starts.select(*keys, "n_ao", "start", F.posexplode(component_factors(F.col("s.l"), F.col("s.pure"))).alias("part", "factor")).withColumn("ao", (F.col("start") + F.col("part")).cast("long"))
    stated = functions.join(square, ["archive", "section", "ao"]).where("n_ao = n").select(*keys, "ao", "n_ao", (F.col("value") / F.col("factor")).alias("stated"))
    bad = geometry.normalization_errors(primitives, stated, keys, rtol).groupBy("archive", "section").agg(F.count("*").alias("n"), F.first("n_ao").alias("n_ao"), F.min("ao").alias("ao"))
    return _say(bad, "E_NORMALIZATION", "overlap", F.concat("n", F.lit(" of "), "n_ao", F.lit(" self-overlaps aren't those of the basis, first at function "), "ao"))


def bloch(corpus: Corpus) -> DataFrame:
    """Extents of Bloch orbitals agree among members, metadata and k-points, and their structure is periodic.

    Coefficients are [k, spin, orbital, function, 2] with one or two spins; energies and occupations repeat the first three.
    """
    kind, d, key = "wavefunction.bloch", F.col("doc"), ["archive", "section"]
    s = shapes(corpus, (kind,), ("mo_coefficients", "energies", "occupations"))
    c = F.col("mo_coefficients")
    s = s.withColumn("five", F.when((F.size(c) == 5) & (c[4] == 2) & c[1].isin(1, 2), c))
    three = lambda role: F.when(F.size(role) == 3, F.col(role))
    s = s.withColumn("dims", F.coalesce(F.slice("five", 1, 3), three("energies"), three("occupations")))
    tests = [(c.isNotNull() & F.col("five").isNull(), BAD, "mo_coefficients", "extents must be [k, 1 or 2 spins, orbital, function, 2]")]
    for role in ("energies", "occupations"):
        tests.append((F.size(role) != 3, BAD, role, "extents must be [k, spin, orbital]"))
        tests.append(((F.size(role) == 3) & (F.col(role) != F.col("dims")), BAD, role, "extents differ from the other members'"))
    out, s = [say_all(s, *tests)], s.select(*key, "five", "dims")
    dims, five = F.col("dims"), F.col("five")
    k = corpus.documents((kind, "kpoints")).select(*key, *[_length(d, f"$.{n}").alias(n) for n in ("kpoints", "weights", "labels")]).join(s, key, "left")
    each = [(F.col(n) != F.col("kpoints"), BAD, "kpoints", f"{n} must have an entry for each k-point") for n in ("weights", "labels")]
    out.append(say_all(k, (F.col("kpoints") != dims[0], BAD, "kpoints", "another number of k-points than the members have"), *each))
    spins = F.when(string_at(d, "$.spin") == "restricted", 1).when(string_at(d, "$.spin") == "unrestricted", 2)
    m = corpus.documents((kind, "mo_metadata")).select(*key, spins.alias("spins"), *[_whole(d, f"$.{n}").alias(n) for n in ("n_spin", "n_mo", "n_ao")], _length(d, "$.n_mo_per_k").alias("per_k"), F.array_max(_typed(d, "$.n_mo_per_k", "array<double>")).alias("most")).join(s, key, "left")
    out.append(say_all(
        m, (F.col("spins") != F.col("n_spin"), BAD, "mo_metadata", "n_spin doesn't fit spin"),
        *[(F.col(n) != extent, BAD, "mo_metadata", F.concat(F.lit(f"{n} isn't the members' "), extent)) for n, extent in (("n_spin", dims[1]), ("n_mo", dims[2]), ("n_ao", five[3]))],
        (F.col("per_k") != dims[0], BAD, "mo_metadata", "n_mo_per_k must have an entry for each k-point"),
        (F.col("most") > F.coalesce(dims[2].cast("double"), F.col("n_mo")), BAD, "mo_metadata", "n_mo_per_k exceeds n_mo"),
    ))
    b = corpus.documents((kind, "basis")).select(*key, _whole(d, "$.n_ao").alias("n_ao"), string_at(d, "$.structure_ref").alias("inner")).join(s, key, "left")
    out.append(say_all(b, (F.col("n_ao") != five[3], BAD, "basis", "n_ao isn't the coefficients'")))
    own = corpus.sections.where(F.col("kind") == kind).select(*key, kind_at(F.col("value"), "$.structure_ref").isNotNull().alias("has"), string_at(F.col("value"), "$.structure_ref").alias("outer"))
    at = own.join(b.select(*key, "inner", F.lit(True).alias("based")), key, "left")
    out.append(_say(at.where("not has and based and inner is null"), GONE, "basis", "structure_ref must name a structure"))
    at = at.withColumn("structure", F.expr("if(has, outer, inner)")).join(structures(corpus), ["archive", "structure"])
    flat = ~F.coalesce(F.exists("pbc", lambda x: F.coalesce(x, F.lit(False))), F.lit(False))
    where = F.when(F.col("has"), F.lit("/structure_ref")).otherwise(F.lit("/members/basis"))
    out.append(finding(at.where(flat), BAD, here(F.col("section"), where), F.concat("structure", F.lit(" has no periodic axis")), F.col("section")))
    return _all(out)


def _states(corpus: Corpus) -> DataFrame:
    """(archive, section, section_id, k, state): each excited state as a map of its fields' JSON texts."""
    return corpus.documents(("excited_states", "states")).select(*SECTION, F.posexplode(_typed(F.col("doc"), "$.states", "array<map<string,string>>")).alias("k", "state"))


def _indexed(corpus: Corpus) -> tuple[DataFrame, DataFrame]:
    """Excited-state sections with a list of states (archive, ref), and their states (archive, ref, index)."""
    listed = corpus.documents(("excited_states", "states")).where(_length(F.col("doc"), "$.states").isNotNull()).select("archive", F.col("section_id").alias("ref")).distinct()
    index = F.col("state")["index"].try_cast("double")
    return listed, _states(corpus).select("archive", F.col("section_id").alias("ref"), index.alias("index")).where("index is not null").distinct()


def _unknown_states(corpus: Corpus, rows: DataFrame) -> DataFrame:
    """Of rows (archive, section, ref, index, ...), those whose section of states has none of that index."""
    listed, states = _indexed(corpus)
    return rows.join(listed, ["archive", "ref"], "left_semi").join(states, ["archive", "ref", "index"], "left_anti")


def state_counts(corpus: Corpus) -> DataFrame:
    rows, d = corpus.documents(("excited_states", "states")), F.col("doc")
    return _say(rows.where(_whole(d, "$.meta.n_states") != _length(d, "$.states")), BAD, "states", "n_states isn't the number of states")


def state_orbitals(corpus: Corpus) -> DataFrame:
    """Orbitals of a state's contributions are rows of the coefficients that its section refers to."""
    rows = shapes(corpus, ("wavefunction.gto",), COEFFICIENTS).where("section_id is not null").groupBy("archive", F.col("section_id").alias("ref"))
    rows = rows.agg(F.min_by(F.struct(*[F.col(r)[0].alias(r) for r in COEFFICIENTS]), "section").alias("n")).select("archive", "ref", "n.*")
    refs = corpus.sections.where("kind = 'excited_states'").select("archive", "section", string_at(F.col("value"), "$.wavefunction_ref").alias("ref")).where("ref is not null")
    terms = F.from_json(F.col("state")["contributions"], "array<struct<from_mo:bigint,to_mo:bigint,spin:string>>")
    used = _states(corpus).select("archive", "section", "k", F.explode(terms).alias("c")).join(refs, ["archive", "section"]).join(rows, ["archive", "ref"])
    one, a, b = (F.col(r) for r in COEFFICIENTS)
    n = F.coalesce(one, F.when(F.col("c.spin") == "alpha", a).when(F.col("c.spin") == "beta", b).otherwise(F.least(a, b)))
    return say_all(used, *[(~F.col(f"c.{f}").between(F.lit(0), n - 1), BAD, "states", F.concat(F.lit(f"{f} isn't an orbital of the wavefunction: state "), "k")) for f in ("from_mo", "to_mo")])


def state_references(corpus: Corpus) -> DataFrame:
    """What states refer to, and the states that spectra and transition densities refer to, are there."""
    out, states, v = [], _states(corpus), F.col("value")
    for field, kinds in STATE_REFS.items():
        rows = states.where(F.map_contains_key("state", field)).select("archive", "section", "k", F.col("state")[field].alias("ref"))
        named = corpus.named.where(F.col("_kind").isin(*kinds)).select(F.col("_a").alias("archive"), F.col("_id").alias("ref"))
        out.append(_say(rows.join(named, ["archive", "ref"], "left_anti"), GONE, "states", F.concat(F.lit(f"{field} doesn't resolve: state "), "k")))
    peaks = corpus.documents(*((k, "spectrum") for k in catalog.SPECTRA)).select("archive", "section", string_at(F.col("doc"), "$.states_ref").alias("ref"), F.explode(_typed(F.col("doc"), "$.peaks", "array<struct<assignment:struct<state_index:bigint>>>")).alias("p"))
    peaks = peaks.select("archive", "section", "ref", F.col("p.assignment.state_index").cast("double").alias("index")).where("ref is not null and index is not null")
    out.append(_say(_unknown_states(corpus, peaks), GONE, "spectrum", "a peak is assigned to no state of states_ref"))
    dens = corpus.sections.where("kind = 'volume.transition_density'").select("archive", "section", string_at(v, "$.excited_states_ref").alias("ref"), _whole(v, "$.state_index").alias("index")).where("ref is not null and index is not null")
    out.append(finding(_unknown_states(corpus, dens), GONE, here(F.col("section"), "/state_index"), F.lit("no such state of excited_states_ref"), F.col("section")))
    return _all(out)


def _ntos(corpus: Corpus) -> DataFrame:
    """One row for each NTO section: its state, role, spin layout, rows and weights by spin."""
    d = F.col("doc")
    own = [_numbers(d, f"$.{c}.occupations").alias(f"weights_{c}") for c in CHANNELS]
    stated = [F.array(_length(d, f"$.{c}.energies").cast("double"), _length(d, f"$.{c}.occupations").cast("double"), _whole(d, f"$.{c}.n_mo")).alias(f"stated_{c}") for c in CHANNELS]
    blocks = [F.coalesce(F.startswith(kind_at(d, f"$.{c}"), F.lit("OBJECT")), F.lit(False)).alias(f"has_{c}") for c in CHANNELS]
    meta = corpus.documents(("wavefunction.gto", "mo_metadata")).where(string_at(d, "$.orbital_kind") == "nto")
    meta = meta.select("archive", "section", string_at(d, "$.spin").alias("spin"), kind_at(d, "$.nto_role").isNotNull().alias("sided"), string_at(d, "$.nto_role").alias("side"), string_at(d, "$.state_ref").alias("ref"), _whole(d, "$.state_index").alias("index"), *own, *stated, *blocks)
    rows = shapes(corpus, ("wavefunction.gto",), COEFFICIENTS).select("archive", "section", *[F.col(f"mo_coefficients_{c}")[0].alias(f"rows_{c}") for c in CHANNELS])
    return meta.join(rows, ["archive", "section"], "left")


def nto_rows(corpus: Corpus) -> DataFrame:
    """Unrestricted NTOs have coefficients of each spin, and metadata for each of their rows."""
    tests = []
    for c in CHANNELS:
        off = F.exists(f"stated_{c}", lambda n: F.coalesce(n != F.col(f"rows_{c}"), F.lit(False)))
        tests.append((F.expr(f"has_{c} and rows_{c} is null"), BAD, "mo_metadata", f"mo_coefficients_{c} is missing"))
        tests.append((off, BAD, "mo_metadata", f"{c} must have an entry for each row of its coefficients"))
    return say_all(_ntos(corpus).where("sided and spin = 'unrestricted'"), *tests)


def nto_pairs(corpus: Corpus) -> DataFrame:
    """Unrestricted NTOs of a state come as one hole and one particle section with the same rows and weights."""
    every = _ntos(corpus)
    rows = every.where("sided and spin = 'unrestricted' and ref is not null and index is not null and side in ('hole', 'particle')")
    fields = ["spin", *(f"{x}_{c}" for x in ("rows", "weights") for c in CHANNELS)]
    partner = every.where("side in ('hole', 'particle')").groupBy("archive", "ref", "index", F.expr("if(side = 'hole', 'particle', 'hole')").alias("side")).agg(F.count("*").alias("partners"), F.first(F.struct(*fields)).alias("o"))
    both = rows.join(partner, ["archive", "ref", "index", "side"], "left")
    named = corpus.named.where("_kind = 'excited_states'").select(F.col("_a").alias("archive"), F.col("_id").alias("ref"))
    gone = rows.join(named, ["archive", "ref"], "left_anti").select("archive", "section").union(_unknown_states(corpus, rows.join(named, ["archive", "ref"], "left_semi")).select("archive", "section"))
    tests = [
        (F.expr("coalesce(partners, 0) <> 1"), GONE, "mo_metadata", F.concat(F.lit("sections of the opposite role for this state: "), F.coalesce("partners", F.lit(0)))),
        (F.expr("partners = 1 and coalesce(o.spin, '') <> 'unrestricted'"), BAD, "mo_metadata", "the partner has another spin layout"),
    ]
    same = F.expr("partners = 1 and o.spin = 'unrestricted'")
    for c in CHANNELS:
        tests.append((same & F.expr(f"rows_{c} <> o.rows_{c}"), BAD, "mo_metadata", f"the partner has another number of {c} rows"))
        tests.append((same & F.expr(f"weights_{c} <> o.weights_{c}"), BAD, "mo_metadata", f"the partner has other {c} weights"))
    return say_all(both, *tests).union(_say(gone, GONE, "mo_metadata", "state_ref and state_index name no excited state"))


RULES = {
    "semantics": (coefficient_ranks, symmetry_labels, orbital_matrices, electron_counts, normalization, bloch, state_counts, state_orbitals, nto_rows, nto_pairs),
    "references": (state_references,),
}
