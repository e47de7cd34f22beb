"""Comparison, versions, redaction, geometry and scalars on small tables with known answers."""

import copy
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import compare, geometry as G, versions
from lodestone.sources import archives as A
from tests.fixtures import build, water


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_units(spark):
    assert one(spark, S.convert(F.lit(1.0), "hartree", "kcal_per_mol")) == pytest.approx(627.5094740631, abs=1e-9)
    assert one(spark, S.convert(F.lit(1239.841984332), "nm", "eV")) == pytest.approx(1.0)
    assert one(spark, S.convert(S.convert(F.lit(2.5), "angstrom", "bohr"), "bohr", "angstrom")) == pytest.approx(2.5)
    assert one(spark, S.canonical_unit(F.lit("Eh"))) == "hartree" and one(spark, S.canonical_unit(F.lit("EV"))) is None
    with pytest.raises(ValueError):
        S.convert(F.lit(1.0), "bohr", "ev")


@pytest.mark.parametrize("a,b,rtol,atol", [(1.0, 1.0 + 1e-9, 1e-9, 0), (1.0, 1.1, 0.05, 0), (math.inf, math.inf, 0, 0), (math.inf, 1.0, 1, 1), (math.nan, math.nan, 1, 1), (0.0, 1e-12, 0, 1e-12), (-1.0, 1.0, 2.0, 0)])
def test_closeness_is_that_of_the_standard_library(spark, a, b, rtol, atol):
    assert one(spark, S.is_close(F.lit(a), F.lit(b), rtol, atol)) == math.isclose(a, b, rel_tol=rtol, abs_tol=atol)


def test_paths_pointers_numbers(spark):
    why = {p: one(spark, S.path_problem(F.lit(p))) for p in ("a/b", "a\\b", "/a", "C:x", "a/../b", "..a/b", "a..")}
    assert [p for p, w in why.items() if w is None] == ["a/b", "..a/b", "a.."]
    assert one(spark, S.pointer_escape(F.lit("a/b~c"))) == "a~1b~0c"
    assert one(spark, S.finite_number(F.lit("1.5D2"))) == 150.0 and one(spark, S.finite_number(F.lit("inf"))) is None and one(spark, S.finite_number(F.lit("x"))) is None
    assert one(spark, S.number_with_uncertainty(F.lit("1.23(4)"))) == 1.23
    assert one(spark, S.odd_double_factorial(F.lit(7))) == 105 and one(spark, S.odd_double_factorial(F.lit(-1))) == 1
    assert one(spark, S.ao_count(F.lit(2), F.lit(True))) == 5 and one(spark, S.ao_count(F.lit(2), F.lit(False))) == 6
    assert one(spark, S.redact(F.lit("a1b22"), "[0-9]+", "$1\\")[0]) == "a$1\\b$1\\"
    assert one(spark, S.utc_timestamp(F.lit("2024-01-02T03:04:05Z"))) is not None and one(spark, S.utc_timestamp(F.lit("2024-01-02"))) is None


def diffs(spark, tmp_path, left, right, **options):
    for side, spec in (("l", left), ("r", right)):
        (tmp_path / side).mkdir()
        (tmp_path / side / "x.arc").write_bytes(build(spec))
    key = F.element_at(F.split("archive", "/"), -1)
    found = compare.diff(*(A.read_archives(spark, str(tmp_path / s)) for s in "lr"), key, **options)
    return {(r.location, r.message) for r in found.collect()}, found


def test_equal_archives(spark, tmp_path):
    assert diffs(spark, tmp_path, water(), water())[0] == set()


def test_differences(spark, tmp_path):
    other = copy.deepcopy(water())
    mol, rho, ir, run = other["sections"]
    mol["charge"] = 1
    mol["extra/key"] = {"deep": {"er": 1}}
    rho["members"]["data"] = rho["members"]["data"] + np.eye(2)[:, :, None] * [1e-7, 1e-3]
    ir["members"]["spectrum"] = {"frequencies": [1.0, 2.0, 3.0], "intensities": [3.0000001, True]}
    run["members"]["log"] = b"done on host8\n"
    got, found = diffs(spark, tmp_path, water(), other, atol=1e-6)
    assert got == {
        ("manifest/sections/0/charge", "number differs"), ("manifest/sections/0/extra~1key", "only on the right"),
        ("rho/data[1]", "number differs"), ("rho/data[7]", "number differs"),
        ("ir/spectrum/frequencies", "length differs"), ("ir/spectrum/intensities/1", "value differs"), ("run/log", "bytes differ"),
    }
    s = compare.summary(found, 3).first()
    assert s.difference_count == 7 and s.truncated and len(s.differences) == 3


def test_latest_first_and_compaction(spark):
    rows = spark.createDataFrame([("a", "x", 0, 5), ("a", "manifest.json", 1, 1), ("a", "x", 2, 6), ("a", "y", 3, 1), ("a", "manifest.json", 4, 2)], "archive string, name string, ordinal int, usize int")
    assert {(r.name, r.ordinal) for r in versions.latest(rows, ["archive", "name"], ["ordinal"]).collect()} == {("x", 2), ("y", 3), ("manifest.json", 4)}
    assert {(r.name, r.ordinal) for r in versions.first(rows, ["archive", "name"], ["ordinal"]).collect()} == {("x", 0), ("y", 3), ("manifest.json", 1)}
    members = spark.createDataFrame([("a", "x")], "archive string, path string")
    assert {r.name for r in versions.referenced_entries(rows, members).collect()} == {"x", "manifest.json"}


def test_scrub(spark, tmp_path):
    spec = water() | {"provenance": {"hostname": "h"}, "metadata": {"authors": [{"name": "n", "email": "e"}, {"name": "m"}]}}
    (tmp_path / "x.arc").write_bytes(build(spec))
    arc = A.read_archives(spark, str(tmp_path))
    out, report = versions.scrub_texts(A.members(arc), [r"host\d"], "$x")
    log = out.where("role = 'log'").first()
    assert log.text == "done on $x\n" and log.size == len(log.content) and bytes(log.content) == b"done on $x\n"
    assert {(r.location, r.action, r.matches) for r in report.collect()} == {("run/log", "redact", 1), ("run/files", "skip: not a text of a run", 0)}
    clean, what = versions.scrub_manifests(A.manifests(arc))
    assert "hostname" not in clean.first().manifest and "email" not in clean.first().manifest
    assert {r.location for r in what.collect()} == {"/provenance/hostname", "/metadata/authors/0/email"}


def test_job_status_and_annotation(spark):
    jobs = spark.createDataFrame([("a", "j1"), ("a", "j2"), ("a", "j3")], "archive string, id string")
    runs = spark.createDataFrame([("a", "j1", "failed"), ("a", "j1", "converged"), ("a", "j2", "running")], "archive string, job_ref string, status string")
    assert {r.id: r.status for r in versions.job_status(jobs, runs).collect()} == {"j1": "converged", "j2": "running", "j3": "pending"}
    s = spark.createDataFrame([("a", 0, "j1", "k", "old"), ("a", 1, "j2", "k", "old")], "archive string, section int, id string, kind string, label string")
    notes = spark.createDataFrame([("a", "j1", "new")], "archive string, id string, label string")
    assert {r.id: r.label for r in versions.annotate(s, notes).collect()} == {"j1": "new", "j2": "old"}
    assert [r.id for r in versions.remove_sections(s, notes.select("archive", "id")).collect()] == ["j2"]


def test_operator_parsing_and_groups(spark):
    assert G.parse_operator("-x+1/2, y ,z-1/4") == ([[-1, 0, 0], [0, 1, 0], [0, 0, 1]], [0.5, 0, -0.25])
    with pytest.raises(ValueError):
        G.parse_operator("x,y,w")
    assert len(G.close_group(["-x,-y,z", "-x,y,-z", "z,x,y", "x+1/2,y+1/2,z", "x+1/2,y,z+1/2"])) == 48
    texts = ["x,y,z", "-x,-y,z", "-x,y,-z", "x,-y,-z"]
    assert G.missing_products(G.operators_table(spark, texts)).count() == 0
    assert G.missing_products(G.operators_table(spark, texts[:3])).count() == 2


def test_cell_expansion_merges_special_positions(spark):
    atoms = spark.createDataFrame([("c", 0, 0.0, 0.0, 0.0, "A"), ("c", 1, 0.1, 0.2, 0.3, "B"), ("c", 2, 0.0, 0.0, 0.25, "C")], "crystal string, atom int, fx double, fy double, fz double, symbol string")
    ops = G.operators_table(spark, ["x,y,z", "-x,-y,z", "-x,y,-z", "x,-y,-z"])
    cell = G.expand_cell(atoms, ops, [[10.0, 0, 0], [0, 10.0, 0], [0, 0, 10.0]], ["crystal"]).collect()
    n = {s: sorted(r.op for r in cell if r.symbol == s) for s in "ABC"}
    assert n == {"A": [0], "B": [0, 1, 2, 3], "C": [0, 2]}
    assert {(r.x, r.y, r.z) for r in cell if r.symbol == "B" and r.op == 0} == {(1.0, 2.0, 3.0)}


def test_assembly(spark):
    atoms = spark.createDataFrame([("A", 1.0, 0.0, 0.0), ("B", 0.0, 1.0, 0.0)], "chain string, x double, y double, z double")
    t = spark.createDataFrame([(1, ["A", "B"], np.eye(3).tolist(), [0.0] * 3), (2, ["A"], (-np.eye(3)).tolist(), [0.0, 0.0, 5.0])], "serial int, chains array<string>, rotation array<array<double>>, shift array<double>")
    assert {(r.chain, r.x, r.z) for r in G.assemble(atoms, t).collect()} == {("A", 1.0, 0.0), ("B", 0.0, 0.0), ("A-2", -1.0, 5.0)}


def test_orbital_algebra(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(4, 4))
    s, p = np.eye(4) + 0.1 * (a + a.T) / 2, a @ a.T
    long = lambda m, i, j: spark.createDataFrame([("m", r, c, float(m[r, c])) for r in range(4) for c in range(4)], f"mol string, {i} int, {j} int, value double")
    atom_of = spark.createDataFrame([("m", k, k // 2) for k in range(4)], "mol string, mu int, atom int")
    got = {r.atom: r.electrons for r in G.mulliken(long(p, "mu", "nu"), long(s, "mu", "nu"), atom_of, ["mol"]).collect()}
    want = (p * s).sum(axis=1)
    assert got == pytest.approx({0: want[:2].sum(), 1: want[2:].sum()})
    w, v = np.linalg.eigh(s)
    half = (v * np.sqrt(w)) @ v.T
    diagonal = np.diag(half @ p @ half)
    assert {r.atom: r.electrons for r in G.lowdin(long(p, "mu", "nu"), long(s, "mu", "nu"), atom_of, "mol").collect()} == pytest.approx({0: diagonal[:2].sum(), 1: diagonal[2:].sum()})
    prod = {(r.i, r.j): r.value for r in G.matrix_product(long(p, "i", "j"), long(s, "i", "j"), ["mol"]).collect()}
    assert prod == pytest.approx({(i, j): (p @ s)[i, j] for i in range(4) for j in range(4)})
    d = G.matrix_difference(long(p, "i", "j"), long(s, "i", "j"), ["mol"]).first()
    assert (d.max_abs, d.frobenius) == pytest.approx((abs(p - s).max(), np.linalg.norm(p - s)))


def test_self_overlap_of_a_normalised_shell(spark):
    rows = [("m", 0, 0, 0.5, 1.0), ("m", 1, 1, 0.5, 0.6), ("m", 1, 1, 2.0, 0.5)]
    shells = spark.createDataFrame(rows, "mol string, shell int, l int, exponent double, coefficient double")
    got = {r.shell: r.overlap for r in G.self_overlap(shells, ["mol", "shell"]).collect()}
    assert got[0] == pytest.approx(1.0)
    assert got[1] == pytest.approx(0.36 + 0.25 + 2 * 0.3 * (2 * math.sqrt(1.0) / 2.5) ** 2.5)
    stated = spark.createDataFrame([("m", 0, 1.0), ("m", 1, got[1] * (1 + 1e-5))], "mol string, shell int, stated double")
    assert [r.shell for r in G.normalization_errors(shells, stated, ["mol", "shell"]).collect()] == [1]
    offs = G.ao_offsets(spark.createDataFrame([("m", 0, 1), ("m", 1, 3), ("m", 2, 5)], "mol string, shell int, n int"), ["mol"])
    assert [r.start for r in offs.orderBy("shell").collect()] == [0, 1, 4]
    assert one(spark, G.lattice_volume(F.array(*[F.array(*[F.lit(x) for x in row]) for row in G.cell_vectors(2, 3, 4, 90, 90, 90)]))) == pytest.approx(24)
