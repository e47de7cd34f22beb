"""Text formats: values, round trips, and files that don't parse; streaming validation."""

import pytest

from lodestone.sources import textformats as T
from lodestone.streaming import validation
from tests.fixtures import build, water

XYZ = '2\nLattice="5 0 0 0 5 0 0 0 5" Properties=species:S:1:pos:R:3:forces:R:3 energy=-27.211386245988 pbc="T T F"\nO 0 0 0 1.0 0 0\nH 0.5 0 1 0 0 -1\n2\nplain\nO 0 0 0.1\nH 0 0 1\n'
POSCAR = "salt\n2.0\n1 0 0\n0 1 0\n0 0 2\nNa Cl Na\n1 1 1\nSelective dynamics\nDirect\n0 0 0 T T F\n0.5 0.5 0.5 T T T\n0.25 0 0 F F F\n"
CUBE = "t\nc\n1 0 0 0\n2 0.5 0 0\n2 0 0.5 0\n3 0 0 0.5\n8 8.0 0 0 0.1\n0 1 2\n3 4 5\n6 7 8\n9 10 1.1D1\n"
CHGCAR = "si\n1.0\n2 0 0\n0 2 0\n0 0 2\nSi\n1\nDirect\n0 0 0\n\n2 1 2\n 8 8 4 4\naugmentation occupancies 1 2\n"
PDB = "CRYST1   10.000   10.000   10.000  90.00  90.00  90.00 P 1           1\nMODEL        1\nATOM      1  N   GLY A   1      11.104   6.134  -6.504  1.00  0.00           N\nHETATM    2 CA    CA A   2       1.000   2.000   3.000  1.00  0.00          CA\nENDMDL\n"


@pytest.fixture
def texts(spark):
    return lambda t: spark.createDataFrame([("f", t), ("broken", "?")], "path string, text string")


def test_xyz(spark, texts):
    files = texts(XYZ)
    frames = T.parse(files, "xyz", "frames").orderBy("frame").collect()
    assert [(r.n_atoms, r.energy) for r in frames] == [(2, pytest.approx(-1.0)), (2, None)] and frames[0].pbc == [True, True, False]
    atoms = T.parse(files, "xyz").orderBy("frame", "atom").collect()
    assert atoms[0].gx == pytest.approx(-1 / 27.211386245988 * 0.529177210903) and atoms[2].gx is None and atoms[3].z == 1
    assert [r.path for r in T.parse(files, "xyz", "problems").collect()] == ["broken"]
    again = T.to_xyz(T.parse(files, "xyz"), T.parse(files, "xyz", "frames"))
    back = T.parse(again, "xyz").orderBy("frame", "atom").collect()
    assert [(r.symbol, r.x, r.z_) for r in back] == [(r.symbol, r.x, r.z_) for r in atoms] and back[1].gz == pytest.approx(atoms[1].gz)
    assert [r.path for r in T.parse(texts("1\n\nH 0 0 0\n1\n\nO 0 0 0\n"), "xyz", "problems").orderBy("path").collect()] == ["broken", "f"]


def test_poscar(spark, texts):
    files = texts(POSCAR)
    atoms = T.parse(files, "poscar").orderBy("atom").collect()
    assert [(r.symbol, r.x, r.y, r.z_) for r in atoms] == [("Na", 0, 0, 0), ("Cl", 1, 1, 2), ("Na", 0.5, 0, 0)] and atoms[0].frozen == [False, False, True]
    assert [(r.symbol, r.n) for r in T.species_runs(T.parse(files, "poscar")).orderBy("run").collect()] == [("Na", 1), ("Cl", 1), ("Na", 1)]
    back = T.parse(T.to_poscar(T.parse(files, "poscar"), T.parse(files, "poscar", "frames")), "poscar").orderBy("atom").collect()
    assert [(r.symbol, r.x, r.z_, r.frozen) for r in back] == [(r.symbol, r.x, r.z_, r.frozen) for r in atoms]
    half = T.parse(texts(POSCAR.replace("2.0", "-2.0", 1)), "poscar", "frames").first()
    assert half.lattice[2][2] == pytest.approx(2.0)


def test_grids(spark, texts):
    files = texts(CUBE)
    v = {(r.i, r.j, r.k): r.value for r in T.parse(files, "cube", "voxels").collect()}
    assert v[0, 0, 2] == 2 and v[1, 0, 0] == 6 and v[1, 1, 2] == 11
    assert T.parse(files, "cube", "grids").first().integral == pytest.approx(66 * 0.125)
    back = T.to_cube(T.parse(files, "cube", "grids"), T.parse(files, "cube", "voxels"), T.parse(files, "cube"))
    assert {(r.i, r.j, r.k): r.value for r in T.parse(back, "cube", "voxels").collect()} == v
    assert T.parse(back, "cube").first().z_ == pytest.approx(T.parse(files, "cube").first().z_)
    files = texts(CHGCAR)
    v = {(r.i, r.j, r.k): r.value for r in T.parse(files, "chgcar", "voxels").collect()}
    assert v[1, 0, 0] == v[0, 0, 0] == 2 * v[0, 0, 1]
    assert T.parse(files, "chgcar", "grids").first().integral == pytest.approx(6.0)


def test_pdb(spark, texts):
    atoms = T.parse(texts(PDB), "pdb").orderBy("atom").collect()
    assert [(r.symbol, r.x) for r in atoms] == [("N", 11.104), ("Ca", 1.0)]
    assert T.parse(texts(PDB), "pdb", "frames").first().lattice[1][1] == pytest.approx(10)


CIF = "data_x\n_cell_length_a 4.0(1)\n_cell_length_b 4\n_cell_length_c 4\n_cell_angle_alpha 90\n_cell_angle_beta 90\n_cell_angle_gamma 90\n_title\n;many\nlines\n;\n# note\nloop_\n_symmetry_equiv_pos_as_xyz\n'x, y, z'\n'-x, -y, z'\nloop_\n_atom_site_label\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\nNa1 0.25(2) 0 0\nCl2 0.5 0.5 0.5\n"
MMCIF = "data_m\n_cell.length_a ?\nloop_\n_atom_site.type_symbol\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z\n_atom_site.pdbx_PDB_model_num\nC 1 2 3 1\nO 2 3 4 1\nC 1 2 3.5 2\nO 2 3 4 2\n"
XSF = "CRYSTAL\nPRIMVEC\n3 0 0\n0 3 0\n0 0 3\nPRIMCOORD\n1 1\n14 0 0 0 0.1 0 0\nBEGIN_BLOCK_DATAGRID_3D\nrho\nBEGIN_DATAGRID_3D_rho\n2 1 2\n0 0 0\n3 0 0\n0 3 0\n0 0 3\n1 2\n3 4\nEND_DATAGRID_3D\nEND_BLOCK_DATAGRID_3D\n"
MOLDEN = "[Molden Format]\n[Atoms] AU\nH 1 1 0 0 0\nH 2 1 0 0 1.4\n[GTO]\n1 0\ns 2 1.00\n 3.0 0.5\n 0.5D0 0.6\n\n2 0\np 1 1.0\n 1.0 1.0\n\n[5D]\n[MO]\nSym= a\nEne= -0.5\nSpin= Alpha\nOccup= 2.0\n1 0.7\n2 0.1\nSym= b\nEne= 0.5\nSpin= Alpha\nOccup= 0.0\n1 -0.7\n"


def test_cif_to_unit_cell(spark, texts):
    from lodestone.operators import geometry as G

    files = texts(CIF)
    atoms = T.parse(files, "cif").orderBy("atom").collect()
    assert [(r.symbol, r.x) for r in atoms] == [("Na", pytest.approx(1.0)), ("Cl", pytest.approx(2.0))]
    ops = [r.operator for r in T.parse(files, "cif", "operators").where("path = 'f'").orderBy("op").collect()]
    lattice = [list(v) for v in T.parse(files, "cif", "frames").first().lattice]
    fractions = T.parse(files, "cif").selectExpr("path", "atom", "x / 4 as fx", "y / 4 as fy", "z_ / 4 as fz", "symbol")
    cell = G.expand_cell(fractions, G.operators_table(spark, ops), lattice, ["path"]).collect()
    assert sorted(r.symbol for r in cell) == ["Cl", "Na", "Na"]


def test_mmcif_xsf_molden(spark, texts):
    frames = T.parse(texts(MMCIF), "mmcif", "frames").orderBy("frame").collect()
    assert [(r.n_atoms, r.lattice) for r in frames] == [(2, None), (2, None)]
    assert [r.z_ for r in T.parse(texts(MMCIF), "mmcif").orderBy("frame", "atom").collect()] == [3, 4, 3.5, 4]
    v = {(r.i, r.j, r.k): r.value for r in T.parse(texts(XSF), "xsf", "voxels").collect()}
    assert v == {(0, 0, 0): 1, (1, 0, 0): 2, (0, 0, 1): 3, (1, 0, 1): 4}
    a = T.parse(texts(XSF), "xsf").first()
    assert a.symbol == "Si" and a.gx == pytest.approx(-0.1 * 0.529177210903)
    shells = T.parse(texts(MOLDEN), "molden", "shells").orderBy("shell").collect()
    assert [(s.centre, s.l, list(s.exponents)) for s in shells] == [(0, 0, [3.0, 0.5]), (1, 1, [1.0])]
    assert [(o.energy, o.occupation) for o in T.parse(texts(MOLDEN), "molden", "orbitals").orderBy("mo").collect()] == [(-0.5, 2), (0.5, 0)]
    assert {(c.mo, c.ao): c.value for c in T.parse(texts(MOLDEN), "molden", "coefficients").collect()} == {(0, 0): 0.7, (0, 1): 0.1, (1, 0): -0.7}
    assert T.parse(texts(MOLDEN), "molden").orderBy("atom").collect()[1].z_ == pytest.approx(1.4 * 0.529177210903)
    for p in T.PARSERS:
        assert {r.path for r in T.parse(texts(""), p, "problems").collect()} == {"f", "broken"}


def test_cif_and_pdb_round_trips(spark, texts):
    atoms, frames = T.parse(texts(POSCAR), "poscar"), T.parse(texts(POSCAR), "poscar", "frames")
    want = [(r.symbol, r.x, r.y, r.z_) for r in atoms.orderBy("atom").collect()]
    for write, parser in ((T.to_cif, "cif"), (T.to_pdb, "pdb")):
        text = write(atoms, frames)
        back = [(r.symbol, r.x, r.y, r.z_) for r in T.parse(text, parser).orderBy("atom").collect()]
        assert [b[0] for b in back] == [w[0] for w in want] and [x for b in back for x in b[1:]] == pytest.approx([x for w in want for x in w[1:]], abs=1e-3)
        assert T.parse(text, parser, "frames").first().lattice[2][2] == pytest.approx(4.0)


def test_omitted_sections(spark):
    s = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "archive string, id string")
    assert [(r.archive, r.omitted) for r in T.omitted_sections(s, s.where("id in ('x', 'z')")).collect()] == [("a", ["y"])]


def test_stream_validates_what_arrives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.arc").write_bytes(build(water()))
    run = lambda: validation.validate_stream(validation.arriving(spark, str(tmp_path / "in"), "*.arc"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    (tmp_path / "in/b.arc").write_bytes(b"nothing")
    run()
    got = {r.archive.rsplit("/", 1)[1]: r.ok for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a.arc": True, "b.arc": False}


def test_latest_versions_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("j", "2024-01-01 00:00:00", 1, "pending"), ("j", "2024-01-01 00:05:00", 2, "running"), ("k", "2024-01-01 00:01:00", 1, "pending")], "job string, at string, version int, status string").selectExpr("job", "cast(at as timestamp) as at", "version", "status").write.parquet(str(tmp_path / "u"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "u")).schema).parquet(str(tmp_path / "u"))
    q = validation.latest_versions(stream, ["job"]).writeStream.outputMode("update").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.job, r.version) for r in spark.sql("select * from latest").collect()} == {("j", 2), ("k", 1)}


def test_oversized_files_are_problems(spark, tmp_path, monkeypatch):
    (tmp_path / "a.xyz").write_text("1\nx\nH 0 0 0\n")
    (tmp_path / "b.xyz").write_text("1\nx\nH 0 0 0\n" + " " * 100)
    monkeypatch.setattr(T, "MOST_CHARS", 50)
    files = T.read_texts(spark, str(tmp_path))
    assert T.parse(files, "xyz").count() == 1
    (r,) = T.parse(files, "xyz", "problems").collect()
    assert r.path.endswith("b.xyz") and r.problem.startswith("larger than")


def test_shared_folder_is_needed_beyond_one_machine():
    from lodestone.sources import tables

    class Cluster:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://head:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Cluster)


def test_durable_tables_are_released(spark):
    from lodestone.sources import tables

    rows = tables.durable(spark.range(5), "five")
    assert rows.count() == 5
    assert tables.release(spark) and not tables.release(spark)
