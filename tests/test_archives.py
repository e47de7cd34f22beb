"""Archive tables, rules, and writing, on archives made here."""

import copy
import io
import json
import warnings
import zipfile

import numpy as np
import pytest

from lodestone.operators.rules import Corpus, Limits
from lodestone.sources import archives as A
from tests.fixtures import VERSION_KEY, build, water


def section(spec, sid):
    return next(s for s in spec["sections"] if s["id"] == sid)


def edited(edit):
    spec = water()
    edit(spec)
    if any(x["kind"] == "reaction.scheme" for x in spec["sections"]):
        spec["sections"].append(copy.deepcopy(spec["sections"][0]) | {"id": "mol2"})
    return build(spec)


def member(m, sid, role):
    return next(s for s in m["sections"] if s["id"] == sid)["members"][role]


def with_entry(data, name, content):
    out = io.BytesIO(data)
    with warnings.catch_warnings(), zipfile.ZipFile(out, "a") as z:
        warnings.simplefilter("ignore")
        z.writestr(name, content)
    return out.getvalue()


def excited(order):
    return {"id": "ex", "kind": "excited_states", "members": {"states": {"states": [{"index": k} for k in order]}}}


stiff = np.eye(6).tolist()
skew = np.eye(6)
skew[0, 1] = 0.5

def scheme(value, product="mol"):
    terms = [{"structure_ref": "mol2", "coefficient": -1, "energy_eh": -1.0}, {"structure_ref": product, "coefficient": 1, "energy_eh": -2.0}]
    step = {"id": "s", "reactants": [{"structure_ref": "mol2"}], "products": [{"structure_ref": product}], "energies": {"terms": terms, "deltas": {"energy": {"value_eh": value, "kcal_mol": value * 627.509474}}}}
    return {"id": "rx", "kind": "reaction.scheme", "members": {"scheme": {"steps": [step]}}}


#: name -> (archive, codes it must have and no others)
CASES = {
    "sound": (build(water()), set()),
    "not_a_zip": (b"not a zip", {"E_ZIP_UNREADABLE"}),
    "no_manifest": ((lambda b: (zipfile.ZipFile(b, "w").writestr("x", "y"), b.getvalue())[1])(io.BytesIO()), {"E_ZIP_UNREADABLE"}),
    "bad_json": (build(water(), change=lambda m: None, manifest="{nope"), {"E_MANIFEST_JSON"}),
    "deep": (build(water(), change=lambda m: m.update(x=json.loads("[" * 70 + "]" * 70))), {"E_JSON_TOO_DEEP"}),
    "version_3": (build(water(), change=lambda m: m.update({VERSION_KEY: 3})), {"E_VERSION"}),
    "version_2": (build(water(), change=lambda m: m.update({VERSION_KEY: 2})), {"W_VERSION_WITHDRAWN"}),
    "order_big": (build(water(), change=lambda m: m.update(byte_order="big")), {"E_SCHEMA"}),
    "order_number": (build(water(), change=lambda m: m.update(byte_order=1)), {"E_SCHEMA"}),
    "order_absent": (build(water(), change=lambda m: m.pop("byte_order")), set()),
    "source": (build(water(), change=lambda m: m["source"].pop("program")), {"E_SOURCE"}),
    "orphan": (build(water(), raw=[("left/over", b"x"), ("left/", b"")]), {"W_ORPHAN_MEMBER"}),
    "superseded": (with_entry(build(water()), "manifest.json", zipfile.ZipFile(io.BytesIO(build(water()))).read("manifest.json")), {"W_ORPHAN_MEMBER"}),
    "twice": (with_entry(build(water()), "s0/bonds", b"{}"), {"E_ZIP_DUPLICATE_ENTRY", "E_SHA256_MISMATCH", "E_BINARY_SIZE"}),
    "path": (build(water(), raw=[("../up", b"x")]), {"E_MEMBER_PATH", "W_ORPHAN_MEMBER"}),
    "missing": (build(water(), change=lambda m: member(m, "ir", "spectrum").update(path="gone")), {"E_MEMBER_MISSING", "W_ORPHAN_MEMBER"}),
    "size": (build(water(), change=lambda m: member(m, "ir", "spectrum").update(size=1)), {"E_BINARY_SIZE"}),
    "sha": (build(water(), change=lambda m: member(m, "ir", "spectrum").update(sha256="0" * 64)), {"E_SHA256_MISMATCH"}),
    "dtype": (build(water(), change=lambda m: member(m, "rho", "data").update(dtype="float16")), {"E_DTYPE", "E_SCHEMA"}),
    "shape": (build(water(), change=lambda m: member(m, "rho", "data").update(shape=[2, 2, 3])), {"E_BINARY_SIZE"}),
    "shape_kind": (build(water(), change=lambda m: member(m, "rho", "data").update(shape=[2, "2", 2])), {"E_MEMBER_MALFORMED"}),
    "utf8": (edited(lambda s: section(s, "run")["members"].update(log=b"\xff\xfe")), {"E_UTF8"}),
    "json": (build(water(), change=lambda m: member(m, "run", "log").update(format="json")), {"E_JSON_INVALID"}),
    "id_twice": (edited(lambda s: section(s, "ir").update(id="mol")), {"E_SECTION_ID_DUPLICATE"}),
    "reserved": (edited(lambda s: section(s, "ir").update(id="camera")), {"E_RESERVED_ID"}),
    "kind": (edited(lambda s: section(s, "ir").update(kind="spectra.xx")), {"E_KIND_UNKNOWN"}),
    "vendor": (edited(lambda s: section(s, "ir").update(kind="x_lab.thing")), set()),
    "critical": (edited(lambda s: section(s, "ir").update(kind="x_lab.thing", critical=True)), {"E_CRITICAL_UNDECLARED"}),
    "id_number": (build(water(), change=lambda m: m["sections"][2].update(id=5)), {"E_SECTION_MALFORMED"}),
    "ref_gone": (edited(lambda s: section(s, "rho").update(structure_ref="nobody")), {"E_REF_UNRESOLVED"}),
    "ref_kind": (edited(lambda s: section(s, "rho").update(structure_ref="ir")), {"E_REF_UNRESOLVED"}),
    "ref_required": (edited(lambda s: s["sections"].append({"id": "w", "kind": "reaction.waypoints", "members": {"waypoints": {}}})), {"E_REF_UNRESOLVED"}),
    "ref_payload": (edited(lambda s: section(s, "rho")["members"]["grid"].update(structure_ref="ir")), {"E_REF_UNRESOLVED"}),
    "pbc": (edited(lambda s: section(s, "mol")["members"]["structure"].update(pbc=[True, False, False])), {"E_STRUCTURE_PERIODICITY"}),
    "pbc_two": (edited(lambda s: section(s, "mol")["members"]["structure"].update(pbc=[True, False])), {"E_STRUCTURE_PERIODICITY"}),
    "lattice": (edited(lambda s: (section(s, "mol")["members"]["structure"].pop("pbc"), section(s, "mol")["members"]["structure"].update(lattice_vectors=[[1, 0, 0], [0, 1, 0], [0, 0, 1]]))), {"E_STRUCTURE_PERIODICITY"}),
    "parity": (edited(lambda s: section(s, "mol").update(multiplicity=2)), {"E_CHARGE_MULTIPLICITY"}),
    "charge": (edited(lambda s: section(s, "mol").update(charge=11)), {"E_CHARGE_MULTIPLICITY"}),
    "bond": (edited(lambda s: section(s, "mol")["members"]["bonds"]["pairs"].append({"i": 0, "j": 3})), {"E_MEMBER_MALFORMED"}),
    "spectrum": (edited(lambda s: section(s, "ir")["members"]["spectrum"].update(intensities=[1.0])), {"E_PAYLOAD_SCHEMA"}),
    "spectrum_x": (edited(lambda s: (section(s, "ir")["members"]["spectrum"].pop("intensities"), section(s, "ir")["members"]["spectrum"].update(x=[1.0]))), {"E_PAYLOAD_SCHEMA"}),
    "files": (edited(lambda s: section(s, "run")["members"]["files"].update(other={})), {"E_FILES_INDEX"}),
    "unit": (edited(lambda s: section(s, "rho")["members"]["grid"].update(units={"origin": "furlong"})), {"W_UNIT_UNKNOWN"}),
    "unit_root": (edited(lambda s: s.update(provenance={"cutoff": {"value": 3, "units": "parsec"}, "ok": {"value": 3, "units": "Eh"}, "n": 4})), {"W_UNIT_UNKNOWN"}),
    "states": (edited(lambda s: s["sections"].append(excited([1, 3, 2]))), {"E_MEMBER_MALFORMED"}),
    "states_good": (edited(lambda s: s["sections"].append(excited([1, 2, 5]))), set()),
    "elastic": (edited(lambda s: s["sections"].append({"id": "el", "kind": "properties.elastic", "members": {"properties": {"stiffness": skew.tolist()}}})), {"E_MEMBER_MALFORMED"}),
    "elastic_good": (edited(lambda s: s["sections"].append({"id": "el", "kind": "properties.elastic", "members": {"properties": {"stiffness": stiff}}})), set()),
    "weights": (edited(lambda s: s["sections"].append({"id": "b", "kind": "wavefunction.bloch", "members": {"kpoints": {"weights": [0.5, 0.4]}}})), {"E_MEMBER_MALFORMED", "E_SCHEMA"}),
    "role_missing": (edited(lambda s: section(s, "rho")["members"].pop("data")), {"E_SCHEMA"}),
    "role_rank": (edited(lambda s: section(s, "rho")["members"].update(data=np.zeros(8))), {"E_SCHEMA"}),
    "bands": (edited(lambda s: s["sections"].append({"id": "bs", "kind": "bands", "members": {"kpath": {}, "eigenvalues": np.zeros((1, 3, 2)), "occupations": np.zeros((1, 3, 3))}})), {"E_MEMBER_MALFORMED"}),
    "trajectory": (edited(lambda s: s["sections"].append({"id": "t", "kind": "trajectory", "members": {"metadata": {"energies": [1.0, 2.0]}, "coords": np.zeros((2, 3, 3)), "energies": np.array([1.0, 2.5])}})), {"E_MEMBER_MALFORMED"}),
    "trajectory_good": (edited(lambda s: s["sections"].append({"id": "t", "kind": "trajectory", "members": {"metadata": {"energies": [1.0, 2.0]}, "coords": np.zeros((2, 3, 3)), "energies": np.array([1.0, 2.0]), "velocities": np.zeros((2, 3, 3))}})), set()),
    "trajectory_times": (edited(lambda s: s["sections"].append({"id": "t", "kind": "trajectory", "members": {"metadata": {}, "coords": np.zeros((2, 3, 3)), "times": np.zeros(3)}})), {"E_MEMBER_MALFORMED"}),
    "forces": (edited(lambda s: s["sections"].append({"id": "f", "kind": "forces", "members": {"gradient": np.zeros((4, 3))}})), {"E_MEMBER_MALFORMED"}),
    "forces_good": (edited(lambda s: s["sections"].append({"id": "f", "kind": "forces", "structure_ref": "mol", "members": {"gradient": np.zeros((3, 3)), "stress": np.zeros((3, 3))}})), set()),
    "hessian": (edited(lambda s: s["sections"].append({"id": "h", "kind": "hessian", "members": {"matrix": np.zeros((10, 10))}})), {"E_MEMBER_MALFORMED"}),
    "vector": (edited(lambda s: s["sections"].append({"id": "v", "kind": "volume.vector", "members": {"grid": {}, "data": np.zeros((2, 2, 2, 4))}})), {"E_MEMBER_MALFORMED"}),
    "grid_periodic": (edited(lambda s: section(s, "rho")["members"]["grid"].update(periodic=[True, False, False], voxel_vectors=[[1, 0, 0], [0, 1, 0], [0, 0, 1]])), {"E_MEMBER_MALFORMED"}),
    "dielectric": (edited(lambda s: s["sections"].append({"id": "d", "kind": "properties.dielectric", "members": {"properties": {"electronic": np.eye(3).tolist(), "ionic": np.eye(3).tolist(), "static": np.eye(3).tolist(), "born_charges": [1, 2, 3]}}})), {"E_MEMBER_MALFORMED"}),
    "dipole": (edited(lambda s: (s.update(dipole_moment={"vector_debye": [0, 0, 1], "total_debye": 1}), s["sections"].append({"id": "e", "kind": "properties.electric", "members": {"properties": {"dipole": {"vector": [0, 0, 1.1], "total": 1}}}}))), {"E_ROOT_INCONSISTENT"}),
    "energies": (edited(lambda s: s.update(provenance={"method": "HF", "scf_energy": {"value": -27.211386245988, "units": "eV"}}, energies={"method": "hf", "total": {"value": -1.1, "units": "Hartree"}})), {"E_ROOT_INCONSISTENT"}),
    "energies_good": (edited(lambda s: s.update(provenance={"method": "HF", "scf_energy": {"value": -27.211386245988, "units": "eV"}, "charge": 0}, energies={"method": "hf", "total": {"value": -1.0, "units": "Hartree"}})), set()),
    "identity": (edited(lambda s: s.update(provenance={"charge": 2})), {"E_ROOT_INCONSISTENT"}),
    "reaction": (edited(lambda s: s["sections"].append(scheme(-1.5))), {"E_MEMBER_MALFORMED"}),
    "reaction_good": (edited(lambda s: s["sections"].append(scheme(-1.0))), set()),
    "reaction_ref": (edited(lambda s: s["sections"].append(scheme(-1.0, "ir"))), {"E_REF_UNRESOLVED"}),
    "custom": (edited(lambda s: s["sections"].append({"id": "a", "kind": "atom_properties", "members": {"meta": {"custom.a": {}}, "custom.a": np.zeros(3), "custom.b": np.zeros(3)}})), {"E_MEMBER_MALFORMED"}),
    "nto": (edited(lambda s: s["sections"].append({"id": "n", "kind": "wavefunction.gto", "members": {"basis": {}, "mo_metadata": {"orbital_kind": "nto", "spin": "unrestricted", "nto_role": "hole", "alpha": {"occupations": [0.5, 0.6]}}}})), {"E_MEMBER_MALFORMED"}),
    "preview": (edited(lambda s: s["sections"].append({"id": "p", "kind": "preview", "members": {"thumbnail": b"GIF89a"}})), {"E_MEMBER_MALFORMED"}),
    "preview_good": (edited(lambda s: s["sections"].append({"id": "p", "kind": "preview", "members": {"thumbnail": b"\x89PNG\r\n\x1a\n..."}})), set()),
}
CASES["no_manifest"] = (CASES["no_manifest"][0], {"E_MANIFEST_MISSING"})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("archives")
    for name, (data, _) in CASES.items():
        (d / f"{name}.arc").write_bytes(data)
    return d


@pytest.fixture(scope="module")
def corpus(spark, folder):
    return Corpus(A.read_archives(spark, str(folder), "*.arc")).stored()


def stem(path):
    return path.rsplit("/", 1)[1].removesuffix(".arc")


def test_findings_of_each_broken_archive(corpus):
    got = {name: set() for name in CASES}
    for r in corpus.findings().collect():
        got[stem(r.archive)].add(r.code)
        assert r.severity == ("warning" if r.code.startswith("W_") else "error")
    assert got == {name: codes for name, (_, codes) in CASES.items()}


def test_report_counts_and_levels(corpus):
    got = {stem(r.archive): r for r in corpus.report().collect()}
    assert set(got) == set(CASES)
    assert got["sound"].ok and got["sound"].n_sections == 4 and got["orphan"].ok and got["orphan"].n_warnings == 1
    assert not got["ref_gone"].ok and got["not_a_zip"].n_sections == 0
    low = {stem(r.archive): r.ok for r in corpus.report("manifest").collect()}
    assert low["ref_gone"] and low["sha"] and not low["kind"]


def test_limits(spark, folder):
    small = Corpus(A.read_archives(spark, str(folder), "sound.arc"), Limits(most_entry_bytes=100, most_total_bytes=500))
    assert {r.code for r in small.findings("container").collect()} == {"E_MEMBER_TOO_LARGE", "E_TOTAL_TOO_LARGE"}


def test_tables_of_a_sound_archive(spark, folder):
    arc = A.read_archives(spark, str(folder), "sound.arc")
    assert A.entries(arc).count() == 8
    assert [r.role for r in A.members(arc).orderBy("section", "role_ordinal").collect()] == ["structure", "bonds", "grid", "data", "spectrum", "log", "files"]
    values = A.tensors(A.members(arc, ["volume.density"])).orderBy("flat").collect()
    assert [(list(r.idx), r.value) for r in values][:3] == [([0, 0, 0], 0.0), ([0, 0, 1], 1.0), ([0, 1, 0], 2.0)] and len(values) == 8
    assert A.members(arc, payloads=False).where("size is not null").count() == 0


def test_repack_and_extract(spark, folder, tmp_path):
    arc = A.read_archives(spark, str(folder), "{orphan,superseded,not_a_zip}.arc")
    out = A.repack(arc, str(tmp_path / "out")).collect()
    assert sorted(r.archive for r in out) == ["orphan.arc", "superseded.arc"]
    for r in out:
        names = zipfile.ZipFile(r.path).namelist()
        assert len(names) == len(set(names)) == 8 and names[-1] == "manifest.json"
    assert [bytes(r.content) for r in A.extract(A.read_archives(spark, str(folder), "sound.arc"), "run", "log").collect()] == [b"done on host7\n"]
    assert A.extract(A.read_archives(spark, str(folder), "sha.arc"), "ir", "spectrum").count() == 0


def test_duplicate_keys_and_nan_in_manifests(spark, tmp_path):
    text = '{"%s": 1, "a": NaN, "source": {"program": "x"}, "source": {"program": "p", "version": "1", "calculation": "c"}, "sections": []}' % VERSION_KEY
    (tmp_path / "x.arc").write_bytes(build({"sections": []}, manifest=text))
    assert Corpus(A.read_archives(spark, str(tmp_path))).findings().count() == 0


def test_written_archives_validate_clean(spark, tmp_path):
    z = zipfile.ZipFile(io.BytesIO(build(water())))
    rows = [(f"{k}.arc", n, z.read(n)) for k in range(3) for n in z.namelist()]
    parts = spark.createDataFrame(rows, "archive string, name string, content binary")
    out = A.write_archives(parts, str(tmp_path / "out")).collect()
    assert len(out) == 3
    assert Corpus(A.read_archives(spark, str(tmp_path / "out"))).findings().count() == 0
    with pytest.raises(Exception):
        A.write_archives(parts, str(tmp_path / "out")).collect()  # never over an existing file
    assert zipfile.ZipFile(out[0].path).namelist()[-1] == "manifest.json"
