"""Rules of wavefunctions, Bloch orbitals, transition orbitals and excited states, each on a broken archive."""

import copy
import math

import numpy as np
import pytest

from lodestone.functions.scalars import component_factors
from lodestone.operators.rules import Corpus
from lodestone.sources import archives as A
from pyspark.sql import functions as F
from tests.fixtures import build, water

WAVE, BLOCH, HOLE, PARTICLE, STATES, PEAKS, DENSITY = range(4, 11)


def overlap_of(shell):
    a, c = shell["exponents"], shell["coefficients"]
    return sum(x * y * (2 * math.sqrt(p * q) / (p + q)) ** (shell["l"] + 1.5) for p, x in zip(a, c) for q, y in zip(a, c))


S = {"l": 0, "exponents": [1.2, 0.3], "coefficients": [0.6, 0.5]}
D = {"l": 2, "pure": False, "exponents": [0.8], "coefficients": [1.1]}
#: Self-overlaps of xx, xy, xz, yy, yz, zz over that of xx.
CARTESIAN_D = [1.0, 1 / 3, 1 / 3, 1.0, 1 / 3, 1.0]


def nto(role):
    block = {"energies": [0.1, 0.2], "occupations": [0.7, 0.3], "n_mo": 2}
    return {"id": role, "kind": "wavefunction.gto", "members": {
        "basis": {"n_ao": 3}, "mo_coefficients_alpha": np.zeros((2, 3)), "mo_coefficients_beta": np.zeros((2, 3)),
        "mo_metadata": {"orbital_kind": "nto", "spin": "unrestricted", "nto_role": role, "state_ref": "ex", "state_index": 1, "occupation_semantics": "transition_weight", "alpha": dict(block), "beta": dict(block)}}}


def whole():
    """A sound archive with a section of each kind; the sections' places are named above."""
    spec = water()
    crystal = {"id": "cell", "kind": "structure", "members": {"structure": {"atoms": [], "pbc": [True, True, True], "lattice_vectors": np.eye(3).tolist()}}}
    overlap = np.diag([overlap_of(S)] + [overlap_of(D) * f for f in CARTESIAN_D])
    spec["sections"] += [
        {"id": "wave", "kind": "wavefunction.gto", "members": {
            "basis": {"shells": [S, D], "n_electrons": 2}, "mo_coefficients": np.zeros((3, 7)), "overlap": overlap, "density_matrix": np.zeros((7, 7)),
            "mo_metadata": {"occupations": [2.0, 0.0, 0], "energies": [1, 2, 3], "symmetry_labels": ["a", "b", "c"]}}},
        {"id": "bloch", "kind": "wavefunction.bloch", "structure_ref": "cell", "members": {
            "basis": {"n_ao": 4}, "kpoints": {"kpoints": [[0, 0, 0], [0.5, 0, 0]], "weights": [0.5, 0.5], "labels": ["G", "X"]},
            "mo_metadata": {"spin": "restricted", "n_spin": 1, "n_mo": 3, "n_ao": 4, "n_mo_per_k": [3, 2]},
            "mo_coefficients": np.zeros((2, 1, 3, 4, 2)), "energies": np.zeros((2, 1, 3)), "occupations": np.zeros((2, 1, 3))}},
        nto("hole"), nto("particle"),
        {"id": "ex", "kind": "excited_states", "wavefunction_ref": "wave", "members": {"states": {
            "meta": {"n_states": 2}, "states": [{"index": 1, "nto_ref": "hole", "density_ref": "td", "contributions": [{"from_mo": 0, "to_mo": 2}]}, {"index": 4}]}}},
        {"id": "uv", "kind": "spectra.uvvis", "members": {"spectrum": {"states_ref": "ex", "peaks": [{"assignment": {"state_index": 4}}, {}]}}},
        {"id": "td", "kind": "volume.transition_density", "excited_states_ref": "ex", "state_index": 1, "members": {"grid": {}, "data": np.zeros((2, 2, 2))}},
        crystal,
    ]
    return spec


def edited(edit):
    spec = copy.deepcopy(whole())
    edit([s["members"] for s in spec["sections"]], spec["sections"], spec)
    return build(spec)


def states(m):
    return m[STATES]["states"]["states"]


MALFORMED, GONE, ROOT, NORM, SCHEMA = {"E_MEMBER_MALFORMED"}, {"E_REF_UNRESOLVED"}, {"E_ROOT_INCONSISTENT"}, {"E_NORMALIZATION"}, {"E_SCHEMA"}
CASES = {
    "sound": (edited(lambda m, s, r: None), set()),
    "complex_rank": (edited(lambda m, s, r: m[WAVE]["mo_metadata"].update(complex=True)), MALFORMED),
    "complex_good": (edited(lambda m, s, r: (m[WAVE]["mo_metadata"].update(complex=True), m[WAVE].update(mo_coefficients=np.zeros((3, 7, 2))))), set()),
    "real_rank": (edited(lambda m, s, r: m[WAVE].update(mo_coefficients=np.zeros((3, 7, 2)))), MALFORMED),
    "encoding": (edited(lambda m, s, r: m[WAVE]["mo_metadata"].update(coefficient_encoding="complex_split_last_axis")), MALFORMED),
    "complex_text": (edited(lambda m, s, r: m[WAVE]["mo_metadata"].update(complex="yes")), set()),
    "labels": (edited(lambda m, s, r: m[WAVE]["mo_metadata"].update(symmetry_labels=["a"])), MALFORMED),
    "labels_beta": (edited(lambda m, s, r: m[HOLE]["mo_metadata"]["beta"].update(symmetry_labels=["a"])), MALFORMED),
    "density_size": (edited(lambda m, s, r: m[WAVE].update(density_matrix=np.zeros((6, 6)))), MALFORMED),
    "density_layout": (edited(lambda m, s, r: m[HOLE].update(density_matrix=np.zeros((3, 3)))), MALFORMED),
    "density_alone": (edited(lambda m, s, r: m[HOLE].update(density_matrix_alpha=np.zeros((3, 3)))), MALFORMED),
    "density_spin": (edited(lambda m, s, r: m[WAVE].update(density_matrix_alpha=np.zeros((7, 7)))), MALFORMED),
    "electrons": (edited(lambda m, s, r: m[WAVE]["basis"].update(n_electrons=3)), MALFORMED),
    "electrons_text": (edited(lambda m, s, r: (m[WAVE]["basis"].update(n_electrons=3), m[WAVE]["mo_metadata"].update(occupations=[2, "x", 0]))), set()),
    "electrons_weights": (edited(lambda m, s, r: m[HOLE]["basis"].update(n_electrons=9)), set()),
    "electrons_root": (edited(lambda m, s, r: r.update(provenance={"n_electrons": 4})), ROOT),
    "overlap": (edited(lambda m, s, r: m[WAVE].update(overlap=np.eye(7))), NORM),
    "overlap_one": (edited(lambda m, s, r: m[WAVE]["overlap"].__setitem__((2, 2), 0.5)), NORM),
    "overlap_off_diagonal": (edited(lambda m, s, r: m[WAVE]["overlap"].__setitem__((2, 3), 0.5)), set()),
    "overlap_pure": (edited(lambda m, s, r: m[WAVE]["basis"].update(shells=[S, D | {"pure": True}])), MALFORMED),
    "overlap_unusable": (edited(lambda m, s, r: (m[WAVE].update(overlap=np.eye(7)), m[WAVE]["basis"].update(shells=[S | {"coefficients": [1.0]}, D | {"exponents": [-1.0]}]))), set()),
    "bloch_coefficients": (edited(lambda m, s, r: m[BLOCH].update(mo_coefficients=np.zeros((2, 1, 3, 4, 3)))), MALFORMED),
    "bloch_energies": (edited(lambda m, s, r: m[BLOCH].update(energies=np.zeros((2, 1, 2)))), MALFORMED),
    "bloch_points": (edited(lambda m, s, r: m[BLOCH]["kpoints"].update(kpoints=[[0, 0, 0]], weights=[1.0], labels=["G"])), MALFORMED),
    "bloch_labels": (edited(lambda m, s, r: m[BLOCH]["kpoints"].update(labels=["G"])), MALFORMED),
    "bloch_spin": (edited(lambda m, s, r: m[BLOCH]["mo_metadata"].update(spin="unrestricted")), MALFORMED),
    "bloch_per_k": (edited(lambda m, s, r: m[BLOCH]["mo_metadata"].update(n_mo_per_k=[4, 1])), MALFORMED),
    "bloch_functions": (edited(lambda m, s, r: m[BLOCH]["basis"].update(n_ao=5)), MALFORMED),
    "bloch_molecule": (edited(lambda m, s, r: s[BLOCH].update(structure_ref="mol")), MALFORMED),
    "bloch_inner": (edited(lambda m, s, r: (s[BLOCH].pop("structure_ref"), m[BLOCH]["basis"].update(structure_ref="cell"))), set()),
    "bloch_nowhere": (edited(lambda m, s, r: s[BLOCH].pop("structure_ref")), GONE),
    "states_count": (edited(lambda m, s, r: m[STATES]["states"].update(meta={"n_states": 3})), MALFORMED),
    "states_orbital": (edited(lambda m, s, r: states(m)[0]["contributions"][0].update(to_mo=3)), MALFORMED),
    "states_negative": (edited(lambda m, s, r: states(m)[0]["contributions"][0].update(from_mo=-1)), MALFORMED),
    "states_nto": (edited(lambda m, s, r: states(m)[1].update(nto_ref="td")), GONE),
    "states_density": (edited(lambda m, s, r: states(m)[1].update(density_ref=None)), GONE),
    "peak": (edited(lambda m, s, r: m[PEAKS]["spectrum"]["peaks"].append({"assignment": {"state_index": 2}})), GONE),
    "density_state": (edited(lambda m, s, r: s[DENSITY].update(state_index=2)), GONE),
    "nto_rows": (edited(lambda m, s, r: m[HOLE]["mo_metadata"]["alpha"].update(n_mo=3)), MALFORMED),
    "nto_missing": (edited(lambda m, s, r: [m[k].pop("mo_coefficients_beta") for k in (HOLE, PARTICLE)]), MALFORMED),
    "nto_state": (edited(lambda m, s, r: [m[k]["mo_metadata"].update(state_index=3) for k in (HOLE, PARTICLE)]), GONE),
    "nto_alone": (edited(lambda m, s, r: m[PARTICLE]["mo_metadata"].update(state_index=4)), GONE),
    "nto_twice": (edited(lambda m, s, r: s.append(nto("particle") | {"id": "third"})), GONE),
    "nto_layout": (edited(lambda m, s, r: m[PARTICLE]["mo_metadata"].update(spin="restricted")), MALFORMED),
    "nto_weights": (edited(lambda m, s, r: m[PARTICLE]["mo_metadata"]["alpha"].update(occupations=[0.7, 0.2])), MALFORMED),
    "nto_extents": (edited(lambda m, s, r: (m[PARTICLE].update(mo_coefficients_beta=np.zeros((3, 3))), m[PARTICLE]["mo_metadata"].update(beta={}))), MALFORMED),
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("orbitals")
    for name, (data, _) in CASES.items():
        (d / f"{name}.arc").write_bytes(data)
    rows = Corpus(A.read_archives(spark, str(d), "*.arc")).stored().findings().collect()
    return {n: [r for r in rows if r.archive.endswith(f"/{n}.arc")] for n in CASES}


@pytest.mark.parametrize("name", CASES)
def test_findings(found, name):
    assert {r.code for r in found[name]} == CASES[name][1], found[name]


def test_normalization_says_how_many_and_where(found):
    (one,) = found["overlap_one"]
    assert one.message == "1 of 7 self-overlaps aren't those of the basis, first at function 2" and one.location.endswith("/members/overlap")


def test_component_factors(spark):
    got = spark.createDataFrame([(2, False), (1, False), (0, False), (3, True)], "l int, pure boolean").select(component_factors(F.col("l"), F.col("pure")).alias("f")).collect()
    assert [r.f for r in got] == [pytest.approx(CARTESIAN_D), [1.0] * 3, [1.0], [1.0] * 7]
