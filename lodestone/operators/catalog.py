"""Fixed tables: section kinds with their members, reserved ids, finding codes."""

from __future__ import annotations

#: Kind -> roles; "!" marks required ones, then the format, element types and rank bounds of binary members.
_VOLUME = "grid! json; data! float32|float64 3-3"
_SPECTRUM = "spectrum! json"
KINDS = {
    "structure": "structure! json; bonds json",
    "bonds": "bonds! json",
    "bond_orders": "bond_orders! json",
    **{f"volume.{k}": _VOLUME for k in ("density", "orbital", "spin", "elf", "difference", "potential", "rdg", "generic", "laplacian", "transition_density")},
    "volume.vector": "grid! json; data! float32|float64 4-4",
    "volume.complex": "grid! json; data! float32|float64 4-4",
    "volume.series": "grid! json; data! float32|float64 4-4; axis! json",
    "wavefunction.gto": "basis! json; mo_metadata! json; mo_coefficients float64 2-3; mo_coefficients_alpha float64 2-3; mo_coefficients_beta float64 2-3; overlap float64 2-2; density_matrix float64 2-2; density_matrix_alpha float64 2-2; density_matrix_beta float64 2-2",
    "wavefunction.bloch": "basis! json; kpoints! json; mo_metadata! json; mo_coefficients! float64 5-5; energies! float64 3-3; occupations! float64 3-3",
    "basis.ao": _VOLUME,
    "atom_properties": "meta json",
    "trajectory": "metadata! json; coords! float32|float64 3-3; lattice float64 2-3; velocities float64 3-3; gradient float64 3-3; times float64 1-1; energies float64 1-1; cell_volumes float64 1-1; temperatures float64 1-1",
    "reaction.path": "metadata! json; coords! float32|float64 3-3; frame_volumes float32|float64 4-4; volume_grid json; lattice float64 2-3; velocities float64 3-3; gradient float64 3-3; times float64 1-1; energies float64 1-1",
    "reaction.waypoints": "waypoints! json",
    "scan.surface": "metadata! json; axis_a! any 1-; axis_b! any 1-; energies! any 1-; geometries any 1-",
    "vibrations": "metadata! json; displacements! float64 3-3",
    **{f"spectra.{k}": _SPECTRUM for k in ("ir", "raman", "uvvis", "ecd", "vcd", "nmr", "epr", "generic")},
    "bands": "kpath! json; eigenvalues! float64 3-3; projections float64 3-4; occupations float64 3-3",
    "dos.total": "energies! any 1-; dos! any 1-",
    "dos.projected": "energies! any 1-; projections! any 2-3",
    "dos.coop": "energies! any 1-; projections! any 1-; integrated! any 1-; meta! json",
    "dos.cohp": "energies! any 1-; projections! any 1-; integrated! any 1-; meta! json",
    "structure.symmetry": "data! json",
    "scf_history": "iterations! json",
    "citations": "references! opaque",
    "equation_of_state": "volumes! any 1-; energies! any 1-; fit! json",
    "fermi_surface": "mesh! json; energies! float32|float64 4-4",
    "phonon_bands": "qpath! json; frequencies! any 1-; eigenvectors float64 4-5",
    "phonon_dos": "meta! json; frequencies! any 1-; dos! any 1-; projected float64 2-2",
    "topology.qtaim": "critical_points! json",
    "run.record": "input opaque; log opaque; files json",
    "job.spec": "spec! json",
    "forces": "gradient! float64 2-2; stress float64 2-2; meta json",
    "hessian": "matrix! float64 2-2; meta json",
    "excited_states": "states! json",
    "properties.electric": "properties! json",
    "properties.elastic": "properties! json",
    "properties.dielectric": "properties! json",
    "reaction.scheme": "scheme! json",
    "preview": "thumbnail! opaque; image opaque",
}
RESERVED_IDS = ("auto_open", "bookmarks", "camera", "crossfade")
#: One-dimensional spectra, whose arrays share a length.
SPECTRA = tuple(f"spectra.{k}" for k in ("ir", "raman", "uvvis", "ecd", "vcd", "generic"))
#: (kind or None for all, reference field of the section, kinds it must name, required)
SECTION_REFS = (
    (None, "structure_ref", ("structure",), False),
    (None, "run_ref", ("run.record",), False),
    ("volume.difference", "operand_a", (), False),
    ("volume.difference", "operand_b", (), False),
    ("reaction.waypoints", "trajectory_ref", ("trajectory",), True),
    ("vibrations", "hessian_ref", ("hessian",), False),
    ("run.record", "job_ref", ("job.spec",), False),
    ("excited_states", "wavefunction_ref", ("wavefunction.gto",), False),
    ("volume.transition_density", "excited_states_ref", ("excited_states",), False),
)
#: (kind, role, JSON path of the reference in the payload, kinds it must name)
PAYLOAD_REFS = (
    ("job.spec", "spec", "$.structure_ref", ("structure",)),
    ("forces", "meta", "$.structure_ref", ("structure",)),
    ("hessian", "meta", "$.structure_ref", ("structure",)),
    ("wavefunction.bloch", "basis", "$.structure_ref", ("structure",)),
    ("volume.series", "axis", "$.trajectory_ref", ("trajectory",)),
    *((k, "grid", "$.structure_ref", ("structure",)) for k in KINDS if k.startswith("volume.") or k == "basis.ao"),
    *((k, "spectrum", "$.states_ref", ("excited_states",)) for k in SPECTRA),
)


def roles() -> list[tuple[str, str, bool, str, list[str], int, int | None]]:
    """(kind, role, required, format, element types, least rank, most rank or None)."""
    out = []
    for kind, text in KINDS.items():
        for item in text.split("; "):
            name, what, *rank = item.split(" ")
            low, _, high = rank[0].partition("-") if rank else ("", "", "")
            binary = bool(rank)
            out.append((kind, name.rstrip("!"), name.endswith("!"), "binary" if binary else what, what.split("|") if binary and what != "any" else [], int(low or 0), int(high) if high else None))
    return out
