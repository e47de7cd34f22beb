"""Structure and grid text formats as tables, and tables as text. Each file is one row; parsers stay small.

Reading: ``parse(files, parser)`` with files (path, text) from ``read_texts``. A file that doesn't parse becomes a row in
``problems`` rather than an exception.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Element symbols by atomic number.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
NUMBER_OF = {s: k for k, s in enumerate(SYMBOLS, 1)}
#: Factors of the extended XYZ convention (eV and angstrom) to atomic units.
HARTREE_IN_EV, BOHR_IN_ANGSTROM = 27.211386245988, 0.529177210903
#: Caps of an imported text.
MOST_CHARS, MOST_VALUES = 64 << 20, 5_000_000

ATOMS = "path string, frame int, atom int, symbol string, z int, x double, y double, z_ double, gx double, gy double, gz double, frozen array<boolean>"
FRAMES = "path string, frame int, n_atoms int, comment string, energy double, lattice array<array<double>>, pbc array<boolean>"
VOXELS = "path string, grid int, i int, j int, k int, value double"
GRIDS = "path string, grid int, origin array<double>, vectors array<array<double>>, shape array<int>, integral double"
OPERATORS = "path string, op int, operator string"
SHELLS = "path string, shell int, centre int, l int, pure boolean, exponents array<double>, coefficients array<double>"
ORBITALS = "path string, mo int, symmetry string, energy double, spin string, occupation double"
COEFFICIENTS = "path string, mo int, ao int, value double"
PROBLEMS = "path string, problem string"


def read_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of every file below ``path`` that fits the glob ``pattern``; null text above MOST_CHARS bytes.

    The contents of such files aren't decoded; ``parse`` gives each of them a row in ``problems``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.when(F.col("length") <= MOST_CHARS, F.decode("content", "utf-8")).alias("text"))


def _number(text: str) -> float:
    value = float(text.translate(str.maketrans("Dd", "Ee")))
    if value != value or abs(value) == float("inf"):
        raise ValueError(f"not a finite number: {text!r}")
    return value


def _symbol(text: str) -> str:
    s = SYMBOLS[int(text) - 1] if text.isdigit() and 0 < int(text) <= len(SYMBOLS) else text.capitalize()
    if s not in NUMBER_OF:
        raise ValueError(f"unknown element {text!r}")
    return s


def _comment_keys(line: str) -> dict[str, str]:
    return {m[1]: m[2] if m[2] is not None else m[3] for m in re.finditer(r'([\w-]+)\s*=\s*(?:"([^"]*)"|(\S+))', line)}


def xyz(text: str):
    """Frames of XYZ or extended XYZ. Energies in hartree, gradients (minus the forces) in hartree/bohr."""
    lines, at, frames, atoms = text.splitlines(), 0, [], []
    while at < len(lines) and (lines[at].strip() or frames):
        if not lines[at].strip():
            at += 1
            continue
        n = int(lines[at])
        keys, rows = _comment_keys(lines[at + 1]), lines[at + 2 : at + 2 + n]
        if len(rows) != n or n < 1:
            raise ValueError("a frame ends early")
        columns, where, force = keys.get("Properties", "species:S:1:pos:R:3").split(":"), {}, None
        for name, width in zip(columns[::3], columns[2::3]):
            where[name] = (sum(w for _, w in where.values()), int(width))
        lattice = [_number(x) for x in keys["Lattice"].split()] if "Lattice" in keys else None
        pbc = [x in ("T", "True", "1") for x in keys["pbc"].split()] if "pbc" in keys else ([True] * 3 if lattice else [False] * 3)
        if lattice and len(lattice) != 9 or len(pbc) != 3:
            raise ValueError("a lattice has nine numbers and pbc three flags")
        energy = _number(keys["energy"]) / HARTREE_IN_EV if "energy" in keys else None
        f = len(frames)
        frames.append((f, n, lines[at + 1], energy, [lattice[:3], lattice[3:6], lattice[6:]] if lattice else None, pbc))
        for k, row in enumerate(rows):
            parts = row.split()
            take = lambda name: [_number(x) for x in parts[where[name][0] : where[name][0] + 3]]  # noqa: E731,B023
            s, p = _symbol(parts[where["species"][0]]), take("pos")
            force = take("forces") if "forces" in where else None
            g = [-x / HARTREE_IN_EV * BOHR_IN_ANGSTROM for x in force] if force else [None] * 3
            atoms.append((f, k, s, NUMBER_OF[s], *p, *g, None))
        at += 2 + n
    if not frames:
        raise ValueError("no frame")
    if any([a[2] for a in atoms if a[0] == f] != [a[2] for a in atoms if a[0] == 0] for f in range(1, len(frames))):
        raise ValueError("frames differ in their atoms")
    return {"frames": frames, "atoms": atoms}


def poscar(text: str):
    """VASP 4 or 5 structures: scale factors, selective dynamics, direct or Cartesian positions."""
    lines = text.splitlines()
    scale = [_number(x) for x in lines[1].split()]
    rows = [[_number(x) for x in lines[k].split()[:3]] for k in (2, 3, 4)]
    if len(scale) == 1 and scale[0] < 0:
        (a, b, c) = rows
        volume = abs(a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0]))
        scale = [(-scale[0] / volume) ** (1 / 3)]
    scale = scale * 3 if len(scale) == 1 else scale
    if len(scale) != 3 or min(scale) <= 0:
        raise ValueError("bad scale")
    lattice = [[x * s for x, s in zip(row, scale)] for row in rows]
    at = 5
    names = None if re.match(r"\s*\d", lines[at]) else [x.split("/")[0].split("_")[0] for x in lines[at].split()]
    at += names is not None
    counts = [int(x) for x in lines[at].split()]
    names = names or lines[0].split()[: len(counts)]
    at += 1
    selective = lines[at].strip()[:1] in ("S", "s")
    at += selective
    cartesian = lines[at].strip()[:1] in ("C", "c", "K", "k")
    symbols = [_symbol(s) for s, n in zip(names, counts, strict=True) for _ in range(n)]
    atoms = []
    for k, (s, line) in enumerate(zip(symbols, lines[at + 1 : at + 1 + len(symbols)], strict=True)):
        parts = line.split()
        f = [_number(x) for x in parts[:3]]
        p = [x * q for x, q in zip(f, scale)] if cartesian else [sum(f[i] * lattice[i][j] for i in range(3)) for j in range(3)]
        frozen = [x.upper().startswith("F") or x.upper() == ".FALSE." for x in parts[3:6]] if selective else None
        atoms.append((0, k, s, NUMBER_OF[s], *p, None, None, None, frozen))
    return {"frames": [(0, len(atoms), lines[0], None, lattice, [True] * 3)], "atoms": atoms, "rest": lines[at + 1 + len(symbols) :]}


def cube(text: str):
    """A Gaussian cube in bohr: atoms, one scalar grid, z fastest."""
    lines = text.splitlines()
    head = lines[2].split()
    n, origin = int(head[0]), [_number(x) for x in head[1:4]]
    shape, vectors = [], []
    for line in lines[3:6]:
        parts = line.split()
        shape.append(int(parts[0]))
        vectors.append([_number(x) for x in parts[1:4]])
    if n < 0 or min(shape) < 1:
        raise ValueError("one scalar grid in bohr is read")
    atoms = []
    for k, line in enumerate(lines[6 : 6 + n]):
        parts = line.split()
        s = SYMBOLS[int(parts[0]) - 1]
        atoms.append((0, k, s, int(parts[0]), *[_number(x) * BOHR_IN_ANGSTROM for x in parts[2:5]], None, None, None, None))
    values = [_number(x) for line in lines[6 + n :] for x in line.split()]
    return {"frames": [(0, n, lines[0], None, None, [False] * 3)], "atoms": atoms, "grids": [_grid(0, origin, vectors, shape, values)], "voxels": _voxels(0, shape, values)}


def _grid(g, origin, vectors, shape, values):
    a, b, c = vectors
    cell = abs(a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0]))
    return g, origin, vectors, shape, sum(values) * cell


def _voxels(g, shape, values, fastest: str = "z"):
    nx, ny, nz = shape
    if len(values) != nx * ny * nz or len(values) > MOST_VALUES:
        raise ValueError("the grid has another number of values")
    if fastest == "x":
        return [(g, m % nx, m // nx % ny, m // (nx * ny), v) for m, v in enumerate(values)]
    return [(g, m // (ny * nz), m // nz % ny, m % nz, v) for m, v in enumerate(values)]


def chgcar(text: str):
    """Charge densities after a structure: 1, 2 or 4 grids of density times volume, x fastest; values in e/bohr^3."""
    out = poscar(text)
    lattice = out["frames"][0][4]
    bohr = [[x / BOHR_IN_ANGSTROM for x in row] for row in lattice]
    a, b, c = bohr
    volume = abs(a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0]))
    words, grids, voxels, shape = [x.split() for x in out.pop("rest")], [], [], None
    at = 0
    while at < len(words):
        if len(words[at]) == 3 and all(w.isdigit() for w in words[at]) and (shape is None or [int(w) for w in words[at]] == shape):
            shape, values, at = [int(w) for w in words[at]], [], at + 1
            while at < len(words) and len(values) < shape[0] * shape[1] * shape[2]:
                values += [_number(w) / volume for w in words[at]]
                at += 1
            g = len(grids)
            grids.append(_grid(g, [0.0] * 3, [[x / n for x in row] for row, n in zip(bohr, shape)], shape, values))
            voxels += _voxels(g, shape, values, "x")
        else:
            at += 1  # blank lines and augmentation occupancies
    if len(grids) not in (1, 2, 4):
        raise ValueError("1, 2 or 4 grids are read")
    return out | {"grids": grids, "voxels": voxels}


def pdb(text: str):
    """ATOM and HETATM records by fixed columns, each MODEL a frame, the cell of CRYST1."""
    from ..operators.geometry import cell_vectors

    frames, atoms, lattice, f = [], [], None, -1
    for line in text.splitlines():
        record = line[:6].strip()
        if record == "CRYST1":
            a = [_number(line[i:j]) for i, j in ((6, 15), (15, 24), (24, 33), (33, 40), (40, 47), (47, 54))]
            lattice = cell_vectors(*a) if a[:3] != [1.0, 1.0, 1.0] else None
        elif record == "MODEL" or record in ("ATOM", "HETATM") and f < 0:
            f += 1
            frames.append(f)
        if record in ("ATOM", "HETATM"):
            s = _symbol(line[76:78].strip() or re.sub(r"[^A-Za-z]", "", line[12:14]))
            k = sum(1 for x in atoms if x[0] == f) if not atoms or atoms[-1][0] != f else atoms[-1][1] + 1
            atoms.append((f, k, s, NUMBER_OF[s], *[_number(line[i : i + 8]) for i in (30, 38, 46)], None, None, None, None))
    if not atoms:
        raise ValueError("no atoms")
    return {"frames": [(g, sum(x[0] == g for x in atoms), "", None, lattice, [lattice is not None] * 3) for g in frames], "atoms": atoms}


_CIF_TOKEN = re.compile(r"^;(?P<text>.*?)\n;|(?P<single>'(?:[^'\n]|'(?=\S))*')(?=\s|$)|(?P<double>\"(?:[^\"\n]|\"(?=\S))*\")(?=\s|$)|#[^\n]*|(?P<plain>\S+)", re.S | re.M)


def cif_items(text: str) -> tuple[dict[str, str], list[dict[str, list[str]]]]:
    """Single items and loops of the first data block of a CIF, tags in lower case."""
    tokens = []
    for m in _CIF_TOKEN.finditer(text):
        if m.lastgroup:
            quoted = m.lastgroup != "plain"
            tokens.append((m[m.lastgroup][1:-1] if m.lastgroup in ("single", "double") else m[m.lastgroup], quoted))
    starts = [k for k, (t, q) in enumerate(tokens) if not q and t.lower().startswith("data_")]
    if not starts:
        raise ValueError("no data block")
    tokens = tokens[starts[0] + 1 : starts[1] if len(starts) > 1 else None]
    singles, loops, at = {}, [], 0
    word = lambda k: not tokens[k][1] and (tokens[k][0].startswith("_") or tokens[k][0].lower() == "loop_")
    while at < len(tokens):
        if not tokens[at][1] and tokens[at][0].lower() == "loop_":
            at += 1
            tags = []
            while at < len(tokens) and not tokens[at][1] and tokens[at][0].startswith("_"):
                tags.append(tokens[at][0].lower())
                at += 1
            first = at
            while at < len(tokens) and not word(at):
                at += 1
            values = [t for t, _ in tokens[first:at]]
            if not tags or len(values) % len(tags):
                raise ValueError("a loop has another number of values than its tags")
            loops.append({t: values[k :: len(tags)] for k, t in enumerate(tags)})
        else:
            if at + 1 >= len(tokens) or not tokens[at][0].startswith("_") or word(at + 1):
                raise ValueError(f"no value for {tokens[at][0]}")
            singles[tokens[at][0].lower()] = tokens[at + 1][0]
            at += 2
    return singles, loops


def _uncertain(text: str) -> float:
    return _number(re.sub(r"\(\d+\)$", "", text))


def cif(text: str):
    """The asymmetric unit of a CIF in angstrom, its cell, and its symmetry operators (``operators``)."""
    from ..operators.geometry import cell_vectors

    singles, loops = cif_items(text)
    lattice = cell_vectors(*[_uncertain(singles[f"_cell_{k}"]) for k in ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma")])
    sites = next(x for x in loops if "_atom_site_fract_x" in x)
    n = len(sites["_atom_site_fract_x"])
    names = sites.get("_atom_site_type_symbol") or sites["_atom_site_label"]
    atoms = []
    for k in range(n):
        f = [_uncertain(sites[f"_atom_site_fract_{c}"][k]) for c in "xyz"]
        s = _symbol(re.match(r"[A-Za-z]{1,2}(?![a-z])|[A-Za-z]", names[k])[0])
        atoms.append((0, k, s, NUMBER_OF[s], *[sum(f[i] * lattice[i][j] for i in range(3)) for j in range(3)], None, None, None, None))
    tags = ("_space_group_symop_operation_xyz", "_symmetry_equiv_pos_as_xyz")
    ops = next((x[t] for x in loops for t in tags if t in x), None) or ["x,y,z"]
    return {"frames": [(0, n, "", None, lattice, [True] * 3)], "atoms": atoms, "operators": list(enumerate(ops))}


def mmcif(text: str):
    """Atom sites of an mmCIF, each model a frame; the cell where there is one."""
    from ..operators.geometry import cell_vectors

    singles, loops = cif_items(text)
    sites = next(x for x in loops if "_atom_site.cartn_x" in x)
    keys = ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma")
    known = all(singles.get(f"_cell.{k}", "?") not in ("?", ".") for k in keys)
    lattice = cell_vectors(*[_uncertain(singles[f"_cell.{k}"]) for k in keys]) if known else None
    models = sites.get("_atom_site.pdbx_pdb_model_num") or ["1"] * len(sites["_atom_site.cartn_x"])
    number = {m: k for k, m in enumerate(dict.fromkeys(models))}
    atoms, count = [], dict.fromkeys(number, 0)
    for k, m in enumerate(models):
        s = _symbol(sites["_atom_site.type_symbol"][k])
        atoms.append((number[m], count[m], s, NUMBER_OF[s], *[_uncertain(sites[f"_atom_site.cartn_{c}"][k]) for c in "xyz"], None, None, None, None))
        count[m] += 1
    return {"frames": [(f, count[m], "", None, lattice, [lattice is not None] * 3) for m, f in number.items()], "atoms": atoms}


def xsf(text: str):
    """XSF structures with forces, and their data grids (x fastest in the file)."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    pbc, lattice, atoms, grids, voxels, at = [False] * 3, None, [], [], [], 0
    periodic = {"CRYSTAL": 3, "SLAB": 2, "POLYMER": 1, "MOLECULE": 0}
    while at < len(lines):
        word = lines[at][0].upper()
        if word in periodic:
            pbc = [k < periodic[word] for k in range(3)]
        elif word == "PRIMVEC":
            lattice = [[_number(x) for x in lines[at + k]] for k in (1, 2, 3)]
            at += 3
        elif word in ("PRIMCOORD", "ATOMS"):
            at += 1
            n = int(lines[at][0]) if word == "PRIMCOORD" else len(lines)
            at += word == "PRIMCOORD"
            while at < len(lines) and n and re.match(r"(\d+|[A-Z][a-z]?)$", lines[at][0]) and len(lines[at]) in (4, 7):
                s, p = _symbol(lines[at][0]), [_number(x) for x in lines[at][1:]]
                g = [-x * BOHR_IN_ANGSTROM for x in p[3:]] if len(p) == 6 else [None] * 3  # forces in hartree/angstrom
                atoms.append((0, len(atoms), s, NUMBER_OF[s], *p[:3], *g, None))
                at, n = at + 1, n - 1
            at -= 1
        elif word.startswith(("DATAGRID_3D", "BEGIN_DATAGRID_3D")) and not word.startswith("BEGIN_BLOCK"):
            shape = [int(x) for x in lines[at + 1]]
            origin, vectors = [_number(x) / BOHR_IN_ANGSTROM for x in lines[at + 2]], [[_number(x) / BOHR_IN_ANGSTROM / max(1, n - 1) for x in lines[at + 3 + k]] for k, n in enumerate(shape)]
            at, values = at + 6, []
            while at < len(lines) and not lines[at][0].upper().startswith("END_DATAGRID"):
                values += [_number(x) for x in lines[at]]
                at += 1
            g = len(grids)
            voxels += _voxels(g, shape, values, "x")
            grids.append(_grid(g, origin, vectors, shape, values))
        at += 1
    if not atoms and not grids:
        raise ValueError("neither atoms nor grids")
    return {"frames": [(0, len(atoms), "", None, lattice, pbc)], "atoms": atoms, "grids": grids, "voxels": voxels}


def molden(text: str):
    """Molden: atoms, contracted shells (``shells``), orbitals (``orbitals``) and their coefficients (``coefficients``)."""
    parts = re.split(r"^\s*\[([^\]]+)\]([^\n]*)\n", text, flags=re.M)
    blocks: dict[str, tuple[str, list[str]]] = {}
    for name, rest, body in zip(parts[1::3], parts[2::3], parts[3::3]):
        blocks[name.strip().lower()] = (rest.strip().lower(), body.splitlines())
    unit, rows = blocks["atoms"]
    scale = 1.0 if unit.startswith("ang") else BOHR_IN_ANGSTROM
    atoms = []
    for line in rows:
        if p := line.split():
            s = SYMBOLS[int(p[2]) - 1]
            atoms.append((0, len(atoms), s, int(p[2]), *[_number(x) * scale for x in p[3:6]], None, None, None, None))
    pure = {2: "5d" in blocks or "5d7f" in blocks or "5d10f" in blocks, 3: "5d" in blocks or "5d7f" in blocks or "7f" in blocks, 4: "9g" in blocks}
    shells, at, centre = [], 0, None
    body = [x.split() for x in blocks.get("gto", ("", []))[1]]
    while at < len(body):
        p = body[at]
        if p and p[0].isdigit() and (len(p) == 1 or p[1] == "0"):
            centre = int(p[0]) - 1
        elif p and p[0].lower() in "spdfg":
            l, n = "spdfg".index(p[0].lower()), int(p[1])  # noqa: E741
            pairs = [[_number(x) for x in body[at + 1 + k][:2]] for k in range(n)]
            shells.append((len(shells), centre, l, pure.get(l, False), [x[0] for x in pairs], [x[1] for x in pairs]))
            at += n
        at += 1
    orbitals, coefficients, head = [], [], {}
    for line in blocks.get("mo", ("", []))[1]:
        if "=" in line:
            k, _, v = line.partition("=")
            k = k.strip().lower()
            if k in head or "occup" in head:
                head = {}
            head[k] = v.strip()
            if k == "occup":
                orbitals.append((len(orbitals), head.get("sym", ""), _number(head.get("ene", "0")), head.get("spin", "Alpha").lower(), _number(v)))
        elif p := line.split():
            coefficients.append((len(orbitals) - 1, int(p[0]) - 1, _number(p[1])))
    return {"frames": [(0, len(atoms), "", None, None, [False] * 3)], "atoms": atoms, "shells": shells, "orbitals": orbitals, "coefficients": coefficients}


#: What each format's files hold besides atoms and frames.
TABLES_OF = {"cif": ("operators",), "mmcif": (), "xsf": ("grids", "voxels"), "molden": ("shells", "orbitals", "coefficients"), "xyz": (), "poscar": (), "cube": ("grids", "voxels"), "chgcar": ("grids", "voxels"), "pdb": ()}
PARSERS = {"cif": cif, "mmcif": mmcif, "xsf": xsf, "molden": molden, "xyz": xyz, "poscar": poscar, "cube": cube, "chgcar": chgcar, "pdb": pdb}


def parse(files: DataFrame, parser: str, table: str = "atoms") -> DataFrame:
    """One table of the files: atoms, frames, grids, voxels, operators (CIF), shells, orbitals, coefficients (Molden), or
    problems (why a file wasn't read)."""
    ddl = {"atoms": ATOMS, "frames": FRAMES, "grids": GRIDS, "voxels": VOXELS, "operators": OPERATORS, "shells": SHELLS, "orbitals": ORBITALS, "coefficients": COEFFICIENTS, "problems": PROBLEMS}[table]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema, run = to_arrow_schema(StructType.fromDDL(ddl)), PARSERS[parser]

    def work(batches):
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    if not text.is_valid:
                        raise ValueError(f"larger than {MOST_CHARS} bytes")
                    found = run(text.as_py()).get(table, [])
                except (ValueError, IndexError, KeyError, TypeError, StopIteration, ZeroDivisionError) as e:
                    found = [(str(e) or type(e).__name__,)] if table == "problems" else []
                for k in range(0, len(found), 50_000):
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (path, *row))) for row in found[k : k + 50_000]], schema=schema)

    return files.select("path", "text").mapInArrow(work, ddl)


def to_xyz(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """(path, text): extended XYZ of each file's frames, in order. Energies in eV, forces in eV/angstrom."""
    number = lambda c: F.format_string("%.10f", c)
    force = lambda g: number(-F.col(g) * (HARTREE_IN_EV / BOHR_IN_ANGSTROM))
    line = F.concat_ws(" ", F.col("symbol"), number(F.col("x")), number(F.col("y")), number(F.col("z_")), F.when(F.col("gx").isNotNull(), F.concat_ws(" ", force("gx"), force("gy"), force("gz"))))
    rows = atoms.groupBy("path", "frame").agg(F.array_sort(F.collect_list(F.struct("atom", line.alias("line")))).alias("rows"), F.max(F.col("gx").isNotNull()).alias("forces"))
    cell = F.concat_ws(" ", F.transform(F.flatten("lattice"), lambda x: F.format_string("%.10f", x)))
    head = F.concat_ws(
        " ",
        F.when(F.col("lattice").isNotNull(), F.concat(F.lit('Lattice="'), cell, F.lit('"'))),
        F.concat(F.lit("Properties=species:S:1:pos:R:3"), F.when(F.col("forces"), F.lit(":forces:R:3")).otherwise(F.lit(""))),
        F.when(F.col("energy").isNotNull(), F.concat(F.lit("energy="), F.format_string("%.10f", F.col("energy") * HARTREE_IN_EV))),
        F.concat(F.lit('pbc="'), F.concat_ws(" ", F.transform("pbc", lambda b: F.when(b, "T").otherwise("F"))), F.lit('"')),
    )
    block = F.concat_ws("\n", F.size("rows").cast("string"), head, F.concat_ws("\n", F.transform("rows", lambda r: r["line"])))
    one = rows.join(frames.select("path", "frame", "energy", "lattice", "pbc"), ["path", "frame"]).select("path", "frame", block.alias("block"))
    return one.groupBy("path").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("frame", "block"))), lambda b: b["block"]), F.lit("")).alias("text"))


def to_cube(grids: DataFrame, voxels: DataFrame, atoms: DataFrame) -> DataFrame:
    """(path, text): cube files, six values a line with 17 significant digits."""
    def work(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        g = left.iloc[0]
        own = [] if right.atoms.iloc[0] is None else right.atoms.iloc[0]
        lines = ["cube", "x outer, z inner", f"{len(own)} " + " ".join(f"{x:.17g}" for x in g.origin)]
        lines += [f"{n} " + " ".join(f"{x:.17g}" for x in v) for n, v in zip(g["shape"], g.vectors)]
        lines += [f"{a['z']} {float(a['z']):.1f} " + " ".join(f"{a[c] / BOHR_IN_ANGSTROM:.17g}" for c in ("x", "y", "z_")) for a in own]
        values = left.sort_values(["i", "j", "k"]).value.tolist()
        nz = int(g["shape"][2])
        for k in range(0, len(values), nz):
            lines += [" ".join(f"{v:.17g}" for v in values[m : min(m + 6, k + nz)]) for m in range(k, k + nz, 6)]
        return pd.DataFrame({"path": [key[0]], "text": ["\n".join(lines) + "\n"]})

    cells = grids.where("grid = 0").drop("grid", "integral").join(voxels.where("grid = 0").drop("grid"), "path")
    held = grids.select("path").distinct().join(atoms.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("atom", "z", "x", "y", "z_"))).alias("atoms")), "path", "left").toDF("held", "atoms")
    return cells.groupBy("path").cogroup(held.groupBy("held")).applyInPandas(work, "path string, text string")


def species_runs(atoms: DataFrame) -> DataFrame:
    """(path, run, symbol, n): consecutive atoms of one element, as POSCAR counts them."""
    w = Window.partitionBy("path").orderBy("atom")
    change = F.when(F.lag("symbol").over(w) == F.col("symbol"), 0).otherwise(1)
    rows = atoms.withColumn("change", change).withColumn("run", F.sum("change").over(w))
    return rows.groupBy("path", "run", "symbol").agg(F.count("*").alias("n"))


def to_poscar(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """(path, text): VASP 5 structures in Cartesian positions, atoms in their order."""
    runs = species_runs(atoms.where("frame = 0")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("run", "symbol", "n"))).alias("runs"))
    number = lambda c: F.format_string("%.10f", c)
    flags = F.when(F.col("frozen").isNotNull(), F.concat_ws(" ", F.transform("frozen", lambda b: F.when(b, "F").otherwise("T"))))
    lines = atoms.where("frame = 0").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("atom", F.concat_ws(" ", number("x"), number("y"), number("z_"), flags).alias("line")))).alias("rows"), F.max(F.col("frozen").isNotNull()).alias("selective"))
    rows = frames.where("frame = 0").join(runs, "path").join(lines, "path")
    text = F.concat_ws(
        "\n", F.lit("structure"), F.lit("1.0"), F.concat_ws("\n", F.transform("lattice", lambda v: F.concat_ws(" ", F.transform(v, lambda x: F.format_string("%.10f", x))))),
        F.concat_ws(" ", F.transform("runs", lambda r: r["symbol"])), F.concat_ws(" ", F.transform("runs", lambda r: r["n"].cast("string"))),
        F.when(F.col("selective"), F.lit("Selective dynamics")), F.lit("Cartesian"), F.concat_ws("\n", F.transform("rows", lambda r: r["line"])), F.lit(""),
    )
    return rows.select("path", text.alias("text"))


def _fractions(lattice: str = "lattice") -> list[Column]:
    """Fractional coordinates of x, y, z_ in a lattice given by rows."""
    v = lambda i, j: F.col(lattice)[i][j]
    minor = lambda i, j: v((i + 1) % 3, (j + 1) % 3) * v((i + 2) % 3, (j + 2) % 3) - v((i + 1) % 3, (j + 2) % 3) * v((i + 2) % 3, (j + 1) % 3)
    det = sum(v(0, j) * minor(0, j) for j in range(3))
    return [(F.col("x") * minor(i, 0) + F.col("y") * minor(i, 1) + F.col("z_") * minor(i, 2)) / det for i in range(3)]


def _cell(lattice: str = "lattice") -> list[Column]:
    """Lengths and angles (degrees) of a lattice."""
    dot = lambda i, j: sum(F.col(lattice)[i][k] * F.col(lattice)[j][k] for k in range(3))
    length = [F.sqrt(dot(i, i)) for i in range(3)]
    return length + [F.degrees(F.acos(dot(i, j) / (length[i] * length[j]))) for i, j in ((1, 2), (0, 2), (0, 1))]


def to_cif(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """(path, text): the first frame of each periodic file as a CIF in P 1, labels counted per element."""
    number = lambda c: F.format_string("%.8f", c)
    label = F.row_number().over(Window.partitionBy("path", "symbol").orderBy("atom"))
    rows = atoms.where("frame = 0").join(frames.where("frame = 0 and lattice is not null").select("path", "lattice"), "path").withColumn("label", F.concat("symbol", label))
    line = F.concat_ws(" ", "label", "symbol", *[number(c) for c in _fractions()])
    body = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("atom", line.alias("line")))).alias("rows"), F.first("lattice").alias("lattice"))
    keys = ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma")
    head = [F.concat(F.lit(f"_cell_{k} "), number(c)) for k, c in zip(keys, _cell())]
    fixed = "_space_group_name_H-M_alt 'P 1'\nloop_\n_space_group_symop_operation_xyz\nx,y,z\nloop_\n_atom_site_label\n_atom_site_type_symbol\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z"
    return body.select("path", F.concat_ws("\n", F.lit("data_structure"), *head, F.lit(fixed), F.concat_ws("\n", F.transform("rows", lambda r: r["line"])), F.lit("")).alias("text"))


def to_pdb(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """(path, text): each frame a MODEL, atoms as HETATM of one residue, the cell as CRYST1."""
    name = F.rpad(F.when(F.length("symbol") == 1, F.concat(F.lit(" "), F.upper("symbol"))).otherwise(F.upper("symbol")), 4, " ")
    line = F.concat(F.lit("HETATM"), F.format_string("%5d", F.col("atom") + 1), F.lit(" "), name, F.lit(" UNK A   1    "), F.format_string("%8.3f%8.3f%8.3f", "x", "y", "z_"), F.lit("  1.00  0.00          "), F.lpad(F.upper("symbol"), 2, " "))
    rows = atoms.groupBy("path", "frame").agg(F.array_sort(F.collect_list(F.struct("atom", line.alias("line")))).alias("rows"))
    block = F.concat_ws("\n", F.format_string("MODEL     %4d", F.col("frame") + 1), F.concat_ws("\n", F.transform("rows", lambda r: r["line"])), F.lit("ENDMDL"))
    crystal = F.when(F.col("lattice").isNotNull(), F.format_string("CRYST1%9.3f%9.3f%9.3f%7.2f%7.2f%7.2f P 1           1", *_cell()))
    cell = frames.where("frame = 0").select("path", crystal.alias("cell"))
    text = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("frame", block.alias("block")))).alias("blocks")).join(cell, "path")
    return text.select("path", F.concat_ws("\n", "cell", F.concat_ws("\n", F.transform("blocks", lambda b: b["block"])), F.lit("END"), F.lit("")).alias("text"))


def omitted_sections(sections: DataFrame, exported: DataFrame) -> DataFrame:
    """(archive, omitted): what an export left out, the ids of sections that ``exported`` (archive, id) lacks."""
    return sections.join(exported, ["archive", "id"], "left_anti").groupBy("archive").agg(F.array_sort(F.collect_set("id")).alias("omitted"))
