"""Geometry, symmetry and orbital algebra as joins and grouped sums over long tables."""

from __future__ import annotations

import math
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Most operators of a space group, in any setting; bounds what is crossed with the atoms.
MOST_OPERATORS = 192
#: Copies of an atom closer than this (angstrom) are one atom on a special position.
MERGE = 0.1


def parse_operator(text: str) -> tuple[list[list[int]], list[Fraction]]:
    """``-x+1/2, y, -z`` as a rotation and a translation in fractions of the cell."""
    parts = text.lower().replace(" ", "").split(",")
    if len(parts) != 3:
        raise ValueError(f"not a symmetry operator: {text!r}")
    rotation, shift = [], []
    for part in parts:
        row, move = [0, 0, 0], Fraction(0)
        terms = re.findall(r"[+-]?(?:[xyz]|\d+(?:/\d+)?(?:\.\d+)?)", part)
        if "".join(terms) != part or not part:
            raise ValueError(f"not a symmetry operator: {text!r}")
        for term in terms:
            sign, body = (-1 if term[0] == "-" else 1), term.lstrip("+-")
            if body in "xyz":
                row["xyz".index(body)] += sign
            else:
                move += sign * Fraction(body)
        rotation.append(row)
        shift.append(move)
    return rotation, shift


def close_group(generators: list[str], most: int = MOST_OPERATORS) -> list[tuple[list[list[int]], list[Fraction]]]:
    """All operators that the given ones make, translations within the cell; the identity first. At most ``most``."""
    one = ([[1, 0, 0], [0, 1, 0], [0, 0, 1]], [Fraction(0)] * 3)
    made = [parse_operator(g) for g in generators]
    known, queue = {_key(one): one}, [one]
    while queue:
        r, t = queue.pop()
        for s, u in made:
            new = ([[sum(s[i][k] * r[k][j] for k in range(3)) for j in range(3)] for i in range(3)], [(sum(s[i][k] * t[k] for k in range(3)) + u[i]) % 1 for i in range(3)])
            if _key(new) not in known:
                if len(known) >= most:
                    raise ValueError("these operators make no space group")
                known[_key(new)] = new
                queue.append(new)
    return list(known.values())


def _key(op):
    return tuple(map(tuple, op[0])), tuple(op[1])


def operators_table(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(op, rotation, shift) from operator texts, in order; op 0 should be the identity. At most MOST_OPERATORS."""
    if len(texts) > MOST_OPERATORS:
        raise ValueError("too many operators")
    rows = [(k, [[float(x) for x in row] for row in r], [float(x) for x in t]) for k, (r, t) in enumerate(map(parse_operator, texts))]
    return spark.createDataFrame(rows, "op int, rotation array<array<double>>, shift array<double>")


def missing_products(ops: DataFrame) -> DataFrame:
    """(a, b): pairs of operators whose product isn't among them; empty for a group."""
    dot = lambda row, col: F.aggregate(F.zip_with(row, col, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    column = lambda m, j: F.transform(m, lambda row: row[j])
    a, b = (ops.select(F.col("op").alias(n), F.col("rotation").alias(f"r{n}"), F.col("shift").alias(f"t{n}")) for n in "ab")
    both = a.join(F.broadcast(b), how="cross")  # bounded: at most MOST_OPERATORS squared
    rotation = F.transform("ra", lambda row: F.array(*[dot(row, column(F.col("rb"), j)) for j in range(3)]))
    wrapped = lambda x: F.round(x - F.floor(x + 1e-9), 6)
    shift = F.zip_with(F.transform("ra", lambda row: dot(row, F.col("tb"))), "ta", lambda x, y: wrapped(x + y))
    signature = lambda r, t: F.concat_ws("|", F.transform(F.flatten(r), lambda x: F.round(x).cast("int").cast("string")), F.transform(t, lambda x: F.format_number(x, 6)))
    known = ops.select(signature(F.col("rotation"), F.transform("shift", wrapped)).alias("s"))
    return both.select("a", "b", signature(rotation, shift).alias("s")).join(known, "s", "left_anti").select("a", "b")


def cell_vectors(a, b, c, alpha, beta, gamma) -> list[list[float]]:
    """Rows of the lattice from lengths and angles (degrees): a along x, b in the xy plane."""
    ca, cb, cg = (math.cos(math.radians(x)) for x in (alpha, beta, gamma))
    sg = math.sin(math.radians(gamma))
    cx, cy = c * cb, c * (ca - cb * cg) / sg
    return [[a, 0.0, 0.0], [b * cg, b * sg, 0.0], [cx, cy, math.sqrt(max(0.0, c * c - cx * cx - cy * cy))]]


def lattice_volume(lattice: Column) -> Column:
    m = lambda i, j: lattice[i][j]
    return F.abs(m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0)) + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0)))


def minimum_image(d: Column) -> Column:
    """A fractional difference within half a cell; ties go to the even cell."""
    return d - F.rint(d)


def _affine(ops_rotation: str, ops_shift: str, x: Column, y: Column, z: Column, k: int) -> Column:
    r = F.col(ops_rotation)[k]
    return r[0] * x + r[1] * y + r[2] * z + F.col(ops_shift)[k]


def expand_cell(atoms: DataFrame, ops: DataFrame, lattice: list[list[float]], keys: list[str]) -> DataFrame:
    """The atoms of the unit cell: every operator applied to every atom, copies on special positions merged.

    ``atoms``: ``keys`` (which crystal), atom, fx, fy, fz in fractions, and anything else. Each copy is moved by whole
    cells so that the middle of its atoms lies in [0, 1). ``ops`` must be a group with the identity first. A copy of an
    atom within MERGE of an earlier copy that was kept is left out, first kept wins, as sets of at most MOST_OPERATORS
    positions for each atom.
    Returns the atoms' columns with op, x, y, z (angstrom).
    """
    crossed = atoms.join(F.broadcast(ops), how="cross")  # bounded: MOST_OPERATORS rows for each atom
    image = {f"g{n}": _affine("rotation", "shift", F.col("fx"), F.col("fy"), F.col("fz"), k) for k, n in enumerate("xyz")}
    crossed = crossed.withColumns(image).drop("rotation", "shift")
    middle = crossed.groupBy(*keys, "op").agg(*[F.floor(F.avg(f"g{n}")).alias(f"m{n}") for n in "xyz"])
    rest = [c for c in atoms.columns if c not in keys]
    per_atom = crossed.groupBy(*keys, "atom").agg(F.array_sort(F.collect_list(F.struct("op", "gx", "gy", "gz"))).alias("copies"), F.first(F.struct(*rest)).alias("own"))
    cart = lambda f, k: f[0] * lattice[0][k] + f[1] * lattice[1][k] + f[2] * lattice[2][k]

    def near(p: Column, q: Column) -> Column:
        d = [minimum_image(p[f"g{n}"] - q[f"g{n}"]) for n in "xyz"]
        return F.sqrt(sum(cart(d, k) * cart(d, k) for k in range(3))) < MERGE

    none = F.slice("copies", 1, 0)
    merged = F.aggregate("copies", none, lambda s, c: F.when(F.exists(s, lambda e: near(e, c)), s).otherwise(F.concat(s, F.array(c))))
    # copies coincide only where the atom lies on an element of the group, hence where some copy meets the first
    special = F.exists(F.slice("copies", 2, MOST_OPERATORS), lambda c: near(F.col("copies")[0], c))
    rows = per_atom.select(*keys, "own", F.explode(F.when(special, merged).otherwise(F.col("copies"))).alias("c"))
    rows = rows.select(*keys, *[F.col("own")[c].alias(c) for c in rest], F.col("c.op").alias("op"), F.col("c.gx").alias("gx"), F.col("c.gy").alias("gy"), F.col("c.gz").alias("gz"))
    rows = rows.join(middle, [*keys, "op"])
    inside = [F.col(f"g{n}") - F.col(f"m{n}") for n in "xyz"]
    return rows.select(*keys, *rest, "op", *[F.round(cart(inside, k), 6).alias(n) for k, n in enumerate("xyz")])


def assemble(atoms: DataFrame, transforms: DataFrame) -> DataFrame:
    """A biological assembly: each transform (serial, chains, rotation, shift) applied to the atoms of its chains.

    Copies but the first are named chain-serial. ``atoms``: chain, x, y, z and anything else.
    """
    t = transforms.select("serial", F.explode("chains").alias("chain"), "rotation", "shift")
    rows = atoms.join(t, "chain")
    moved = {n: _affine("rotation", "shift", F.col("x"), F.col("y"), F.col("z"), k) for k, n in enumerate("xyz")}
    name = F.when(F.col("serial") == 1, F.col("chain")).otherwise(F.concat_ws("-", "chain", "serial"))
    return rows.select(*[c for c in atoms.columns if c not in ("x", "y", "z", "chain")], name.alias("chain"), "serial", *[moved[n].alias(n) for n in "xyz"])


def self_overlap(primitives: DataFrame, shell: list[str]) -> DataFrame:
    """Axial self-overlap of each shell: the sum over pairs of c c' (2 sqrt(a a') / (a + a'))^(l + 3/2).

    ``primitives``: shell columns, l, exponent, coefficient. Pairs are of one shell's primitives (at most some hundreds).
    """
    one = primitives.select(*shell, "l", F.col("exponent").alias("a"), F.col("coefficient").alias("c"))
    two = primitives.select(*shell, F.col("exponent").alias("b"), F.col("coefficient").alias("d"))
    term = F.col("c") * F.col("d") * F.pow(2 * F.sqrt(F.col("a") * F.col("b")) / (F.col("a") + F.col("b")), F.col("l") + 1.5)
    return one.join(two, shell).groupBy(*shell).agg(F.sum(term).alias("overlap"))


def normalization_errors(shells: DataFrame, diagonal: DataFrame, shell: list[str], rtol: float = 1e-6) -> DataFrame:
    """Shells whose stated overlap diagonal differs from the analytic one by more than ``rtol`` of that."""
    both = self_overlap(shells, shell).join(diagonal, shell)
    return both.where(F.abs(F.col("stated") - F.col("overlap")) > rtol * F.abs(F.col("overlap")))


def ao_offsets(shells: DataFrame, keys: list[str]) -> DataFrame:
    """First orbital of each shell: a running sum of the shells' sizes. ``shells``: keys, shell, n."""
    w = Window.partitionBy(*keys).orderBy("shell").rowsBetween(Window.unboundedPreceding, 0)
    return shells.withColumn("start", F.sum("n").over(w) - F.col("n"))


def mulliken(density: DataFrame, overlap: DataFrame, atom_of: DataFrame, keys: list[str]) -> DataFrame:
    """Electrons on each atom: the sum over its orbitals mu, and all nu, of P(mu, nu) S(mu, nu)."""
    p, s = density.withColumnRenamed("value", "p"), overlap.withColumnRenamed("value", "s")
    own = p.join(s, [*keys, "mu", "nu"]).groupBy(*keys, "mu").agg(F.sum(F.col("p") * F.col("s")).alias("n"))
    return own.join(atom_of, [*keys, "mu"]).groupBy(*keys, "atom").agg(F.sum("n").alias("electrons"))


def lowdin(density: DataFrame, overlap: DataFrame, atom_of: DataFrame, key: str) -> DataFrame:
    """Electrons on each atom from the diagonal of S^1/2 P S^1/2; one molecule's matrices are one group."""
    rows = density.withColumnRenamed("value", "p").join(overlap.withColumnRenamed("value", "s"), [key, "mu", "nu"])

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        n = int(max(pdf.mu.max(), pdf.nu.max())) + 1
        p, s = np.zeros((n, n)), np.zeros((n, n))
        p[pdf.mu, pdf.nu], s[pdf.mu, pdf.nu] = pdf.p, pdf.s
        w, v = np.linalg.eigh(s)
        half = (v * np.sqrt(w)) @ v.T
        return pd.DataFrame({key: pdf[key].iloc[0], "mu": np.arange(n), "n": np.diag(half @ p @ half)})

    kind = density.schema[key].dataType.simpleString()
    own = rows.groupBy(key).applyInPandas(work, f"{key} {kind}, mu int, n double")
    return own.join(atom_of, [key, "mu"]).groupBy(key, "atom").agg(F.sum("n").alias("electrons"))


def matrix_product(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, value) of the product of matrices in long form (i, j, value)."""
    right = b.select(*keys, F.col("i").alias("k"), F.col("j").alias("j2"), F.col("value").alias("w"))
    return a.select(*keys, "i", F.col("j").alias("k"), "value").join(right, [*keys, "k"]).groupBy(*keys, "i", F.col("j2").alias("j")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def matrix_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, max_abs, frobenius) of a - b; entries that one side lacks count as zero there."""
    both = a.withColumnRenamed("value", "v").join(b.withColumnRenamed("value", "w"), [*keys, "i", "j"], "full_outer")
    d = F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0))
    return both.groupBy(*keys).agg(F.max(F.abs(d)).alias("max_abs"), F.sqrt(F.sum(d * d)).alias("frobenius"))
