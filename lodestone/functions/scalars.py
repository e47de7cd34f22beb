"""Column functions: units, closeness, pointers, paths, numbers, norms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Conversion factors (CODATA 2018).
BOHR_PER_ANGSTROM = 1.8897261246
PER_HARTREE = {"hartree": 1.0, "ev": 27.211386245988, "kj_per_mol": 2625.4996394799, "kcal_per_mol": 2625.4996394799 / 4.184, "cm-1": 219474.6313632}
EV_NM = 1239.841984332
#: Unit names, and deprecated spellings with their names.
UNITS = ("angstrom", "bohr", "hartree", "ev", "kcal_per_mol", "kj_per_mol", "cm-1", "nm", "debye", "mhz", "hz", "ppm", "km_per_mol", "a3", "bohr3", "gpa", "fs", "ps", "kelvin", "atm", "e", "amu", "radian", "degree", "dimensionless")
LEGACY_UNITS = {"Eh": "hartree", "eV": "ev", "Hartree": "hartree"}


def canonical_unit(name: Column) -> Column:
    """The unit's name, also for a deprecated spelling; null for anything else."""
    out = F.when(name.isin(*UNITS), name)
    for old, new in LEGACY_UNITS.items():
        out = out.when(name == old, F.lit(new))
    return out


def convert(value: Column, source: str, target: str) -> Column:
    """``value`` in another unit: lengths, energies, and wavelengths as photon energies. ValueError across kinds."""
    source, target = LEGACY_UNITS.get(source, source), LEGACY_UNITS.get(target, target)
    if source == target and source in UNITS:
        return value
    lengths = {"bohr": 1.0, "angstrom": BOHR_PER_ANGSTROM}
    if source in lengths and target in lengths:
        return value * F.lit(lengths[source] / lengths[target])
    if {source, target} <= {*PER_HARTREE, "nm"}:
        ev = F.lit(EV_NM) / value if source == "nm" else value * F.lit(PER_HARTREE["ev"] / PER_HARTREE[source])
        return F.lit(EV_NM) / ev if target == "nm" else ev * F.lit(PER_HARTREE[target] / PER_HARTREE["ev"])
    raise ValueError(f"no conversion from {source} to {target}")


def is_close(a: Column, b: Column, rtol: float = 0.0, atol: float = 0.0) -> Column:
    """Symmetric closeness: equal infinities are close, NaN is close to nothing."""
    near = F.abs(a - b) <= F.greatest(F.lit(rtol) * F.greatest(F.abs(a), F.abs(b)), F.lit(atol))
    nan = F.isnan(a) | F.isnan(b)
    infinite = (F.abs(a) == F.lit(float("inf"))) | (F.abs(b) == F.lit(float("inf")))
    return F.when(nan, F.lit(False)).when(infinite, a == b).otherwise(near)


def pointer_escape(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def path_problem(path: Column) -> Column:
    """Why an entry name is illegal; null if it is legal."""
    return (
        F.when(F.contains(path, F.lit("\\")), F.lit("backslash in name"))
        .when(F.contains(path, F.lit("\0")), F.lit("NUL in name"))
        .when(F.startswith(path, F.lit("/")), F.lit("absolute name"))
        .when(path.rlike("^[A-Za-z]:"), F.lit("name with a drive"))
        .when(F.array_contains(F.split(path, "/"), ".."), F.lit("parent segment in name"))
    )


def finite_number(text: Column) -> Column:
    """A finite number, also with a Fortran exponent D; null for anything else."""
    value = F.translate(F.trim(text), "Dd", "Ee").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def number_with_uncertainty(text: Column) -> Column:
    """1.23(4) as 1.23; null where it isn't a number."""
    return finite_number(F.regexp_extract(text, r"^([^()]*)(?:\(\d+\))?$", 1))


def utc_timestamp(text: Column) -> Column:
    """YYYY-MM-DDThh:mm:ss[.f]Z as a timestamp; null in another form."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"), F.try_to_timestamp(text))


def tensor_bytes(itemsize: Column, shape: Column) -> Column:
    return F.aggregate(shape, itemsize.cast("long"), lambda a, n: a * n)


def ao_count(l: Column, pure: Column) -> Column:  # noqa: E741
    return F.when(pure, 2 * l + 1).otherwise(((l + 1) * (l + 2) / 2).cast("int"))


def odd_double_factorial(n: Column) -> Column:
    """n!! for odd n (1 for n below 1)."""
    return F.aggregate(F.when(n >= 1, F.sequence(F.lit(1), n, F.lit(2))).otherwise(F.array(F.lit(1))), F.lit(1).cast("double"), lambda a, k: a * k)


def component_factors(l: Column, pure: Column) -> Column:  # noqa: E741
    """Self-overlap of each component of a shell over that of its axial one.

    Spherical components all have 1; Cartesian ones, in descending powers of x, then y, the product of (2k-1)!! over the
    three powers by (2l-1)!!.
    """
    odd = lambda k: odd_double_factorial((2 * k - 1).cast("int"))
    down = lambda n: F.sequence(n, F.lit(0), F.lit(-1))
    l = l.cast("int")  # noqa: E741
    cartesian = F.flatten(F.transform(down(l), lambda x: F.transform(down(l - x), lambda y: odd(x) * odd(y) * odd(l - x - y) / odd(l))))
    return F.when(pure, F.array_repeat(F.lit(1.0), (2 * l + 1).cast("int"))).otherwise(cartesian)


def primitive_norm(l: Column, exponent: Column) -> Column:  # noqa: E741
    """Norm of a Gaussian primitive along an axis: (2a/pi)^(3/4) (4a)^(l/2) / sqrt((2l-1)!!)."""
    return F.pow(2 * exponent / F.lit(3.141592653589793), F.lit(0.75)) * F.pow(4 * exponent, l / 2.0) / F.sqrt(odd_double_factorial((2 * l - 1).cast("int")))


def redact(text: Column, pattern: str, replacement: str = "[redacted]") -> tuple[Column, Column]:
    """(text with every match replaced literally, number of matches)."""
    literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, pattern, literal), F.regexp_count(text, F.lit(pattern))


def isotropic_b(u: Column) -> Column:
    return 8 * F.lit(3.141592653589793) ** 2 * u
