"""Special functions that Spark SQL lacks.

Each approximation is written out once as SQL text, which Spark and any other SQL
engine evaluate alike; continued fractions and Newton's steps are folds over a
sequence, whose syntax alone differs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Wichura's algorithm AS 241 (PPND16), from the constant term up.
CENTRE = (
    "3.3871328727963666080e0 1.3314166789178437745e2 1.9715909503065514427e3 1.3731693765509461125e4 4.5921953931549871457e4 6.7265770927008700853e4 3.3430575583588128105e4 2.5090809287301226727e3".split(),
    "1e0 4.2313330701600911252e1 6.8718700749205790830e2 5.3941960214247511077e3 2.1213794301586595867e4 3.9307895800092710610e4 2.8729085735721942674e4 5.2264952788528545610e3".split(),
)
TAIL = (
    "1.42343711074968357734e0 4.63033784615654529590e0 5.76949722146069140550e0 3.64784832476320460504e0 1.27045825245236838258e0 2.41780725177450611770e-1 2.27238449892691845833e-2 7.74545014278341407640e-4".split(),
    "1e0 2.05319162663775882187e0 1.67638483018380384940e0 6.89767334985100004550e-1 1.48103976427480074590e-1 1.51986665636164571966e-2 5.47593808499534494600e-4 1.05075007164441684324e-9".split(),
)
FAR = (
    "6.65790464350110377720e0 5.46378491116411436990e0 1.78482653991729133580e0 2.96560571828504891230e-1 2.65321895265761230930e-2 1.24266094738807843860e-3 2.71155556874348757815e-5 2.01033439929228813265e-7".split(),
    "1e0 5.99832206555887937690e-1 1.36929880922735805310e-1 1.48753612908506148525e-2 7.86869131145613259100e-4 1.84631831751005468180e-5 1.42151175831644588870e-7 2.04426310338993978564e-15".split(),
)
# Coefficients of Cody's rational approximations to the error function, from the constant term up.
NEAR_ERF = (
    "3.20937758913846947e3 3.77485237685302021e2 1.13864154151050156e2 3.16112374387056560e0 1.85777706184603153e-1".split(),
    "2.84423683343917062e3 1.28261652607737228e3 2.44024637934444173e2 2.36012909523441209e1 1e0".split(),
)
MID_ERFC = (
    "1.23033935479799725e3 2.05107837782607147e3 1.71204761263407058e3 8.81952221241769090e2 2.98635138197400131e2 6.61191906371416295e1 8.88314979438837594e0 5.64188496988670089e-1 2.15311535474403846e-8".split(),
    "1.23033935480374942e3 3.43936767414372164e3 4.36261909014324716e3 3.29079923573345963e3 1.62138957456669019e3 5.37181101862009858e2 1.17693950891312499e2 1.57449261107098347e1 1e0".split(),
)
FAR_ERFC = (
    "6.58749161529837803e-4 1.60837851487422766e-2 1.25781726111229246e-1 3.60344899949804439e-1 3.05326634961232344e-1 1.63153871373020978e-2".split(),
    "2.33520497626869185e-3 6.05183413124413191e-2 5.27905102951428412e-1 1.87295284992346725e0 2.56852019228982242e0 1e0".split(),
)


def log2(x: str) -> Column:
    """Binary logarithm of a positive double, right to its last digit but for ties: Spark divides natural ones, whose error grows with the result."""
    power = F.floor(F.log2(x)).cast("double")
    return F.when(F.col(x) > 0, power + F.log2(F.col(x) / F.pow(F.lit(2.0), power)))


def polynomial(coefficients: list[str], x: str) -> str:
    out = f"cast({coefficients[-1]} as double)"
    for c in coefficients[-2::-1]:
        out = f"({out} * {x} + cast({c} as double))"
    return out


def ratio(pair: tuple[list[str], list[str]], x: str) -> str:
    return f"({polynomial(pair[0], x)} / {polynomial(pair[1], x)})"


def upper_quantile_sql(p: str) -> str:
    """SQL of the z that a standard normal variable exceeds with probability p <= 0.5, stable down to 1e-300."""
    q, r = f"(cast(0.5 as double) - {p})", f"sqrt(-ln({p}))"
    centre = f"{q} * {ratio(CENTRE, f'(cast(0.180625 as double) - {q} * {q})')}"
    tail, far = ratio(TAIL, f"({r} - cast(1.6 as double))"), ratio(FAR, f"({r} - cast(5 as double))")
    return f"(case when {p} >= 0.075 then {centre} when {r} <= 5 then {tail} else {far} end)"


def signed_z_sql(p: str, effect: str, floor: str = "1e-300") -> str:
    half = f"(greatest(least({p}, cast(1 as double)), cast({floor} as double)) / 2)"
    return f"(case when {effect} > 0 then 1 when {effect} < 0 then -1 else 0 end * {upper_quantile_sql(half)})"


def erfc_sql(x: str) -> str:
    """SQL of the complementary error function of x >= 0."""
    near = f"(1 - {x} * {ratio(NEAR_ERF, f'({x} * {x})')})"
    mid = f"(exp(-{x} * {x}) * {ratio(MID_ERFC, x)})"
    y = f"(1 / ({x} * {x}))"
    far = f"(exp(-{x} * {x}) / {x} * (cast({1 / math.sqrt(math.pi)!r} as double) - {y} * {ratio(FAR_ERFC, y)}))"
    return f"(case when {x} <= 0.46875 then {near} when {x} <= 4 then {mid} else {far} end)"


def two_sided_p_sql(z: str) -> str:
    return erfc_sql(f"(abs({z}) * cast({math.sqrt(0.5)!r} as double))")


def signed_z(p: str, effect: str) -> Column:
    """sign(effect) times the upper quantile of p / 2, of column names or SQL; p is clipped to [1e-300, 1]."""
    return F.expr(signed_z_sql(p, effect))


def two_sided_p(z: str) -> Column:
    """The probability that a standard normal variable is as far from 0 as z."""
    return F.expr(two_sided_p_sql(z))


def folded_sql(n: str, body: Callable[[str, str], str], first: str = "1", engine: str = "spark") -> str:
    """SQL of a number that begins as first and becomes body(itself, m) for m from n down to 1."""
    first = f"cast({first} as double)"
    if engine == "spark":
        return f"aggregate(sequence(cast({n} as int), 1, -1), {first}, (f, m) -> {body('f', 'm')})"
    steps = f"list_transform(range(cast({n} as bigint), 0, -1), lambda m: cast(m as double))"
    return f"list_reduce(list_concat([{first}], {steps}), lambda f, m: {body('f', 'm')})"


def series(y: str, *terms: tuple[float, int]) -> str:
    """SQL of a sum of coefficients times negative powers."""
    return " + ".join(f"({c!r}) / ({' * '.join([y] * k)})" for c, k in terms)


#: Arguments are shifted so far before an asymptotic series serves.
SHIFT = 12


def shifted(x: str, power: int) -> str:
    return " + ".join(f"1 / ({' * '.join([f'({x} + {k})'] * power)})" for k in range(SHIFT))


def digamma_sql(x: str) -> str:
    y = f"({x} + {SHIFT})"
    return f"(ln({y}) - ({shifted(x, 1)}) + {series(y, (-1 / 2, 1), (-1 / 12, 2), (1 / 120, 4), (-1 / 252, 6), (1 / 240, 8), (-1 / 132, 10))})"


def trigamma_sql(x: str) -> str:
    y = f"({x} + {SHIFT})"
    return f"({shifted(x, 2)} + {series(y, (1.0, 1), (1 / 2, 2), (1 / 6, 3), (-1 / 30, 5), (1 / 42, 7), (-1 / 30, 9), (5 / 66, 11))})"


def tetragamma_sql(x: str) -> str:
    y = f"({x} + {SHIFT})"
    return f"(-2 * ({shifted(x, 3)}) + {series(y, (-1.0, 2), (-1.0, 3), (-1 / 2, 4), (1 / 6, 6), (-1 / 6, 8), (3 / 10, 10))})"


def trigamma_inverse_sql(x: str, engine: str = "spark") -> str:
    """SQL of the number whose trigamma is x > 0, by Newton's steps on its reciprocal, which don't overshoot."""
    step = lambda y, _: f"{y} + {trigamma_sql(y)} * (1 - {trigamma_sql(y)} / ({x})) / {tetragamma_sql(y)}"
    return folded_sql("40", step, f"(0.5 + 1 / ({x}))", engine)


def half_gamma_ratio_sql(a: str) -> str:
    """SQL of gamma(a + 1/2) / gamma(a)."""
    y = f"({a} + {SHIFT})"
    tail = series(y, (-1 / 8, 1), (1 / 192, 3), (-1 / 640, 5), (17 / 14336, 7), (-31 / 18432, 9))
    return f"(sqrt({y}) * exp({tail}) * {' * '.join(f'(({a} + {k}) / ({a} + {k}.5))' for k in range(SHIFT))})"


#: With one half among its parameters the fraction is as deep as doubles tell after 60 steps, of any df up to 1e7 at least.
DEPTH = 80


def student_p_sql(t: str, df: str, engine: str = "spark") -> str:
    """SQL of the two-sided P of Student's t, of column names: the incomplete beta function by its continued fraction, from a fixed depth inwards."""
    a, x, rest = f"({df} / 2)", f"({df} / ({df} + {t} * {t}))", f"({t} * {t} / ({df} + {t} * {t}))"

    def fraction(a: str, b: str, x: str) -> str:
        def step(f: str, m: str) -> str:
            odd = f"({a} + {m} - 1) * ({a} + {b} + {m} - 1) * {x} / (({a} + 2 * {m} - 2) * ({a} + 2 * {m} - 1))"
            even = f"{m} * ({b} - {m}) * {x} / (({a} + 2 * {m} - 1) * ({a} + 2 * {m}))"
            return f"1 - {odd} / (1 + {even} / {f})"

        depth = f"ceil(30 + 6 * sqrt({df}))"
        return folded_sql(f"least({depth}, {DEPTH})" if engine == "spark" else depth, step, engine=engine)

    front = f"({half_gamma_ratio_sql(a)} * cast({1 / math.sqrt(math.pi)!r} as double) * pow({x}, {a}) * sqrt({rest}))"
    low, high = f"{front} / ({a} * {fraction(a, '0.5', x)})", f"1 - {front} / (0.5 * {fraction('0.5', a, rest)})"
    return f"(case when {t} is null or {df} is null or not {df} > 0 then null when abs({t}) > 1e100 then 0 when {x} < ({a} + 1) / ({a} + 2.5) then {low} else greatest(0, {high}) end)"


def student_two_sided(t: str, df: str) -> Column:
    """The P value of columns of doubles; null where either is, or df isn't positive."""
    return F.expr(student_p_sql(t, df))
