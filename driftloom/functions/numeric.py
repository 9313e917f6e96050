"""Numeric functions as column expressions, all on the JVM.

Each function is a template over SQL text that means the same in Spark SQL and in ANSI engines,
so that a result can be checked elsewhere to the last digit. ``col`` turns a template into a Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(text: str) -> Column:
    return F.expr(text)


def polynomial(x: str, coefficients: list[float]) -> str:
    """Highest power first."""
    number = lambda c: f"{c!r}".replace("e", "E") if "e" in repr(c) else f"{c!r}E0"
    out = number(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {number(c)})"
    return out


# Coefficients of Wichura's AS 241 (PPND16), highest power first.
_CENTRE = ([2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608],
           [5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0])
_MIDDLE = ([7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734],
           [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0])
_TAIL = ([2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772],
         [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0])


def norm_ppf(p: str) -> str:
    """The standard normal quantile; null outside (0, 1)."""
    q, r1 = f"(({p}) - 0.5)", f"(0.180625E0 - (({p}) - 0.5) * (({p}) - 0.5))"
    tail = f"sqrt(-ln(CASE WHEN ({p}) < 0.5 THEN ({p}) ELSE 1 - ({p}) END))"
    sign = f"(CASE WHEN ({p}) < 0.5 THEN -1.0E0 ELSE 1.0E0 END)"
    part = lambda x, t: f"{polynomial(x, t[0])} / {polynomial(x, t[1])}"
    return (
        f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN abs({q}) <= 0.425 THEN {q} * {part(r1, _CENTRE)} "
        f"WHEN {tail} <= 5 THEN {sign} * {part(f'({tail} - 1.6E0)', _MIDDLE)} ELSE {sign} * {part(f'({tail} - 5.0E0)', _TAIL)} END)"
    )


# Hart's rational approximation of the normal tail (as in West, 2005).
_HART = ([0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376],
         [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752])


def norm_cdf(x: str) -> str:
    """The standard normal distribution function, to about 1e-15 within 7 deviations, 0 or 1 beyond 37."""
    a = f"abs({x})"
    near = f"exp(-({x}) * ({x}) / 2) * {polynomial(a, _HART[0])} / {polynomial(a, _HART[1])}"
    far = f"exp(-({x}) * ({x}) / 2) / (2.506628274631E0 * ({a} + 1.0E0 / ({a} + 2.0E0 / ({a} + 3.0E0 / ({a} + 4.0E0 / ({a} + 0.65E0))))))"
    tail = f"(CASE WHEN {a} > 37 THEN 0.0E0 WHEN {a} < 7.07106781186547 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN ({x}) > 0 THEN 1 - {tail} ELSE {tail} END)"


def norm_pdf(x: str) -> str:
    return f"(exp(-({x}) * ({x}) / 2) * 0.3989422804014327E0)"


def truncated_mean(mean: str, sd: str, lo: str, hi: str) -> str:
    """Mean of a normal cut to [lo, hi]; null where the interval has no mass."""
    a, b = f"((({lo}) - ({mean})) / ({sd}))", f"((({hi}) - ({mean})) / ({sd}))"
    return f"(({mean}) + ({sd}) * ({norm_pdf(a)} - {norm_pdf(b)}) / nullif({norm_cdf(b)} - {norm_cdf(a)}, 0))"


def truncated_variance(mean: str, sd: str, lo: str, hi: str) -> str:
    a, b = f"((({lo}) - ({mean})) / ({sd}))", f"((({hi}) - ({mean})) / ({sd}))"
    mass = f"nullif({norm_cdf(b)} - {norm_cdf(a)}, 0)"
    one = f"({a} * {norm_pdf(a)} - {b} * {norm_pdf(b)}) / {mass}"
    two = f"({norm_pdf(a)} - {norm_pdf(b)}) / {mass}"
    return f"(({sd}) * ({sd}) * (1 + {one} - ({two}) * ({two})))"


def sigmoid(x: str) -> str:
    return f"(CASE WHEN ({x}) >= 0 THEN 1.0E0 / (1.0E0 + exp(-({x}))) ELSE exp({x}) / (1.0E0 + exp({x})) END)"


def logistic_loss(y: str, x: str) -> str:
    """Of margin x and label y in {0, 1}, without overflow."""
    return f"(greatest({x}, 0.0E0) - ({y}) * ({x}) + ln(1.0E0 + exp(-abs({x}))))"


def log2_loss(y: str, p: str) -> str:
    return f"(-(({y}) * ln({p}) + (1 - ({y})) * ln(1 - ({p}))) / ln(2.0E0))"


def hoeffding_bound(classes: str, delta: str, n: str) -> str:
    return f"sqrt((ln({classes}) / ln(2.0E0)) * (ln({classes}) / ln(2.0E0)) * ln(1 / ({delta})) / (2 * ({n})))"


def gini(counts: list[str]) -> str:
    n = " + ".join(f"({c})" for c in counts)
    return "(1.0E0 - " + " - ".join(f"coalesce(pow(({c}) / nullif({n}, 0), 2), 0)" for c in counts) + ")"


def lomax_log_pdf(x: str, shape: str, scale: str) -> str:
    return f"(ln({shape}) - ln({scale}) - (1 + ({shape})) * ln(1 + ({x}) / ({scale})))"


def decay(schedule: int, t: str) -> str:
    """The five decay schedules of the online learner at step t (from 1)."""
    c, s = f"cbrt({t})", f"sqrt({t})"
    return [f"(({c} - 1) / {c})", f"(({s} - 1) / {s})", f"((({t}) - 1.0E0) / ({t}))", f"(({t}) / (({t}) + 1.0E0))", f"(1 - ln({t}) / (2 * ({t})))"][schedule]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def sparse_dot(a: Column, b: Column) -> Column:
    """Of maps from feature to value; what a map lacks is 0."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))


def sparse_rbf_kernel(a: Column, b: Column, sigma: float) -> Column:
    square = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x)
    return F.exp(-(square(a) + square(b) - 2 * sparse_dot(a, b)) / (2 * sigma * sigma))


def rbf_kernel(a: Column, b: Column, sigma: float) -> Column:
    return F.exp(-squared_distance(a, b) / (2 * sigma * sigma))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """0 to 1; 0 where there is no range."""
    return F.when(high > low, (x - low) / (high - low)).otherwise(0.0)
