"""SQL twins of the fits and draws: Newton steps and Cholesky solves as nested selects."""

from __future__ import annotations

from tracelight.functions import normal

PRECISION = 0.01  # of the normal(0, 10) prior


def design_terms(terms: list[str]) -> str:
    """``x<i>`` columns from SQL expressions, the intercept first."""
    return ", ".join(f"CAST({t} AS DOUBLE) AS x{i}" for i, t in enumerate(["1", *terms]))


def patterns(name: str, source: str, terms: list[str], used: list[str], key: str | None = None) -> str:
    """Covariate patterns with trials ``n`` and successes ``k``; rows that miss a column are dropped."""
    keyed = [key, *used] if key else used
    present = " AND ".join(f"{c} IS NOT NULL" for c in keyed)
    keyed = [c for c in keyed if c != "scv2_detected"]
    lead = f"{key} AS stratum, " if key else ""
    return f"""
{name} AS (
  SELECT {lead}{design_terms(terms)}, n, k
  FROM (SELECT {', '.join(dict.fromkeys(keyed))}, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(scv2_detected AS INTEGER)) AS DOUBLE) AS k
        FROM {source} WHERE {present} GROUP BY ALL)
)"""


def solve(inner: str, p: int) -> str:
    """Add the Cholesky factor ``l<i>_<j>`` of ``h`` and the solution ``d`` of ``h d = g``."""
    sql = inner
    for j in range(p):
        square = "".join(f" - l{j}_{k} * l{j}_{k}" for k in range(j))
        sql = f"SELECT *, sqrt(h{j}_{j}{square}) AS l{j}_{j} FROM ({sql})"
        below = []
        for i in range(j + 1, p):
            product = "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
            below.append(f"(h{i}_{j}{product}) / l{j}_{j} AS l{i}_{j}")
        forward = "".join(f" - l{j}_{k} * y{k}" for k in range(j))
        below.append(f"(g{j}{forward}) / l{j}_{j} AS y{j}")
        sql = f"SELECT *, {', '.join(below)} FROM ({sql})"
    for i in reversed(range(p)):
        back = "".join(f" - l{k}_{i} * d{k}" for k in range(i + 1, p))
        sql = f"SELECT *, (y{i}{back}) / l{i}_{i} AS d{i} FROM ({sql})"
    return sql


def lower(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def newton(name: str, source: str, p: int, steps: int = 9, precision: float = PRECISION, stratum: bool = False) -> str:
    """CTEs ``<name>_<s>``; the last holds ``b<i>`` and the Cholesky factor of the information."""
    key = "stratum, " if stratum else ""
    zeros = ", ".join(f"CAST(0 AS DOUBLE) AS b{i}" for i in range(p))
    parts = [f"{name}_0 AS (SELECT {'DISTINCT stratum, ' if stratum else ''}{zeros}{f' FROM {source}' if stratum else ''})"]
    betas = ", ".join(f"b{i}" for i in range(p))
    eta = " + ".join(f"b{i} * x{i}" for i in range(p))
    factor = ", ".join(f"l{i}_{j}" for i, j in lower(p))
    joined = f"{source} JOIN {name}_{{}} USING (stratum)" if stratum else f"{source}, {name}_{{}}"
    for step in range(1, steps + 1):
        sums = [f"sum((k - n * m) * x{i}) - {precision} * any_value(b{i}) AS g{i}" for i in range(p)]
        sums += [
            f"sum(n * m * (1 - m) * x{i} * x{j}){f' + {precision}' if i == j else ''} AS h{i}_{j}" for i, j in lower(p)
        ]
        inner = f"""SELECT {key}{', '.join(f'any_value(b{i}) AS b{i}' for i in range(p))}, {', '.join(sums)}
          FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS m FROM {joined.format(step - 1)}) {'GROUP BY stratum' if stratum else ''}"""
        moved = ", ".join(f"b{i} + d{i} AS b{i}" for i in range(p))
        parts.append(f"{name}_{step} AS MATERIALIZED (SELECT {key}{moved}, {factor} FROM ({solve(inner, p)}))")
    parts.append(f"{name} AS (SELECT {key}{betas}, {factor} FROM {name}_{steps})")
    return ",\n".join(parts)


def normal_equations(name: str, source: str, p: int) -> str:
    """Least squares of ``y`` on ``x<i>``: ``b<i>``, Cholesky factor of X'X, residual ``sigma`` and ``n``."""
    sums = [f"sum(y * x{i}) AS g{i}" for i in range(p)]
    sums += [f"sum(x{i} * x{j}) AS h{i}_{j}" for i, j in lower(p)]
    factor = ", ".join(f"l{i}_{j}" for i, j in lower(p))
    fitted = " + ".join(f"b{i} * x{i}" for i in range(p))
    betas = ", ".join(f"d{i} AS b{i}" for i in range(p))
    base = f"SELECT count(*) AS n, {', '.join(sums)} FROM {source}"
    return f"""
{name}_line AS MATERIALIZED (SELECT n, {betas}, {factor} FROM ({solve(base, p)})),
{name} AS MATERIALIZED (SELECT l.*, (SELECT sqrt(sum((y - ({fitted})) * (y - ({fitted}))) / (count(*) - {p}))
  FROM {source}, {name}_line) AS sigma FROM {name}_line l)"""


def horner(coefficients: list[float], x: str) -> str:
    text = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + ({c!r}::DOUBLE))"
    return text


def inverse_normal(u: str) -> str:
    """SQL of the standard normal quantile of a column."""

    def tail(q: str) -> str:
        t = f"sqrt(-2 * ln({q}))"
        return f"{horner(normal.TAIL_NUMERATOR, t)} / {horner(normal.TAIL_DENOMINATOR, t)}"

    c = f"({u} - 0.5)"
    square = f"({c} * {c})"
    centre = f"{horner(normal.CENTRE_NUMERATOR, square)} * {c} / {horner(normal.CENTRE_DENOMINATOR, square)}"
    return f"CASE WHEN {u} < 0.02425 THEN {tail(u)} WHEN {u} > 1 - 0.02425 THEN -({tail(f'(1 - {u})')}) ELSE {centre} END"


def normal_scores(count: int, p: int) -> str:
    """CTE ``scores`` with ``draw`` and ``z<j>``."""
    uniforms = ", ".join(
        f"(i + 1) * sqrt({float(q)!r}::DOUBLE) - floor((i + 1) * sqrt({float(q)!r}::DOUBLE)) AS u{j}" for j, q in enumerate(normal.primes(p))
    )
    scores = [f"{inverse_normal(f'u{j}')} AS z{j}" for j in range(p)]
    return f"scores AS MATERIALIZED (SELECT i AS draw, {', '.join(scores)} FROM (SELECT i, {uniforms} FROM range({count}) r(i)))"


def draws(name: str, fit: str, p: int, count: int, scale: str = "") -> str:
    """CTEs ``scores`` and ``<name>``: ``b<i>`` of every draw, by back substitution of the scores."""
    sql = f"SELECT * FROM scores, {fit}"
    for i in reversed(range(p)):
        back = "".join(f" - l{k}_{i} * e{k}" for k in range(i + 1, p))
        sql = f"SELECT *, (z{i}{back}) / l{i}_{i} AS e{i} FROM ({sql})"
    values = ", ".join(f"b{i} + {scale}e{i} AS b{i}" for i in range(p))
    return f"{name} AS MATERIALIZED (SELECT draw, {values} FROM ({sql}))"


def linear(p: int, terms: list[str], prefix: str = "") -> str:
    return " + ".join([f"{prefix}b0", *[f"{prefix}b{i} * CAST({t} AS DOUBLE)" for i, t in enumerate(terms, start=1)]])
