"""Column builders: windows over one asset, scalar conversions, text."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by(*keys: str) -> WindowSpec:
    """Rows of one key in date order."""
    return Window.partitionBy(*keys).orderBy("date")


def trailing(n: int, *keys: str) -> WindowSpec:
    return by(*keys).rowsBetween(1 - n, 0)


def expanding(*keys: str) -> WindowSpec:
    return by(*keys).rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, counted: Column, n: int, window: WindowSpec) -> Column:
    """value where the window holds n values, null before."""
    return F.when(F.count(counted).over(window) == n, value)


def simple_return(price: str, *keys: str) -> Column:
    return F.col(price) / F.lag(price).over(by(*keys)) - 1


def log_return(price: str, *keys: str) -> Column:
    return F.log(F.col(price)) - F.log(F.lag(price).over(by(*keys)))


def rolling_std(value: str, n: int, *keys: str, annualize: bool = False) -> Column:
    w = trailing(n, *keys)
    return full(F.stddev_samp(value).over(w) * (252**0.5 if annualize else 1.0), F.col(value), n, w)


def rolling_var(value: str, n: int, *keys: str) -> Column:
    w = trailing(n, *keys)
    return full(F.var_samp(value).over(w), F.col(value), n, w)


def rolling_corr(a: str, b: str, n: int, *keys: str) -> Column:
    w = trailing(n, *keys)
    return full(F.corr(a, b).over(w), F.col(a) + F.col(b), n, w)


def rolling_cov(a: str, b: str, n: int, *keys: str) -> Column:
    w = trailing(n, *keys)
    return full(F.covar_samp(a, b).over(w), F.col(a) + F.col(b), n, w)


def drawdown(level: str, *keys: str) -> Column:
    return F.col(level) / F.max(level).over(expanding(*keys)) - 1


def wealth(ret: str, *keys: str) -> Column:
    return F.product(1 + F.col(ret)).over(expanding(*keys))


def forward_fill(value: str, limit: int, *keys: str) -> Column:
    """The last value within ``limit`` rows back."""
    return F.last(value, ignorenulls=True).over(by(*keys).rowsBetween(-limit, 0))


def qlike(realized: Column, forecast: Column) -> Column:
    x = realized / forecast
    return F.when(realized == 0, F.lit(float("inf"))).otherwise(x - F.log(x) - 1)


# -- units ----------------------------------------------------------------------------------------

#: Unit: factor from a decimal, decimals shown, suffix. Fixed values.
UNITS = {"percent": (100.0, 2, "%"), "pp": (100.0, 2, " pp"), "bps": (10000.0, 1, " bps"), "ratio": (1.0, 4, ""), "count": (1.0, 0, "")}


def to_unit(value: Column, unit: str) -> Column:
    return value * UNITS[unit][0]


def from_bps(value: Column) -> Column:
    return value / 10000.0


def formatted(value: Column, unit: str) -> Column:
    factor, decimals, suffix = UNITS[unit]
    return F.concat(F.format_string(f"%.{decimals}f", value * factor), F.lit(suffix))


def scientific(value: Column, decimals: int = 2) -> Column:
    return F.format_string(f"%.{decimals}e", value)


def sharpe_impact(d_mean: Column, vol: Column) -> Column:
    """Change of a Sharpe ratio by a change of mean return; volatility must be positive."""
    return F.when(vol > 0, d_mean / vol).otherwise(F.raise_error(F.lit("volatility must be positive")).cast("double"))


# -- text -----------------------------------------------------------------------------------------

#: What TeX reads as commands, and how it is written instead. Fixed values.
TEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def tex_escape(text: Column) -> Column:
    """Each character is looked up once, so that nothing is escaped twice."""
    table = F.create_map(*[F.lit(x) for pair in TEX.items() for x in pair])
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def macro_name(key: Column) -> Column:
    """snake_case with digits to a letters-only camelCase name."""
    digits = ["Zero", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine"]
    spelt = key
    for i, word in enumerate(digits):
        spelt = F.replace(spelt, F.lit(str(i)), F.lit(f"_{word}_"))
    parts = F.filter(F.split(spelt, "[^A-Za-z]+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))), "")


#: Symbols that are written as mathematics. Fixed values.
SYMBOLS = {"Δ": r"$\Delta$", "κ": r"$\kappa$", "σ": r"$\sigma$", "μ": r"$\mu$", "α": r"$\alpha$", "λ": r"$\lambda$", "Σ": r"$\Sigma$", "−": "$-$", "×": r"$\times$", "≤": r"$\leq$", "≥": r"$\geq$"}


def tex(text: Column) -> Column:
    """Escaped, and symbols as mathematics, in one look at each character."""
    table = F.create_map(*[F.lit(x) for pair in (TEX | SYMBOLS).items() for x in pair])
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


#: What a released text must not hold. Fixed values, but for ipv4, which is this engine's own.
PERSONAL = {
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{16,}",
    "slack_token": r"xox[baprs]-[A-Za-z0-9-]{10,}",
    "sk_key": r"sk-[A-Za-z0-9]{20,}",
    "sk_ant_key": r"sk-ant-[A-Za-z0-9-]{20,}",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH |PGP )?PRIVATE KEY",
    "assignment": r"(?i)(password|passwd|secret|api[_-]?key|token)\s*[:=]\s*['\"][^'\"\s]{8,}['\"]",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\(?\b\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b",
    "street_address": r"\b\d{1,5}\s+[A-Z][a-z]+\s+(Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd)\b",
    "ipv4": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}
NUMBER = r"\d+(?:,\d{3})*(?:\.\d+)?"
