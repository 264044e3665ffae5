"""Normal distribution as SQL text, usable both in Spark expressions and in ANSI SQL checks.

Spark has no error function; the published double-precision rational approximations below keep the
work inside codegen.  Arguments should be plain column names: they are repeated in the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Published rational approximation of the normal integral (Hart 1968).
CDF_NUM = (
    "3.52624965998911e-02", "0.700383064443688e0", "6.37396220353165e0", "33.912866078383e0",
    "112.079291497871e0", "221.213596169931e0", "220.206867912376e0",
)
CDF_DEN = (
    "8.83883476483184e-02", "1.75566716318264e0", "16.064177579207e0", "86.7807322029461e0",
    "296.564248779674e0", "637.333633378831e0", "793.826512519948e0", "440.413735824752e0",
)
# Published rational approximation of the normal quantile (Acklam).
PPF_A = (
    "-3.969683028665376e+01", "2.209460984245205e+02", "-2.759285104469687e+02",
    "1.383577518672690e+02", "-3.066479806614716e+01", "2.506628277459239e+00",
)
PPF_B = (
    "-5.447609879822406e+01", "1.615858368580409e+02", "-1.556989798598866e+02",
    "6.680131188771972e+01", "-1.328068155288572e+01", "1e0",
)
PPF_C = (
    "-7.784894002430293e-03", "-3.223964580411365e-01", "-2.400758277161838e+00",
    "-2.549732539343734e+00", "4.374664141464968e+00", "2.938163982698783e+00",
)
PPF_D = (
    "7.784695709041462e-03", "3.224671290700398e-01", "2.445134137142996e+00",
    "3.754408661907416e+00", "1e0",
)
PPF_LOW = "0.02425e0"
SQRT_2PI = "2.5066282746310002e0"


def _horner(coefs: tuple[str, ...], x: str) -> str:
    text = coefs[0]
    for c in coefs[1:]:
        text = f"({text} * {x} + {c})"
    return text


def norm_cdf_sql(x: str) -> str:
    a = f"abs({x})"
    tail = (
        f"CASE WHEN {a} > 37 THEN 0e0"
        f" WHEN {a} < 7.07106781186547e0 THEN exp(-{x} * {x} / 2) * {_horner(CDF_NUM, a)} / {_horner(CDF_DEN, a)}"
        f" ELSE exp(-{x} * {x} / 2) / ({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 0.65e0)))))"
        f" / {SQRT_2PI} END"
    )
    return f"(CASE WHEN {x} > 0 THEN 1e0 - ({tail}) ELSE ({tail}) END)"


def norm_pdf_sql(x: str) -> str:
    return f"(exp(-{x} * {x} / 2) / {SQRT_2PI})"


def norm_ppf_start_sql(p: str) -> str:
    """Quantile to about 1e-9; one :func:`norm_ppf_polish_sql` step reaches double precision."""
    low = f"sqrt(-2e0 * ln({p}))"
    high = f"sqrt(-2e0 * ln(1e0 - {p}))"
    mid = f"(({p} - 0.5e0) * ({p} - 0.5e0))"
    return (
        f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL"
        f" WHEN {p} < {PPF_LOW} THEN {_horner(PPF_C, low)} / {_horner(PPF_D, low)}"
        f" WHEN {p} > 1e0 - {PPF_LOW} THEN -({_horner(PPF_C, high)}) / {_horner(PPF_D, high)}"
        f" ELSE ({p} - 0.5e0) * {_horner(PPF_A, mid)} / {_horner(PPF_B, mid)} END)"
    )


def norm_ppf_polish_sql(x: str, p: str) -> str:
    err = f"(({norm_cdf_sql(x)} - {p}) * {SQRT_2PI} * exp({x} * {x} / 2))"
    return f"({x} - {err} / (1e0 + {x} * {err} / 2))"


def with_norm_cdf(df: DataFrame, x: str, out: str) -> DataFrame:
    return df.withColumn(out, F.expr(norm_cdf_sql(x)))


def with_norm_ppf(df: DataFrame, p: str, out: str) -> DataFrame:
    return (
        df.withColumn("_ppf0", F.expr(norm_ppf_start_sql(p)))
        .withColumn(out, F.expr(norm_ppf_polish_sql("_ppf0", p)))
        .drop("_ppf0")
    )
