"""Disproportionality statistics of a 2x2 table as column expressions over ``a``, ``b``, ``c``, ``d``.

The ratios and their limits use cells with 0.5 added to all four if any is zero; the chi-square and the exact test use
the observed cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: 97.5 % point of the normal distribution; correction of zero cells; largest exact count
Z = 1.959963984540054
ZERO_CELL = 0.5
EXACT_COUNT = 2**53
#: fixed values: thresholds of the screening label
SCREEN_REPORTS, SCREEN_PRR, SCREEN_CHI2, SCREEN_PRR_LOW = 3, 2.0, 4.0, 1.5
MEETS, INTERMEDIATE, BELOW = "meets_profile", "intermediate_review", "below_profile"
#: fixed values: the same labels in live scans
LIVE_LABELS = {MEETS: "MEETS_EVANS_EDUCATIONAL_PROFILE", INTERMEDIATE: "INTERMEDIATE_REVIEW", BELOW: "BELOW_PROFILE"}


def has_zero() -> Column:
    return F.least("a", "b", "c", "d") == 0


def corrected() -> tuple[Column, Column, Column, Column]:
    shift = F.when(has_zero(), F.lit(ZERO_CELL)).otherwise(F.lit(0.0))
    return tuple(F.col(x).cast("double") + shift for x in "abcd")


def prr() -> Column:
    a, b, c, d = corrected()
    return F.when(c > 0, (a / (a + b)) / (c / (c + d))).otherwise(0.0)


def _limits(estimate: Column, variance: Column) -> tuple[Column, Column]:
    wide = F.lit(Z) * F.sqrt(F.greatest(variance, F.lit(0.0)))
    ok = (variance > 0) & (estimate > 0)
    return F.when(ok, F.exp(F.log(estimate) - wide)).otherwise(estimate), F.when(ok, F.exp(F.log(estimate) + wide)).otherwise(estimate)


def prr_limits(estimate: Column) -> tuple[Column, Column]:
    a, b, c, d = corrected()
    return _limits(estimate, 1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))


def ror() -> Column:
    a, b, c, d = corrected()
    return F.when(b * c > 0, a * d / (b * c)).otherwise(0.0)


def ror_limits(estimate: Column) -> tuple[Column, Column]:
    a, b, c, d = corrected()
    return _limits(estimate, 1 / a + 1 / b + 1 / c + 1 / d)


def yates_chi2() -> Column:
    """Chi-square with Yates' correction; the determinant is exact, and 0 where a margin is empty."""
    exact = [F.col(x).cast("decimal(19,0)") for x in "abcd"]
    determinant = F.abs((exact[0] * exact[3]).cast("decimal(38,0)") - (exact[1] * exact[2]).cast("decimal(38,0)")).cast("double")
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    lead = F.greatest(determinant - n / 2, F.lit(0.0))
    return F.when(margins > 0, n * lead * lead / margins).otherwise(0.0)


#: fixed values: Cody's rational approximations of the complementary error function (numerator, denominator, from the
#: highest power): below 0.46875 of erf(x) / x in x^2, below 4 of erfc(x) exp(x^2) in x, above that in 1 / x^2
_ERF_NEAR = (
    (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
_ERFC_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_ERFC_FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _polynomial(x: Column, factors: tuple[float, ...]) -> Column:
    value = F.lit(factors[0])
    for factor in factors[1:]:
        value = value * x + factor
    return value


def chi2_upper_tail(chi2: Column) -> Column:
    """P of a larger chi-square with one degree of freedom, the complementary error function of sqrt(chi2 / 2).

    NULL and NaN give NULL, numbers of 0 and less 1.
    """
    square = chi2 / 2
    x = F.sqrt(square)
    ratio = lambda at, parts: _polynomial(at, parts[0]) / _polynomial(at, parts[1])
    inverse = 1 / square
    far = F.exp(-square) / x * (F.lit(math.pi**-0.5) - inverse * ratio(inverse, _ERFC_FAR))
    return F.when(chi2.isNotNull() & ~F.isnan(chi2), F.when(chi2 <= 0, 1.0).when(x <= 0.46875, 1 - x * ratio(square, _ERF_NEAR)).when(x <= 4, F.exp(-square) * ratio(x, _ERFC_MIDDLE)).otherwise(far))


def screening(prr_column: str = "prr", ror_low: str = "ror_low", chi2: str = "chi2") -> Column:
    """Label of a table by reports, corrected PRR, lower limit of the ROR and observed chi-square."""
    enough = F.col("a") >= SCREEN_REPORTS
    return (
        F.when(enough & (F.col(prr_column) >= SCREEN_PRR) & (F.col(chi2) >= SCREEN_CHI2), MEETS)
        .when(enough & ((F.col(prr_column) >= SCREEN_PRR_LOW) | (F.col(ror_low) > 1)), INTERMEDIATE)
        .otherwise(BELOW)
    )


def exploratory_score(prr_column: str = "prr", chi2: str = "chi2") -> Column:
    """log2(PRR) * sqrt(chi-square); may be negative; 0 without a PRR."""
    return F.when(F.col(prr_column) > 0, F.log2(prr_column) * F.sqrt(chi2)).otherwise(0.0)


def with_statistics(cells: DataFrame) -> DataFrame:
    """``cells`` with PRR, ROR, their limits, chi-square, label and score. NULL cells give NULL statistics."""
    first = cells.withColumns({"zero_corrected": has_zero(), "prr": prr(), "ror": ror(), "chi2": yates_chi2()})
    low, high = prr_limits(F.col("prr"))
    low_r, high_r = ror_limits(F.col("ror"))
    wide = first.withColumns({"prr_low": low, "prr_high": high, "ror_low": low_r, "ror_high": high_r})
    return wide.withColumns({"outcome": screening(), "score": exploratory_score()})


def near(x: Column, y: Column, tolerance: float) -> Column:
    """Whether two numbers agree relative to the larger; two NULLs agree."""
    scale = F.greatest(F.abs(x), F.abs(y), F.lit(1e-300))
    return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise((x == y) | (F.abs(x - y) / scale <= tolerance))
