"""Is a difference explained by writing numbers as text? Spark has no rounding to figures and no single precision inside doubles, so this is an Arrow UDF over whole columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Decimal places or figures that are tried, and the relative errors under which a difference is negligible or a likely rounding.
DIGITS = np.arange(2, 8)
NEGLIGIBLE, LIKELY, ALIKE = 1e-7, 1e-5, 1e-12
PLACES_FLOOR, FIGURES_FLOOR = 1e-10, 1e-100
EXPLANATIONS = {
    "non_float": "exact mismatch of a field that is no number with decimals",
    "negligible": "numbers differ by less than 0.1 ppm",
    "ascii_rounding": "the number was written with few decimals or figures: a limit of the text format, no loss of data",
    "large_error": "more than the text format explains; look into it",
}


def _met(original: np.ndarray, value: np.ndarray, scale: np.ndarray, floor: float) -> np.ndarray:
    """Of each column: is the value, or the value as single precision holds it, a whole number of steps, and the nearest such number to the original?

    A step is 1 / scale; there is a row of scales for each number of digits. Where two multiples are equally near, either will do.
    """
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        multiple = np.rint(value * scale) / scale
        single = multiple.astype(np.float32).astype(np.float64)
        within = ALIKE * np.maximum(np.abs(value), floor)
        alike = (np.abs(multiple - value) < within) | (np.abs(single - value) < within)
        return (alike & (np.abs(multiple - original) <= (0.5 + 1e-9) / scale)).any(axis=0)


def rounded_to_places(original: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _met(original, value, np.repeat(10.0 ** DIGITS[:, None], len(value), axis=1), PLACES_FLOOR)


def rounded_to_figures(original: np.ndarray, value: np.ndarray) -> np.ndarray:
    real = (original != 0) & (value != 0) & np.isfinite(original)
    top = np.floor(np.log10(np.abs(np.where(real, original, 1.0))))
    with np.errstate(over="ignore"):
        return real & _met(original, value, 10.0 ** (DIGITS[:, None] - 1 - top), FIGURES_FLOOR)


def categories(original: np.ndarray, value: np.ndarray, error: np.ndarray) -> np.ndarray:
    """non_float, negligible (under 1e-7), ascii_rounding or large_error of each element; NaN stands for no number."""
    number = ~(np.isnan(original) | np.isnan(value) | np.isnan(error))
    out = np.full(len(original), "non_float", dtype=object)
    out[number] = "large_error"
    out[number & (error < LIKELY)] = "ascii_rounding"
    out[number & (error < NEGLIGIBLE)] = "negligible"
    open_ = np.flatnonzero(number & (error >= LIKELY))
    explained = rounded_to_places(original[open_], value[open_]) | rounded_to_figures(original[open_], value[open_])
    out[open_[explained]] = "ascii_rounding"
    return out


@F.pandas_udf(T.StringType())
def _category(original: pd.Series, value: pd.Series, error: pd.Series) -> pd.Series:
    return pd.Series(categories(*(x.to_numpy(dtype=np.float64, na_value=np.nan) for x in (original, value, error))), dtype=object)


def difference_category(original: Column, value: Column, error: Column) -> Column:
    return _category(original.try_cast("double"), value.try_cast("double"), error)


def expected_rounding(kind: Column) -> Column:
    return kind.isin("negligible", "ascii_rounding")


def explanation(kind: Column, error: Column) -> Column:
    """What a category says about its difference, with the relative error if there is one."""
    text = F.element_at(F.create_map(*[F.lit(x) for pair in EXPLANATIONS.items() for x in pair]), kind)
    return F.when(error.isNotNull(), F.concat(text, F.lit(" (relative error "), F.format_string("%.2e", error), F.lit(")"))).otherwise(text)


def relative_error(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.lit(1e-300))


def is_close(a: Column, b: Column, tolerance: float) -> Column:
    """``abs(a - b) <= tolerance * max(abs(a), abs(b))``; NaN is close to nothing, equal infinities are close."""
    return ~F.isnan(a) & ~F.isnan(b) & ((a == b) | (~a.isin(float("inf"), float("-inf")) & ~b.isin(float("inf"), float("-inf")) & (F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b)))))
