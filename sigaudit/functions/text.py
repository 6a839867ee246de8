"""Rendering windows as text, prompts, and reading numbers back out of answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Features whose high values speak for label 1, and for label 0 (fixed values).
STRESS_HIGH = frozenset(("hrv_mean_hr", "hrv_lf_hf", "eda_tonic_mean", "eda_tonic_std", "eda_phasic_std", "eda_scr_count", "eda_scr_amp_mean", "eda_level_mean", "eda_level_std"))
CALM_HIGH = frozenset(("hrv_mean_nn", "hrv_sdnn", "hrv_rmssd", "hrv_pnn50", "hrv_hf"))

#: Prompt templates in order of preference (fixed values).
TEMPLATES = {
    "instruction": "Classify this physiological recording.\n{choice}\n{exemplars}{body}\nAnswer:",
    "clinical": "You are scoring a 60-second wearable window for a binary state.\n{choice}\n{exemplars}{body}\nAnswer:",
    "minimal": "{choice}\n{exemplars}{body}\nAnswer:",
}
CHOICE = "A = {a}. B = {b}. Answer with a single token, A or B."


@F.pandas_udf(StringType())
def series_text(x: pd.Series, channel: pd.Series, fs: pd.Series, scheme: pd.Series) -> pd.Series:
    """channel, rate, length, scheme and the values with four significant digits."""
    return pd.Series([f"{c} fs={f:g} Hz n={len(v)} scheme={s}: " + " ".join(f"{i:.4g}" for i in v) for v, c, f, s in zip(x, channel, fs, scheme, strict=True)])


def votes(feature: str, value: Column, median: Column, negate: bool = False) -> Column:
    """+1 or -1 for a value above or not above the median of a feature that tells; 0 for others and missing values. A missing median
    counts as not exceeded."""
    sign = 1 if feature in STRESS_HIGH else -1 if feature in CALM_HIGH else 0
    above = F.coalesce(value > median, F.lit(False))
    return F.when(value.isNull(), 0).otherwise(F.when(above, sign).otherwise(-sign) * (-1 if negate else 1))


def verbalized(feature: str, value: Column, median: Column, percentile: Column | None = None, variant: str = "i") -> Column:
    """One sentence on a feature. i: elevated or reduced, with what that is typical of; ii: value and percentile; iii: i turned round."""
    shown = general(value)
    if variant == "ii":
        if percentile is None:
            raise ValueError("variant ii needs percentiles")
        text = F.concat(F.lit(f"{feature} is "), shown, F.lit(" (percentile "), F.rint(percentile).cast("int").cast("string"), F.lit(")."))
    elif variant in ("i", "iii"):
        above = F.coalesce(value > median, F.lit(False))
        above = above if variant == "i" else ~above
        high, low = ("stress-typical", "calmer-typical") if feature in STRESS_HIGH else ("calmer-typical", "stress-typical") if feature in CALM_HIGH else ("unspecified", "unspecified")
        text = F.concat(F.lit(f"{feature} is "), F.when(above, "elevated (").otherwise("reduced ("), shown, F.lit("), "), F.when(above, high).otherwise(low), F.lit("."))
    else:
        raise ValueError(f"unknown variant {variant}")
    return F.when(value.isNull(), f"{feature} is unavailable.").otherwise(text)


@F.pandas_udf(StringType())
def general(value: pd.Series) -> pd.Series:
    """Four significant digits, no trailing zeros."""
    return value.map(lambda v: None if v is None or v != v else f"{v:.4g}")


def prompt(body: Column, template: str, examples: Column | None = None, meanings: tuple[str, str] = ("calm", "stress")) -> Column:
    """A template with its body, and with examples: array of (body, token)."""
    if template not in TEMPLATES:
        raise ValueError(f"unknown template {template}")
    filled = TEMPLATES[template].replace("{choice}", CHOICE.format(a=meanings[0], b=meanings[1]))
    head, _, rest = filled.partition("{exemplars}")
    shown = F.lit("") if examples is None else F.when(F.size(examples) > 0, F.concat(F.lit("Examples:\n"), F.array_join(F.transform(examples, lambda e: F.concat(e["body"], F.lit("\nAnswer: "), e["token"], F.lit("\n"))), ""), F.lit("\n"))).otherwise("")
    return F.concat(F.lit(head), shown, body, F.lit(rest.removeprefix("{body}")))


def first_number(text: Column) -> Column:
    """The first number of a text as double; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def label_of(sentence: Column, strict: bool = True) -> Column:
    """N of a sentence '... is N'. If there is none, or no whole number of 32 bits: an error, or null if not strict."""
    found = F.nullif(F.regexp_extract(sentence, r"is (\d+)", 1), F.lit("")).try_cast("int")
    return F.coalesce(found, F.raise_error(F.lit("no label"))) if strict else found


def bracket_list(text: Column, name: str) -> Column:
    """The numbers of `[name]: [a, b, ...]`; null if absent or empty. Blank entries are passed over; one that is no number is null."""
    inner = F.regexp_extract(text, rf"\[{name}\]: \[([^\]]*)\]", 1)
    parts = F.filter(F.transform(F.split(inner, ","), lambda v: F.trim(v)), lambda v: v != "")
    return F.when(F.size(parts) > 0, F.transform(parts, lambda v: v.try_cast("double")))
