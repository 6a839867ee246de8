"""Free-text questions built from sensor texts with bracketed daily lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .rng import draw
from .text import bracket_list

#: List name in a sensor text (spelt as the released texts spell it), name shown, decimals, unit (fixed values).
SENSORS = (
    ("Steps", "Steps", 1, "steps"),
    ("Burned Calorories", "Burned Calories", 1, "calories"),
    ("Resting Heart Rate", "Resting Heart Rate", 2, "beats/min"),
    ("SleepMinutes", "Sleep Minutes", 1, "minutes"),
)
MOOD = r"\[Mood\]: (\d+(?:\.\d+)?) out of 5"
INSTRUCTION = "You are an intelligent healthcare agent."
FRAME = "Instruction: {instruction}\nQuestion: {question}\nResponse:"
FORMAT = "For example, the answer should be in the following format:\nAnswer: "


@F.pandas_udf(StringType())
def _fixed(value: pd.Series, decimals: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v else f"{v:.{d}f}" for v, d in zip(value, decimals, strict=True)])


@F.pandas_udf(StringType())
def _fixed_list(values: pd.Series, decimals: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else "[" + ", ".join(f"{x:.{d}f}" for x in v) + "]" for v, d in zip(values, decimals, strict=True)])


@F.pandas_udf(StringType())
def _short(value: pd.Series) -> pd.Series:
    return value.map(lambda v: None if v is None or v != v else f"{v:g}")


def _checked(value: Column, what: str) -> Column:
    return F.when(value.isNull(), F.raise_error(F.lit(f"no {what} in sensor text"))).otherwise(value)


def _lists(text: Column) -> list[tuple[str, Column, int, str]]:
    return [(shown, _checked(bracket_list(text, name), f"{name} list"), d, unit) for name, shown, d, unit in SENSORS]


def _mood(text: Column) -> Column:
    return _short(_checked(F.nullif(F.regexp_extract(text, MOOD, 1), F.lit("")).cast("double"), "mood value"))


def averaged_question(text: Column) -> Column:
    """One paragraph with the mean of each list."""
    parts = [F.concat(F.lit(f"{shown}: "), _fixed(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v), F.lit(d)), F.lit(f" {unit}, ")) for shown, v, d, unit in _lists(text)]
    return F.concat(F.lit("The analysis of recent period: 14 days averaged sensor readings show: "), *parts, F.lit("Mood: "), _mood(text), F.lit(" out of 5. In this regard, what is the predicted stress score/level between 1 and 5?"))


def listed_question(text: Column) -> Column:
    """Every day's value, a line a sensor."""
    parts = [F.concat(F.lit(f"  • {shown}: "), _fixed_list(v, F.lit(d)), F.lit(f" {unit}\n")) for shown, v, d, unit in _lists(text)]
    return F.concat(F.lit("The analysis of recent 2-weeks sensor readings show:\n"), *parts, F.lit("  • Mood: "), _mood(text), F.lit(" out of 5\nIn this regard, can you predict user's stress level between 1 and 5?"))


def case_question(text: Column) -> Column:
    """Every day's value with one decimal, names in brackets."""
    parts = [F.concat(F.lit(f"[{shown}]: "), _fixed_list(v, F.lit(1)), F.lit(f" {unit}\n")) for shown, v, _, unit in _lists(text)]
    return F.concat(F.lit("The analysis of recent 2-weeks sensor readings show:\n"), *parts, F.lit("[Mood]: "), _mood(text), F.lit(" out of 5\nPlease return the stress level between 1 and 5."))


def framed(question: Column, heading: str = "") -> Column:
    """A question in the instruction frame; heading, such as "### ", goes before each of its lines."""
    head, tail = FRAME.format(instruction=INSTRUCTION, question="\x00").split("\x00")
    mark = lambda t: t.replace("Instruction:", f"{heading}Instruction:").replace("Question:", f"{heading}Question:").replace("Response:", f"{heading}Response:")
    return F.concat(F.lit(mark(head)), question, F.lit(mark(tail)))


def zero_shot(instruction: Column, body: Column, example: Column) -> Column:
    """Instruction, sensor text and an example answer of the given number."""
    return F.concat(instruction, body, F.lit(FORMAT), example.cast("string"))


def example_number(seed: int, item: Column) -> Column:
    """The example answer of an item, drawn from 0 to 5 by seed and item number."""
    return draw(F.lit(6), seed, item).cast("int")
