"""Names made comparable: upper case, composed characters, no quotes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC, for which there is no built-in function."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def comparable_string(text: Column, drop: str = "'’", composed: bool = False) -> Column:
    """``composed``: the text is known to be composed (or ASCII) and stays in the JVM."""
    upper = F.upper(text)
    return F.translate(upper if composed else nfc(upper), drop, "")


def zip_name(name: Column | str) -> Column | str:
    """The name with ``.zip`` once."""
    if isinstance(name, str):
        return name if name.endswith(".zip") else name + ".zip"
    return F.when(name.endswith(".zip"), name).otherwise(F.concat(name, F.lit(".zip")))
