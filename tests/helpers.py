"""Where the driver tables are, and how frames are compared."""

import os

import pandas as pd

DATA = os.environ.get("TEST_DATA", "/root/testdata")


def same_rows(a, b) -> bool:
    """Whether two pandas frames hold the same columns and rows, in any order."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    cols = sorted(a.columns)
    text = lambda f: sorted(tuple("" if pd.isna(v) else str(v) for v in r) for r in f[cols].astype(object).itertuples(index=False))
    return text(a) == text(b)
