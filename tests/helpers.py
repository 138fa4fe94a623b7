"""What tests share."""

import os

import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    """Rows as sorted text, columns by name, numbers rounded. Whole numbers beside nulls are floats in one engine's frames and not in the other's: they count as whole numbers."""
    frame = frame[sorted(frame.columns)]

    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, float):
            v = round(v, 6)
            return int(v) if v.is_integer() else v
        return v

    return sorted(repr([plain(v) for v in r]) for r in frame.itertuples(index=False))
