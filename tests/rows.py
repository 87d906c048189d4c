"""Comparable rows."""


def plain(df):
    """Rows of a pandas frame as comparable text, columns by name."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].astype(float).round(6) + 0.0
    rows = df.astype(object).where(df.notna(), None).astype(str).map(lambda s: s.removesuffix(".0"))
    return sorted(map(tuple, rows.to_numpy().tolist()))
