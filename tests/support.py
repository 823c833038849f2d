"""Helpers shared by the tests of this folder."""


def rows(df, *cols):
    """Collect selected columns as sorted tuples."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
