SMALL = "/root/testdata/sf0.001"


def same_rows(a, b) -> None:
    """Two pandas tables hold the same rows, whatever their order."""
    assert sorted(a.columns) == sorted(b.columns)
    key = lambda t: sorted(map(repr, t[sorted(t.columns)].astype(object).where(t[sorted(t.columns)].notna(), None).values.tolist()))
    assert key(a) == key(b)
