"""Order-free comparison of two pandas tables."""


def cells(frame):
    cols = sorted(frame.columns)

    def one(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
        return str(v)

    return sorted(tuple(one(v) for v in row) for row in frame[cols].itertuples(index=False))


def assert_same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:  # counts with missing values come back as floats
        if got[c].dtype.kind == "f" and want[c].dtype.kind in "iu":
            want[c] = want[c].astype(float)
        if want[c].dtype.kind == "f" and got[c].dtype.kind in "iu":
            got[c] = got[c].astype(float)
    assert cells(got) == cells(want)
