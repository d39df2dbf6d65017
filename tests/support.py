"""What test modules share beside their fixtures."""

import datetime as dt

SF = "/root/testdata/sf0.001"


def rows(df, *order):
    """Rows as tuples, dates as ISO text, sorted."""
    def plain(v):
        if isinstance(v, dt.datetime):
            return v.isoformat(sep=" ")
        return v.isoformat() if isinstance(v, dt.date) else v
    out = [tuple(plain(v) for v in r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((v is not None, v) for v in r))
