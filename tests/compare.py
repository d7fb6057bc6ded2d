"""Row-by-row comparison of a query with its SQL."""


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 8) + 0.0
    return v if isinstance(v, (int, bool, type(None))) else str(v)


def assert_same(df, con, sql):
    names = sorted(df.columns)
    q = con.execute(sql)
    theirs = [x[0] for x in q.description]
    assert sorted(theirs) == names
    want = sorted((tuple(plain(r[theirs.index(c)]) for c in names) for r in q.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    assert got == want
