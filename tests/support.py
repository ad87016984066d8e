"""What several test modules share. Not a conftest: those of two folders have the
same module name, so nothing can be imported from one by that name."""

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]
