"""What several tests share."""

import os

DATA = "/root/testdata/sf0.001"


def compare(spark, queries, oracle, name, data=DATA):
    """Run a query and its SQL; both must give the same rows under the same columns."""
    import duckdb

    frame = queries[name](spark, data)
    columns = sorted(frame.columns)
    got = [tuple(r[c] for c in columns) for r in frame.collect()]
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    found = con.execute(oracle[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    norm = lambda v: round(v, 6) if isinstance(v, float) else tuple(map(norm, v)) if isinstance(v, list) else v
    key = lambda r: repr([norm(x) for x in r])
    assert sorted(map(key, got)) == sorted(key([r[i] for i in at]) for r in found.fetchall())
    return len(got)
