"""Holding a registered query against its SQL on the given tables."""

import duckdb

MIDDLE = "/root/testdata/sf0.01"


def same_as_sql(spark, name, query, sql, sf_dir=MIDDLE, tables=("documents", "embeddings")):
    database = duckdb.connect()
    for t in tables:
        database.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cursor = database.execute(sql[name])
    names = [x[0] for x in cursor.description]
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    expected = sorted((tuple(plain(v) for v in row) for row in cursor.fetchall()), key=repr)
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == expected and expected
