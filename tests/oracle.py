"""Runs queries next to their SQL in DuckDB: python tests/oracle.py SF_DIR [NAME...]"""

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    import datetime
    import decimal

    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return float(v) if isinstance(v, int) else v


def compare(spark, sf_dir, name, query, sql):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = query(spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[k]) for k in columns) for r in got.collect()), key=repr)
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    want = sorted((tuple(plain(r[names.index(k)]) for k in columns) for r in cur.fetchall()), key=repr)
    if rows != want:
        bad = [(a, b) for a, b in zip(rows, want) if a != b][:2]
        return f"{len(rows)} rows, SQL has {len(want)}: {columns} {bad}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    from prosemill.plans import catalog

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name, query in catalog.QUERIES.items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            said = compare(spark, sys.argv[1], name, query, sql) if sql else f"no SQL, {query(spark, sys.argv[1]).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:1500]}"
        if said and not said.startswith("no SQL"):
            failed += 1
        print(f"{'ok' if not said or said.startswith('no SQL') else 'BAD'} {name} {time.time() - began:.1f}s {said}", flush=True)
    sys.exit(bool(failed))
