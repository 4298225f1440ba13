"""Column type classes of every query against its check SQL."""

import sys

sys.path.insert(0, "tests")
sys.path.insert(0, ".")

import oracle  # noqa: E402

from barsmith.plans import load_all  # noqa: E402  (loads without a session)

ENTRIES = load_all()

from pyspark.sql import SparkSession  # noqa: E402

SKIP = set(sys.argv[1:])


def kind(t: str) -> str:
    t = t.lower()
    if t in ("tinyint", "smallint", "integer", "int", "bigint", "hugeint", "uinteger", "ubigint",
             "long"):
        return "int"
    if t in ("double", "float"):
        return "float"
    if t.startswith("decimal"):
        return "decimal"
    if t in ("varchar", "string"):
        return "text"
    if t.startswith("timestamp"):
        return "timestamp"
    return t


spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config(
    "spark.ui.showConsoleProgress", "false").getOrCreate()
path = "/root/testdata/sf0.001"
con, bad = oracle.connect(path), 0
for name, e in ENTRIES.items():
    if e.sql is None:
        continue
    got = {f.name: kind(f.dataType.simpleString()) for f in e.plan(spark, path).schema}
    want = {r[0]: (kind(r[1]), r[1]) for r in con.execute(f"DESCRIBE {e.sql}").fetchall()}
    diff = {c: (got.get(c), want.get(c)) for c in {*got, *want}
            if c not in got or c not in want or got[c] != want[c][0] or want[c][1] == "HUGEINT"}
    if diff:
        bad += 1
        print("DIFF", name, diff, flush=True)
print(bad, "queries differ in type")
