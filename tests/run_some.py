"""python tests/run_some.py SF module[,module] [query ...]: check the queries of some modules."""

import importlib
import sys

sys.path.insert(0, "tests")
sys.path.insert(0, ".")

import oracle  # noqa: E402

from barsmith.plans import registry  # noqa: E402
from barsmith.session import get_spark  # noqa: E402

sf, modules, wanted = sys.argv[1], sys.argv[2].split(","), sys.argv[3:]
for m in modules:
    importlib.import_module(f"barsmith.plans.{m}")
spark, path = get_spark(cores="8"), f"/root/testdata/sf{sf}"
con, bad = oracle.connect(path), 0
for name, e in registry.REGISTRY.items():
    home = registry.HOME[name].rsplit(".", 1)[-1]
    if home not in modules or (wanted and name not in wanted):
        continue
    try:
        ok, note = oracle.compare(spark, con, e, path)
    except Exception as exc:  # report and go on with the next query
        ok, note = False, f"{type(exc).__name__}: {str(exc)[:900]}"
    bad += not ok
    print("\nok  " if ok else "\nFAIL", name, note, flush=True)
print(f"\n{bad} failed")
