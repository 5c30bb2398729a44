"""List physical operators worth a second look in every registered plan: python tools/plans.py [key-prefix ...]

Only the last plan of a key is seen: what a key has written and read back on its way is behind a scan.
"""

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from ledgerloom.plans import registry  # noqa: E402
from ledgerloom.session import local_session  # noqa: E402

SUSPECTS = ["CartesianProduct", "BroadcastNestedLoopJoin", "Arguments: SinglePartition", "BatchEvalPython"]


def main():
    spark = local_session("plans")
    spark.sparkContext.setLogLevel("ERROR")
    # Show the plan large tables would get: only tiny sides may be broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if "--no-broadcast" in sys.argv else "10485760")
    keys = [a for a in sys.argv[1:] if not a.startswith("--")]
    for key, fn in registry.load()[0].items():
        if keys and not any(key.startswith(k) for k in keys):
            continue
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            fn(spark, "/root/testdata/sf0.001").explain("formatted")
        text = out.getvalue()
        tree = text.split("\n\n")[0]
        found = [s for s in SUSPECTS if s in text]
        windows = re.findall(r"Arguments: \[row_number.*|Arguments: \[.*windowspecdefinition\((?:rows|range|unbounded).*", text)
        print(f"{key:24} exchanges={len(re.findall(r'- Exchange', tree)):3} codegen={len(re.findall(r'[*] ', tree)):3} {found} {len(windows) or ''}", flush=True)
        if "--show" in sys.argv:
            print(text)
    spark.stop()


if __name__ == "__main__":
    main()
