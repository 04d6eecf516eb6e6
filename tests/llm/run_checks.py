"""Run the operators' queries against their SQL: python tests/llm/run_checks.py [sf_dir] [name part ...]"""

import sys
import time

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[2]))

from daywatch.llm.catalog import CHECKS, QUERIES  # noqa: E402
from daywatch.session import get_session  # noqa: E402
from tests.compare import connect, difference  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = get_session("llm", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name, fn in QUERIES.items():
        if wanted and not any(part in name for part in wanted):
            continue
        started = time.time()
        rows = fn(spark, sf_dir).toPandas()
        took = time.time() - started
        problem = difference(rows, con.execute(CHECKS[name]).df()) if name in CHECKS else None
        bad += problem is not None
        print(name, len(rows), f"{took:.1f}s", problem or ("ok" if name in CHECKS else "no SQL"), flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
