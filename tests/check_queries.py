"""Run registered queries against their SQL: python tests/check_queries.py [sf_dir] [name part ...]"""

import sys
import time
import traceback

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))

from tests.compare import connect, difference  # noqa: E402


def main() -> int:
    import __spark_entry__ as entry
    from daywatch.session import get_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = get_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(part in name for part in wanted):
            continue
        started = time.time()
        try:
            pdf = fn(spark, sf_dir).toPandas()
        except Exception as error:  # noqa: BLE001
            bad += 1
            lines = str(error).splitlines()[:6]
            print(f"ERROR {name}: {type(error).__name__} " + " | ".join(lines), flush=True)
            if wanted:
                traceback.print_exc(limit=-6)
            continue
        took = time.time() - started
        if name not in checks:
            print(f"rows  {name}: {len(pdf)} rows {took:.1f}s", flush=True)
            continue
        try:
            problem = difference(pdf, con.execute(checks[name]).df())
        except Exception as error:  # noqa: BLE001
            problem = f"SQL failed: {str(error)[:400]}"
        if problem:
            bad += 1
            print(f"DIFF  {name}: {problem[:700]}", flush=True)
        else:
            constant = [c for c in pdf.columns if len(pdf) > 3 and pdf[c].astype(str).nunique() == 1]
            print(f"ok    {name}: {len(pdf)} rows {took:.1f}s" + (f"  constant: {constant}" if constant else ""), flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
