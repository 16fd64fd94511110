"""Compare queries with their SQL from the command line: check_all.py FOLDER [KEY ...]."""

import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from compare import difference, duck  # noqa: E402

from skygrade.session import build_session  # noqa: E402


def main(folder, wanted):
    conf = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.checkpoint.dir": tempfile.mkdtemp()}
    spark = build_session("check", "local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(folder), entry.oracle_sql()
    failed = []
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        begun = time.time()
        try:
            df = run(spark, folder)
            note = difference(df, con, sqls[name]) if name in sqls else f"no SQL, {df.count()} rows"
        except Exception as error:
            note = f"{type(error).__name__}: {str(error)[:600]}"
        if note and not note.startswith("no SQL"):
            failed.append(name)
        print(f"{name:26s} {time.time() - begun:6.2f}s {note or 'ok'}", flush=True)
    print("orphan SQL:", sorted(set(sqls) - set(entry.queries())))
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1], set(sys.argv[2:]))
