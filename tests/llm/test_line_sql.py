"""The SQL of line dedup means the same by repeated and missing ids as the operator."""

import random

from tallyvine.llm import queries


def test_repeated_and_missing_ids(spark, tmp_path):
    import duckdb

    rng = random.Random(6)
    lines = ["A line of more than twenty letters", " a LINE of more than twenty letters\t", "another line of more than twenty", "short", "", "ünïcode line of twenty letters é"]
    rows = [(rng.choice([None, *range(12)]), "\n".join(rng.choice(lines) for _ in range(rng.randrange(6))) if rng.random() < 0.9 else None) for _ in range(60)]
    rows += [(None, "only rows without an id have this line"), (None, "only rows without an id have this line"), (None, "only rows without an id have this line")]
    rows += [(50, "twice in one id and once in another"), (50, "twice in one id and once in another\nx"), (51, "twice in one id and once in another")]
    spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cols = "doc_id, n_lines, n_dropped, kept_sha256"
    want = con.execute(f"select {cols} from ({queries.ORACLE_SQL['op6_line_runs']})").fetchall()
    got = queries.op6_line_runs(spark, str(tmp_path)).select(*cols.split(", ")).collect()
    assert len(want) == len(rows) and sorted(map(str, map(tuple, got))) == sorted(map(str, want))
