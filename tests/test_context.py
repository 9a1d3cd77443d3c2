"""Snippets around a line, and the cases without one."""

from pyspark.sql import functions as F

from contract.views import view
from refscope.operators import context
from refscope.runtime import cut

FILES = "solution string, file_path string, text string"
TEXTS = [
    ("s", "five.cs", "1\r\n2\r3\n4\n5"),
    ("s", "empty.cs", ""),
    ("s", "trail.cs", "a\n"),
    ("s", "lib.DLL", "MZ\n\n"),
    ("s", "unread.cs", None),
]


def snippets(spark, positions):
    rows = spark.createDataFrame([("s", *p) for p in positions], "solution string, file_path string, start_line int, context_lines int")
    found = context.snippets(rows, spark.createDataFrame(TEXTS, FILES)).collect()
    return {
        (r["file_path"], r["start_line"], r["context_lines"]): (
            r["content"], r["first_line"], r["last_line"], r["truncated"], r["status"],
        )
        for r in found
    }


def test_snippets(spark):
    found = snippets(
        spark,
        [
            ("five.cs", 3, 1), ("five.cs", 3, 1), ("five.cs", 1, 1), ("five.cs", 5, 2), ("five.cs", 3, 9), ("five.cs", 6, 1),
            ("five.cs", 3, 0), ("five.cs", 0, 1), ("five.cs", 2, -1), ("empty.cs", 1, 1), ("trail.cs", 2, 0),
            ("lib.DLL", 1, 1), ("unread.cs", 7, 1), ("gone.cs", 4, 1),
        ],
    )
    assert found == {
        ("five.cs", 3, 1): ("2\n3\n4", 2, 4, False, "ok"),
        ("five.cs", 1, 1): ("1\n2", 1, 2, True, "ok"),
        ("five.cs", 5, 2): ("3\n4\n5", 3, 5, True, "ok"),
        ("five.cs", 3, 9): ("1\n2\n3\n4\n5", 1, 5, True, "ok"),
        ("five.cs", 3, 0): ("3", 3, 3, False, "ok"),
        ("five.cs", 6, 1): ("// Target line 6 is beyond file length (5 lines)", 6, 6, True, "beyond_end"),
        ("five.cs", 0, 1): ("// Error reading file: Target line must be 1 or greater (Parameter 'targetLine')", 0, 0, True, "bad_line"),
        ("five.cs", 2, -1): (
            "// Error reading file: Context lines cannot be negative (Parameter 'contextLines')", 2, 2, True, "negative_context",
        ),
        ("empty.cs", 1, 1): ("", 1, 1, True, "ok"),
        ("trail.cs", 2, 0): ("", 2, 2, False, "ok"),
        ("lib.DLL", 1, 1): ("", 1, 1, False, "empty_file"),
        ("unread.cs", 7, 1): ("", 1, 1, False, "empty_file"),
        ("gone.cs", 4, 1): ("// File not found: gone.cs", 4, 4, True, "missing_file"),
    }


def test_chunks_give_the_same_snippets(spark):
    texts = [*TEXTS, ("s", "long.cs", "\n".join(f"line {i}" for i in range(1, 24))), ("t", "five.cs", "x\n\n")]
    files = spark.createDataFrame(texts, FILES)
    asked = [(s, path, at, around) for s, path, _ in [*texts, ("s", "gone.cs", "")] for at in (-1, 0, 1, 2, 4, 5, 8, 9, 23, 24) for around in (-1, 0, 1, 4, 30)]
    rows = spark.createDataFrame(asked + asked[:3], "solution string, file_path string, start_line int, context_lines int")
    rows = rows.withColumn("size", F.lit("other")).withColumn("lines", F.lit(1))
    whole = sorted(map(tuple, context.snippets(rows, files).collect()))
    assert len(whole) == len(set(asked))
    for size in (1, 4, 64):
        chunks = context.chunk_lines(files, size)
        assert "Exchange" not in chunks._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, context.snippets_of_chunks(rows, chunks).collect())) == whole
    nothing = context.snippets_of_chunks(rows.limit(0), context.chunk_lines(files.limit(0)))
    assert nothing.collect() == []


def test_a_long_file_is_read_by_many_tasks(spark):
    lines = 200_000
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(lines)), lambda i: i.cast("string")), "\n")
    files = spark.range(1).select(F.lit("s").alias("solution"), F.lit("big.cs").alias("file_path"), text.alias("text"))
    rows = spark.range(1, lines + 1).selectExpr("'s' AS solution", "'big.cs' AS file_path", "cast(id AS int) AS start_line", "1 AS context_lines")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = context.snippets_of_chunks(rows, cut(context.chunk_lines(files), "chunks"))
        by_task = found.groupBy(F.spark_partition_id()).count().collect()
        ends = {r["start_line"]: r["content"] for r in found.where(F.col("start_line").isin(1, 64, 65, lines)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(by_task) == 4 and max(r["count"] for r in by_task) < lines / 2
    assert ends == {1: "1\n2", 64: "63\n64\n65", 65: "64\n65\n66", lines: f"{lines - 1}\n{lines}"}


USAGE = (
    "solution string, file_path string, start_line int, end_line int, context_lines int, code_text string,"
    " context_start_line int, context_end_line int, has_context boolean"
)


def test_attach_and_mark(spark):
    rows = [
        ("s", "five.cs", 3, 4, 1, "x", 0, 0, False),
        ("s", "five.cs", 2, 2, 0, "kept", 0, 0, False),
        ("s", "gone.cs", 2, 2, 1, "x", 0, 0, False),
    ]
    shown = context.marked_context(context.attach_context(spark.createDataFrame(rows, USAGE), spark.createDataFrame(TEXTS, FILES)))
    found = {(r["file_path"], r["start_line"]): (r["printed"], r["has_context"], r["context_start_line"]) for r in shown.collect()}
    assert found == {
        ("five.cs", 3): ("       2: 2\n>>>    3: 3\n>>>    4: 4", True, 2),
        ("five.cs", 2): ("Code: kept", False, 0),
        ("gone.cs", 2): ("Code: // File not found: gone.cs", False, 2),
    }


def test_mark_does_not_cut_long_numbers(spark):
    rows = [("s", "f", 12345, 12345, 1, "a\nb", 12345, 12346, True)]
    assert context.marked_context(spark.createDataFrame(rows, USAGE)).first()["printed"] == ">>> 12345: a\n    12346: b"


def test_context_of_every_line(spark):
    found = context.context_of_every_line(spark.createDataFrame(TEXTS, FILES), 1)
    got = {(r["file_path"], r["line_no"]): r["content"] for r in found.collect()}
    assert got[("five.cs", 1)] == "1\n2" and got[("five.cs", 3)] == "2\n3\n4" and got[("trail.cs", 2)] == "a\n"
    assert len(got) == 5 + 1 + 2
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_usages_reach_every_document_and_line(spark, tmp_path):
    spark.sql("SELECT id AS doc_id, array_join(array_repeat('x', cast(1 + id % 40 AS int)), '\r\n') AS text FROM range(1500)").write.parquet(f"{tmp_path}/documents.parquet")
    events = "SELECT id AS event_id, id % 7 AS user_id, 'view' AS event_type FROM range(90000)"
    spark.sql(events).write.parquet(f"{tmp_path}/events.parquet")
    rows = view(spark, str(tmp_path), "doc_usages").select("file_path", "start_line", "event_id").collect()
    assert len(rows) == 90000
    got = {(r.file_path, r.start_line) for r in rows}
    names = {f"docs/{i}.{'PNG' if i % 9 == 0 else 'txt'}" for i in range(1500)}
    assert names < {path for path, _ in got}
    lines = {i: {line for path, line in got if path.startswith(f"docs/{i}.")} for i in (38, 39, 1479)}
    assert max(lines[38]) == 41 and max(lines[39]) == 42 and max(lines[1479]) == 42 and min(lines[39]) == 0


def test_positions_of_a_file_are_grouped_in_one_exchange(spark, plans):
    files = spark.createDataFrame([("s", "a.cs", "1\r\n2\r3\n4")], "solution string, file_path string, text string")
    asked = spark.createDataFrame([("s", "a.cs", 3, 1)] * 2 + [("s", "a.cs", 9, 1)], "solution string, file_path string, start_line int, context_lines int")
    found = context.snippets(asked, files).select("start_line", "content", "status").collect()
    assert sorted(map(tuple, found)) == [(3, "2\n3\n4", "ok"), (9, "// Target line 9 is beyond file length (4 lines)", "beyond_end")]
    plan = next(plan for label, plan in plans if label == "asked")
    assert plan.count("Exchange hashpartitioning") == 1
