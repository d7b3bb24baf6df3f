import pytest

from textloom.streaming import sessions


def run(spark, tmp_path, batches, schema, make, mode="append"):
    """Rows that a stream over JSON files gives, a file a batch."""
    source, name = tmp_path / "in", f"out_{abs(hash(str(tmp_path)))}"
    source.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_suppression_folds_over_accepted_times(spark, tmp_path):
    rows = [("a", "q", 0.0), ("a", "q", 1.0), ("a", "q", 1.6), ("a", "q", 2.9), ("a", "q", 3.1), ("a", "other", 0.5), ("b", "q", 0.2)]
    out = run(spark, tmp_path, [rows], "session string, signature string, at double", sessions.suppressed)
    assert sorted(out) == [("a", "other", 0.5), ("a", "q", 0.0), ("a", "q", 1.6), ("a", "q", 3.1), ("b", "q", 0.2)]


def test_tokens_assemble_across_batches(spark, tmp_path):
    first = [("s", 1, "Hel", False), ("s", 2, "Hello", True), ("t", 1, "Hi", True)]
    second = [("s", 3, " there", True), ("s", 4, "<end>", True), ("t", 2, "<fin>", True), ("t", 3, "<end>", True)]
    out = run(spark, tmp_path, [first + second], "session string, seq int, text string, is_final boolean", sessions.assembled)
    assert sorted(out) == [("s", "Hello there"), ("t", "Hi")]


@pytest.mark.parametrize("make, n", [(sessions.idle_sessions, 3), (sessions.tumbling_counts, 3)])
def test_windows_on_a_batch(spark, make, n):
    rows = [("2024-01-01 00:00:00", 1, "view"), ("2024-01-01 00:20:00", 1, "view"), ("2024-01-01 01:30:00", 1, "view"), ("2024-01-01 00:10:00", 2, "click")]
    df = spark.createDataFrame(rows, "ts string, user_id int, event_type string")
    assert make(df).count() == n
