"""Streaming ingest: available-now runs are exactly-once across restarts."""

from wavepanel.sources.text import SNAPSHOT_FIELDS
from wavepanel.streaming.ingest import run_snapshot_ingest


def _write(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join("\t".join(r) for r in rows) + "\n")


def test_available_now_ingest_is_incremental(spark, tmp_path):
    row = [f"f{i}" for i in range(len(SNAPSHOT_FIELDS))]
    m1, m2 = tmp_path / "in" / "m1", tmp_path / "in" / "m2"
    _write(m1, "a.txt", [row, row[:5]])
    _write(m2, "a.txt", [row])
    out, bad, ck = str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "ck")
    folders = {"2026-03": str(m1), "2026-04": str(m2)}
    run_snapshot_ingest(spark, folders, out, bad, checkpoint_root=ck)
    got = spark.read.parquet(out)
    assert sorted((r[0], r[1]) for r in got.groupBy("extract_month").count().collect()) == [("2026-03", 1), ("2026-04", 1)]
    assert spark.read.parquet(bad).count() == 1
    # a new file arrives; the rerun reads only it
    _write(m1, "b.txt", [row, row])
    run_snapshot_ingest(spark, folders, out, bad, checkpoint_root=ck)
    assert spark.read.parquet(out).filter("extract_month = '2026-03'").count() == 3
