"""Files as tables, the price stream, and the driver's contract."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from evidentia.sources import files
from evidentia.streaming import market

SF = "/root/testdata/sf0.001"


def test_evidence_batch(spark, tmp_path):
    evidence = {"type": "paper", "title": "T", "source": "S", "year": 2020, "url": "u", "excerpt": "e"}
    batch = {"ingredients": [{"cn_name": "水", "inci_name": "WATER", "assertions": []}, {"cn_name": "烟酰胺", "inci_name": "NIACINAMIDE", "assertions": [{"efficacy": "美白", "effective_conc_low": 2, "evidence": evidence}]}]}
    (tmp_path / "a.json").write_text(json.dumps(batch, indent=1, ensure_ascii=False))
    rows = {r.inci_name: r for r in files.evidence_batch(spark, f"file://{tmp_path}").collect()}
    assert rows["WATER"].effect is None and rows["NIACINAMIDE"].effective_low == 2.0 and rows["NIACINAMIDE"].title == "T"


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    header = "Label,Brand,Name,Price,Rank,Ingredients,Combination,Dry,Normal,Oily,Sensitive\n"
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbf" + (header + 'Cream,A,"N ""x""\nline",10,4.5,"Water, Glycerin",1,0,1,0,1\n').encode())
    row = files.benchmark_csv(spark, f"file://{tmp_path}/b.csv").first()
    assert (row.Label, row.Name, row.Price, row.skin) == ("Cream", 'N "x"\nline', 10.0, [1, 0, 1, 0, 1])


def test_scanned_lines(spark, tmp_path):
    page = {"pdf": "book.pdf", "page": 3, "text": "t", "width": 100, "lines": [{"box": [[1, 2], [9, 2], [9, 4], [1, 4]], "text": "x", "score": 0.9}]}
    (tmp_path / "c.jsonl").write_text(json.dumps(page) + "\n" + json.dumps(page | {"pdf": "other.pdf"}) + "\n")
    row = files.ocr_boxes(spark, f"file://{tmp_path}/c.jsonl", "book").collect()
    assert [(r.left, r.right, r.top, r.bottom, r.text) for r in row] == [(1.0, 9.0, 2.0, 4.0, "x")]
    with pytest.raises(ValueError):
        files.check_complete(files.json_lines(spark, f"file://{tmp_path}/c.jsonl", "pdf string"), "pdf", 3)


def test_price_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    source = f"file://{tmp_path}/in"
    for day, part in (("a", "ts < '2024-01-10'"), ("b", "ts >= '2024-01-10'")):
        events.where(part).coalesce(1).write.mode("append").parquet(source)
    stream = market.snapshots(market.price_events(spark, source, max_files=1), late="60 days")
    query = market.fold_into(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    query.awaitTermination(120)
    last = max(int(p.name.split("-")[1]) for p in (tmp_path / "out").iterdir())
    assert last >= 1
    found = spark.read.parquet(f"file://{tmp_path}/out/current-{last}")
    want = events.selectExpr("user_id as product_id", "to_date(ts) as date", "event_type as source", "value as price", "row_number() over (partition by user_id, to_date(ts), event_type order by ts desc, event_id desc) as n").where("n = 1")
    assert found.count() == want.count()
    assert found.select("product_id", "date", "source", "price").exceptAll(want.drop("n")).count() == 0
    # nothing new: the query resumes from its checkpoint and changes nothing
    again = market.fold_into(market.snapshots(market.price_events(spark, source, max_files=1), late="60 days"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    again.awaitTermination(120)
    assert max(int(p.name.split("-")[1]) for p in (tmp_path / "out").iterdir()) >= last


def test_price_stream_by_buckets(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    few = events.select("user_id").distinct().orderBy("user_id").limit(2).collect()
    parts = ["ts < '2024-01-10'", "ts >= '2024-01-10' and ts < '2024-01-16'", "ts >= '2024-01-16'"]
    for part in parts:
        events.where(part).coalesce(1).write.mode("append").parquet(source)
    for value in (1e6, 2e6):  # two small batches, of one product each
        events.where(f"user_id = {few[0][0]}").orderBy("event_id").limit(1).selectExpr(f"event_id + {int(value)} as event_id", "timestamp '2024-01-31 00:00:00' as ts", "user_id", "event_type", f"double({value}) as value", "props").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = market.snapshots(market.price_events(spark, source, max_files=1), late="60 days")
        query = market.fold_into_buckets(stream, out, f"file://{tmp_path}/cp", buckets=8)
        query.awaitTermination(200)
        assert query.exception() is None

    run()
    found = market.current(spark, out)
    every = spark.read.parquet(source)
    want = every.selectExpr("user_id as product_id", "to_date(ts) as date", "event_type as source", "value as price", "row_number() over (partition by user_id, to_date(ts), event_type order by ts desc, event_id desc) as n").where("n = 1")
    assert found.count() == want.count() and found.select("product_id", "date", "source", "price").exceptAll(want.drop("n")).count() == 0
    folders = {p.name: len(list(p.glob("bucket=*"))) for p in (tmp_path / "out" / "rows").iterdir()}
    # a small batch writes one bucket, and no bucket has more than two versions
    assert folders["batch=3"] == folders["batch=4"] == 1
    versions = [b.name for p in (tmp_path / "out" / "rows").iterdir() for b in p.glob("bucket=*")]
    assert max(versions.count(x) for x in versions) == 2
    run()  # nothing new
    assert market.current(spark, out).exceptAll(found).count() == 0
    assert market.current(spark, f"file://{tmp_path}/none") is None


def test_windows_close(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    events.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    windows = market.windowed_prices(market.price_events(spark, f"file://{tmp_path}/in"))
    query = windows.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    closed = spark.sql("select * from windows")
    last = closed.selectExpr("max(window_start) as t").first().t
    want = events.groupBy(events.ts.cast("date").alias("day"), "event_type").count().where(f"day <= date'{last}'").count()
    assert closed.count() == want


def test_entry_and_oracles(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 50


def test_library_without_the_llm_folders(tmp_path):
    """The entry module and the other queries must import where the llm folders are gone."""
    root = Path(__file__).resolve().parents[1]
    (tmp_path / "evidentia").mkdir()
    for name in ("__spark_entry__.py", *[f"evidentia/{p.name}" for p in (root / "evidentia").iterdir() if p.name not in ("llm", "__pycache__")]):
        os.symlink(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and not any(k.startswith('op') for k in e.queries()); print(len(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
