import bz2
import datetime as dt
import gzip
import json

import pytest

from lagfield.plans import dataset
from lagfield.sources import publish
from lagfield.sources import readers as R
from lagfield.sources import writers as S


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def rows(df):
    return {r.ts: tuple(r)[1:] for r in df.collect()}


def test_first_row_per_minute_in_file_then_line_order(spark, tmp_path):
    base = put(tmp_path / "m", "a.lst", " 1991  31  0  1   -5  10\n1991 31 0 1 -6 11\n\n1991 31 0 2 -7 9999.99\n")
    put(tmp_path / "m", "b.lst", "1991 31 0 2 -99 -99\n1991 366 0 0 1 1\n")
    got = rows(R.scan_minute_indices(spark, f"{base}/*.lst"))
    assert got[dt.datetime(1991, 1, 31, 0, 1)] == (-5.0, 10.0)
    assert got[dt.datetime(1991, 1, 31, 0, 2)] == (-7.0, 9999.99)
    assert len(got) == 3
    masked = rows(R.scan_minute_indices(spark, f"{base}/*.lst", mask=True))
    assert masked[dt.datetime(1991, 1, 31, 0, 2)] == (-7.0, 9999.99)  # not a scan placeholder


def test_broken_file_is_left_out_whole(spark, tmp_path):
    base = put(tmp_path / "f", "good.lst", "1991 1 0 70.5\n1991 1 1 999.9\n1991 1\n")
    put(tmp_path / "f", "bad.lst", "1991 1 5 80\n1991 one 6 81\n")
    put(tmp_path / "f", "wide.lst", "1991 1 7 80 1 2\n")
    got = rows(R.scan_flux(spark, f"{base}/*.lst", mask=True))
    assert got == {dt.datetime(1991, 1, 1, 0): (70.5,), dt.datetime(1991, 1, 1, 1): (None,)}


def test_no_surviving_file_is_an_error(spark, tmp_path):
    base = put(tmp_path / "k", "bad.lst", "x y z w\n")
    with pytest.raises(ValueError):
        R.scan_kp(spark, f"{base}/*.lst")


def test_many_bad_files_are_left_out(spark, tmp_path):
    base = put(tmp_path / "q", "good.lst", "1991 1 0 10\n")
    for i in range(3):
        put(tmp_path / "q", f"bad{i}.lst", "1991 ? 0 10\n")
    assert len(rows(R.scan_kp(spark, f"{base}/*.lst"))) == 1


def test_damaged_files_are_left_out_and_named(spark, tmp_path):
    base = tmp_path / "d"
    put(base, "good.lst", "1991 1 0 10\n")
    lines = "".join(f"1991 {1 + i // 24} {i % 24} {i}\n" for i in range(5000)).encode()
    whole = gzip.compress(b"".join(lines.splitlines(True)[:20])) + gzip.compress(b"1991 300 1 7\n")  # two members
    files = {
        "cut.gz": gzip.compress(lines)[:-400],
        "flipped.gz": gzip.compress(lines)[:-8] + b"\0" * 8,
        "cut.bz2": bz2.compress(lines)[:-50],
        "whole.gz": whole,
        "nothing.lst": b"",
        "blank.lst": b"\n \n",
        "wide.lst": "1991 1 0 10\n".encode("utf-16"),
        "word.lst": b"1991 one 0 10\n",
    }
    for name, data in files.items():
        (base / name).write_bytes(data)
    series, damaged = R.scan_index_reported(spark, f"{base}/*", ("Year", "DOY", "Hour", "Kp_index"))
    got = {r.file.rsplit("/", 1)[1]: r.reason for r in damaged.collect()}
    assert set(got) == set(files) - {"whole.gz"}
    assert got["nothing.lst"] == "empty" and got["blank.lst"] == "no line could be read" and got["wide.lst"] == "not UTF-8"
    assert got["word.lst"] == "a line that cannot be parsed" and all(got[n].startswith("broken archive") for n in ("cut.gz", "flipped.gz", "cut.bz2"))
    want = {}
    for x in [b"1991 1 0 10", *gzip.decompress(whole).splitlines()]:
        year, day, hour, kp = map(int, x.split())
        want.setdefault(dt.datetime(year, 1, 1) + dt.timedelta(days=day - 1, hours=hour), float(kp))
    assert {r.ts: r.Kp_index for r in series.collect()} == want
    with pytest.raises(ValueError, match="broken archive"):
        R.scan_kp(spark, f"{base}/cut.gz")


def test_inventory(spark, tmp_path):
    base = put(tmp_path / "i", "a.lst", "1")
    put(tmp_path / "i", "b.lst", "22")
    got = R.inventory(spark, {"x": f"{base}/*.lst"}).first()
    assert (got.files, got.bytes) == (2, 3)
    with pytest.raises(FileNotFoundError):
        R.inventory(spark, {"x": f"{base}/*.lst", "y": str(tmp_path / "nowhere")})


def test_tsv_binds_by_header_name(spark, tmp_path):
    text = "Te1\tDateFormatted\tTimeFormatted\tAltitude\tXXLAT\tXXLON\tILAT\tGLAT\n"
    text += "2500\t1991-01-31\t00:10:20\t1200\t\t10\t45\t40\n"  # kept, XXLAT unknown
    text += "2500\t1991-01-31\tnonsense\t1200\t1\t10\t45\t40\n"  # kept without a time
    text += "2500\t1991-01-31\t00:10:20\t1200\t999\t10\t45\t40\n"
    text += "2500\t1991-01-31\t00:10:20\t1200\t1\t10\t90.1\t40\n"
    text += "2500\t1991-01-31\t00:10:20\tNaN\t1\t10\t90\t40\n"
    text += "2500\t1989-12-31\t00:10:20\t1200\t1\t10\t90\t40\n"
    text += "2500\tnever\t00:10:20\t1200\t1\t10\t90\t40\n"
    base = put(tmp_path / "o", "obs.tsv", text)
    raw = R.scan_observations(spark, f"{base}/obs.tsv")
    got = dataset.clean(raw).orderBy("DateTimeFormatted").collect()
    assert [r.DateTimeFormatted for r in got] == [None, dt.datetime(1991, 1, 31, 0, 10)]
    audit = [(r.removed, r.remaining) for r in dataset.audit(raw).orderBy("step").collect()]
    assert audit == [(1, 6), (1, 5), (1, 4), (2, 2)]


def test_stats_file_round_trip_and_plain_json(spark, tmp_path):
    (tmp_path / "stats.json").write_text(json.dumps({"mean": {"a": 1.5}, "std": {"a": 2.0}}))
    assert S.stats_as_maps(S.read_stats(spark, str(tmp_path / "stats.json"))) == ({"a": 1.5}, {"a": 2.0})
    (tmp_path / "half.json").write_text(json.dumps({"mean": {"a": 1.5}}))
    with pytest.raises(ValueError):
        S.read_stats(spark, str(tmp_path / "half.json"))
    made = []

    def compute():
        made.append(1)
        return spark.createDataFrame([("g", 1.0, 2.0)], "name string, mean double, std double")

    for _ in range(2):
        got = S.load_or_compute_stats(spark, str(tmp_path / "cache"), compute)
        assert S.stats_as_maps(got) == ({"g": 1.0}, {"g": 2.0})
    assert made == [1]


def test_unreadable_split_files_are_skipped(spark, tmp_path):
    S.write_split(spark.range(3).toDF("x"), str(tmp_path), "one")
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "broken.parquet").write_bytes(b"not parquet")
    assert R.load_all(spark, str(tmp_path)).count() == 3
    S.write_split(spark.range(0).toDF("x"), str(tmp_path), "none")
    named = R.skipped_files(spark, str(tmp_path)).collect()
    assert [r.file.rsplit("/", 1)[1] for r in named] == ["broken.parquet"] and named[0].reason.startswith("unreadable")


def test_a_failed_replacement_leaves_the_old_folder(spark, tmp_path):
    S.write_split(spark.range(3).toDF("x"), str(tmp_path), "one")
    broken = spark.range(5).selectExpr("CASE WHEN id = 4 THEN raise_error('stop') ELSE id END AS x")
    with pytest.raises(Exception, match="stop"):
        S.write_split(broken, str(tmp_path), "one")
    path = str(tmp_path / "one")
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["one"]
    assert publish.missing_files(spark, path).count() == 0
    # A replacement that died between its two renames is put back.
    (tmp_path / "one").rename(tmp_path / ("one" + publish.REPLACED))
    publish.restore(spark, path)
    assert spark.read.parquet(path).count() == 3
    S.write_split(spark.range(7).toDF("x"), str(tmp_path), "one")
    assert spark.read.parquet(path).count() == 7 and [p.name for p in tmp_path.iterdir()] == ["one"]
    next((tmp_path / "one").glob("*.parquet")).unlink()
    assert publish.missing_files(spark, path).count() == 1


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    schema, path = spark.range(1).toDF("x").schema, str(tmp_path / "b")
    for batch, n in (("a", 3), ("b", 4), ("a", 3), ("b", 2)):
        S.append_frozen(spark.range(n).toDF("x"), path, schema, batch)
    assert {r.batch: r["count"] for r in spark.read.parquet(path).groupBy("batch").count().collect()} == {"a": 3, "b": 2}


def test_frozen_schema_rejects_missing_columns(spark, tmp_path):
    schema = spark.range(1).toDF("x").schema
    S.append_frozen(spark.range(1).selectExpr("CAST(id AS int) AS x"), str(tmp_path / "f"), schema, "one")
    with pytest.raises(Exception):
        S.append_frozen(spark.range(1).selectExpr("'text' AS x"), str(tmp_path / "f"), schema, "one")


def test_row_keys_do_not_depend_on_the_layout(spark):
    from lagfield.operators.keyed import with_row_key

    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, None, 0.5), (1, "a", 0.5)] * 2, "i int, s string, x double")
    one = sorted(map(tuple, with_row_key(df.coalesce(1)).collect()), key=str)
    many = sorted(map(tuple, with_row_key(df.repartition(7)).collect()), key=str)
    assert one == many and len({r[3] for r in one}) == len(one) == 8


def test_many_equal_rows_unfold_in_blocks(spark):
    from lagfield.operators.keyed import with_row_key

    df = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS x", "CAST(NULL AS string) AS y")
    keyed = with_row_key(df, block=5)
    got = keyed.collect()
    assert len(got) == 1000 and len({r.row_key for r in got}) == 1000
    assert {int(r.row_key.split("-")[1]) for r in got if r.x == 0} == set(range(1, 335))
    assert sorted(r.row_key for r in got) == sorted(r.row_key for r in with_row_key(df).collect())


def test_files_to_splits(spark, tmp_path):
    lines = ["\t".join(["Te1", "DateFormatted", "TimeFormatted", "Altitude", "XXLAT", "XXLON", "ILAT", "GLAT"])]
    for i in range(60):
        lines.append(f"{2000 + i}\t1991-{'01-31' if i % 6 == 0 else '02-10'}\t{i % 24:02d}:{i % 60:02d}:20\t1500\t1\t10\t45\t40")
    lines += lines[3:5]  # repeated rows are rows
    base = put(tmp_path / "o", "obs.tsv", "\n".join(lines) + "\n")
    for day in (31, 41):
        put(tmp_path / "m", f"{day}.lst", "".join(f"1991 {day} {h} {m} {-h - m} {h}\n" for h in range(24) for m in range(0, 60, 2)))
        put(tmp_path / "x", f"{day}.lst", "".join(f"1991 {day} {h} {70 + h}\n" for h in range(24)))
        put(tmp_path / "k", f"{day}.lst", "".join(f"1991 {day} {h} {h}\n" for h in range(24)))
    raw = R.scan_observations(spark, f"{base}/obs.tsv")
    series = dataset.load_series(spark, *(f"{tmp_path / d}/*.lst" for d in "mxk"))
    saved, audit = dataset.create_dataset(raw, series, str(tmp_path / "out"), "1991-01-31", "1991-02-07", n_test=7)
    assert [tuple(r) for r in audit.collect()] == [tuple(r) for r in dataset.audit(raw).collect()]
    counts = {r.split: r["count"] for r in saved.groupBy("split").count().collect()}
    assert counts == {"test-storm": 10, "test-normal": 7, "train": 45}
    assert saved.select("row_key").distinct().count() == 62
    got = {r.Te1: r for r in saved.collect()}
    r = got[2008.0]  # 08:08 on day 41
    assert (r.AL_index_0, r.SYM_H_0, r.Kp_index, r.f107_index_0) == (-16.0, 8.0, 8.0, 78.0)
    assert R.load_split(spark, str(tmp_path / "out" / "split=train")).count() == 45
    assert publish.missing_files(spark, str(tmp_path / "out")).count() == 0
    again, _ = dataset.create_dataset(raw.repartition(5), series, str(tmp_path / "two"), "1991-01-31", "1991-02-07", n_test=7)
    assert {r.row_key for r in again.where("split = 'test-normal'").collect()} == {
        r.row_key for r in saved.where("split = 'test-normal'").collect()
    }


def test_the_audit_rides_on_the_one_scan_of_the_raw_rows(spark, tmp_path):
    """Every raw row passes a counter; the cleaning, its row keys and the audit take each of them once."""
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    text = "Te1\tDateFormatted\tTimeFormatted\tAltitude\tXXLAT\tXXLON\tILAT\tGLAT\n"
    text += "".join(f"{2000 + i}\t1991-01-31\t00:10:20\t{900 + 10 * i}\t{999 if i % 9 == 0 else 1}\t10\t45\t40\n" for i in range(90))
    raw = R.scan_observations(spark, f"{put(tmp_path / 'o', 'obs.tsv', text)}/obs.tsv")
    counted = raw.mapInArrow(passed, raw.schema)
    table, audit = dataset.clean_audited(counted)
    assert seen.value == 90
    assert [tuple(r) for r in audit.collect()] == [tuple(r) for r in dataset.audit(raw).collect()]
    assert table.count() == audit.collect()[-1].remaining
