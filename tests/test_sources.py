"""Files written by our own helpers, and streams."""

from __future__ import annotations

import datetime
import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionlake.plans import batch as B
from ionlake.plans.batch import nice_scale_bar, report, run_analyses, session
from ionlake.sources import header as H, spectra as X, stacks as S
from ionlake.streaming.watch import plane_totals_stream, sessions, windowed_counts


def acquisition(stack, labels, nominal, extra=b""):
    p, c, h, w = stack.shape
    head = bytearray(H.HEADER_BYTES)
    put = lambda at, fmt, v: struct.pack_into(fmt, head, at, v)
    for name, value in {"data_offset": H.HEADER_BYTES, "stage_x": -5, "stage_y": 7, "stage_z": -2, "duration_s": 60, "planned_planes": 99, "n_masses": c}.items():
        put(*H.BASIC[name], value)
    head[0x3D : 0x3D + 5] = b"NS50L"
    head[0x5C : 0x5C + 8], head[0x6C : 0x6C + 5] = b"04.03.26", b"12:30"
    head[1000:1009], head[2000:2009] = b"Poly_list", b"Poly_list"
    put(1000 + 0x34, "<I", 3)
    put(2000 + 0x34, "<I", w)
    put(2000 + 0x38, "<I", h)
    put(H.HEADER_BYTES - 68, "<I", 4000)
    for n, (label, mass) in enumerate(zip(labels, nominal, strict=True)):
        at = H.LABEL_AT + n * H.MASS_STRIDE
        head[at : at + len(label)] = label.encode()
        put(H.NOMINAL_AT + n * H.MASS_STRIDE, "<d", mass)
    for k, mass in enumerate((12.01, 26.0, 26.03, 0.0)):
        put(H.MASS_ROWS_AT + k * H.MASS_ROW_STRIDE + 32, "<d", mass)
    put(7600, "<i", 8000)
    put(24084, "<d", 1.5)
    put(7484, "<i", 2)
    for k, v in enumerate((750, 300, 200, 150, 100)):
        put(7492 + 4 * k, "<i", v)
    return bytes(head) + stack.astype("<u4").tobytes() + extra


@pytest.fixture(scope="module")
def stack():
    return np.random.default_rng(0).integers(0, 2**32, (4, 3, 16, 24), dtype=np.uint64)


@pytest.fixture(scope="module")
def folder(tmp_path_factory, stack):
    f = tmp_path_factory.mktemp("im")
    (f / "a.im").write_bytes(acquisition(stack, ["12C", "12C 14N", ""], [12.0, 26.02, 250.0]))
    (f / "b.im").write_bytes(acquisition(stack[:2], ["12C", "12C 14N", ""], [12.0, 26.02, 250.0]))
    return f


def test_header(stack):
    data = acquisition(stack, ["12C", "12C 14N", ""], [12.0, 26.02, 250.0])
    head = H.parse_header(data, len(data))
    assert (head["width"], head["height"], head["n_planes"], head["field_um"]) == (24, 16, 4, 4.0)
    assert [(c["label"], c["nom_mass"]) for c in head["channels"]] == [("12C", 12.0), ("12C 14N", 26.02), ("SE", 0.0)]
    full = H.full_metadata(data, [12.0, 26.02, 0.0])
    assert {k: v["row_index"] for k, v in full["mass_table"].items()} == {0: 0, 1: 2}
    assert full["selectors"]["d1_diameter_um"] == 300 and full["selectors"]["es_width_um"] is None
    assert full["layout_problems"] == [] and full["basic"]["stage_z"] == -2 and set(full["pending"].values()) == {None}
    assert len(H.layout_problems(b"\0" * 100)) == 3 and H.scalar(b"\0\0", 0, "<I") is None
    for broken in (data + b"x", data.replace(b"Poly_list", b"Nope_list")):
        with pytest.raises(ValueError):
            H.parse_header(broken, len(broken))


def test_stack_source(spark, folder, stack):
    tiles = S.read_stack(spark, f"{folder}/a.im", f"file://{folder}/b.im")
    assert tiles.count() == 18
    row = tiles.filter("acq_id = 'a.im' and plane = 2 and label = '12C 14N'").collect()
    assert len(row) == 1 and np.array_equal(np.array(row[0].counts).reshape(16, 24), stack[2, 1].astype(np.int64))
    v = S.to_voxels(tiles.filter("plane = 1 and ch_idx = 0 and acq_id = 'a.im'"))
    got = {(r.y, r.x): r.counts for r in v.collect()}
    assert got[15, 3] == stack[1, 0, 15, 3] and len(got) == 384
    back = S.to_tiles(v, 16, 24).first()
    assert back.counts == stack[1, 0].ravel().tolist()
    assert S.list_files(spark, str(folder)).count() == 2


def test_pushed_filters_skip_planes(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = S.StackReader({"path": f"{folder}/a.im"})
    kept = list(reader.pushFilters([EqualTo(("plane",), 3), GreaterThan(("plane",), 1), EqualTo(("label",), "12C")]))
    assert len(kept) == 1 and [p.plane for p in reader.partitions()] == [3]
    assert len(list(reader.read(reader.partitions()[0]))) == 1


def test_header_table(spark, folder):
    rows = {r.path.rsplit("/", 1)[-1]: r for r in S.read_headers(spark, str(folder)).collect()}
    assert rows["a.im"].n_planes == 4 and rows["b.im"].n_planes == 2
    assert rows["a.im"].full.mass_table[1].row_index == 2 and rows["a.im"].captured == datetime.datetime(2026, 3, 4, 12, 30)


def test_sessions_round_trip(spark, folder, tmp_path):
    tiles = S.read_stack(spark, f"{folder}/a.im")
    shifts = spark.createDataFrame([("a.im", 0, 1, -1)], "acq_id string, plane int, dy int, dx int")
    S.save_session(str(tmp_path / "s"), tiles, shifts=shifts, metadata={"operator": "x"})
    held = S.load_session(spark, str(tmp_path / "s"))
    assert held["tiles"].count() == 12 and held["shifts"].collect() == shifts.collect() and held["corrected"] is None and held["metadata"] == {"operator": "x"}
    with pytest.raises(FileNotFoundError):
        S.load_session(spark, str(tmp_path / "none"))
    S.add_to_journal(spark, str(tmp_path), "text", "c", "p")
    S.add_to_journal(spark, str(tmp_path), "text", "d", "p")
    assert spark.read.parquet(str(tmp_path / "journal")).count() == 2
    S.export_stack(tiles, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 12


def test_csv_and_xlsx(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Pt,X(V),X (amu),X(µm),D1,D2\n" + "\n".join(f"{k},{k * 2},{27 + k / 1000},{k},5,{(k - 3) ** 2 if k != 4 else ''}" for k in range(8)))
    rows = X.read_csv(spark, str(tmp_path / "s.csv")).orderBy("pt").collect()
    assert [r.counts for r in rows] == [9, 4, 1, 0, 0, 4, 9, 16] and rows[2].amu == rows[2].m == 27.002 and rows[2].v == 4 and rows[2].um == 2
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n0.0001,z\n9,w")
    bare = X.read_csv(spark, str(tmp_path / "t.csv")).orderBy("pt").collect()
    assert [(r.m, r.counts) for r in bare] == [(0, 1), (1, 2), (2, 0), (3, 9)]
    (tmp_path / "u.csv").write_text("pt,mass\n1,2\n2,3")
    with pytest.raises(ValueError):
        X.read_csv(spark, str(tmp_path / "u.csv"))
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>mass</t></si><si><r><t>cou</t></r><r><t>nts</t></r></si></sst>')
        cells = "".join(f'<row r="{k + 2}"><c r="A{k + 2}"><v>{20 + k}</v></c><c r="B{k + 2}"><v>{k * k}</v></c></row>' for k in range(5))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>{cells}</sheetData></worksheet>')
    (tmp_path / "w.xlsx").write_bytes(book.getvalue())
    assert [(r.m, r.counts) for r in X.read_xlsx(spark, str(tmp_path / "w.xlsx")).orderBy("m").collect()] == [(20 + k, k * k) for k in range(5)]
    assert X.column_number("AB3", 0) == 27 and X.column_number(None, 4) == 4


def test_streams(spark, folder, stack, tmp_path):
    q = plane_totals_stream(spark, str(folder)).writeStream.format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.path.rsplit("/", 1)[-1], r.plane): r.total for r in spark.table("totals").collect()}
    assert len(got) == 6 and got["a.im", 3] == float(stack[3].sum())
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(t0 + datetime.timedelta(minutes=m), 1, "a", 1.0) for m in (0, 10, 50, 130)]
    events = spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string, value double")
    assert sorted(r.n for r in windowed_counts(events).collect()) == [1, 3] and windowed_counts(events, slide="30 minutes").count() == 5
    assert sorted(r.n for r in sessions(events).collect()) == [1, 1, 2]
    events.write.parquet(str(tmp_path / "events"))
    live = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    q = live.writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("live").collect()) == [1, 3]


def test_batches(spark):
    rows = [("x", p, c, 0, k, n) for p in range(2) for k in range(4) for c, n in (("12C 15N", 4), ("12C 14N", 1000))]
    v = spark.createDataFrame(rows, "acq_id string, plane int, channel string, y int, x int, counts long")
    out = {r.spec: r for r in run_analyses(v, [{"numerator": "12C 15N", "denominator": "12C 14N"}, {"numerator": "12C 15N", "denominator": "12C 14N", "reference": 0.002, "name": "own"}, {"numerator": "12C 14N", "denominator": "zz"}]).collect()}
    assert out[0].reference == 0.0036765 and out[1].delta == pytest.approx(1000) and out[1].name == "own" and out[2].ratio is None
    lines = [r.line for r in report(run_analyses(v, [{"numerator": "12C 14N", "denominator": "zz"}])).collect()]
    assert lines == ["12C 14N/zz: N/A"]
    assert (nice_scale_bar(20), nice_scale_bar(1)) == (5, 0.5)
    assert session().conf.get("spark.sql.adaptive.enabled") == "true"


def test_folder_of_scans(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Pt,X(V),X (amu),X(µm),D1,D2\n" + "\n".join(f"{k},{k * 2},{27 + k / 1000},{k},5,{(k - 3) ** 2 if k != 4 else ''}" for k in range(8)))
    (tmp_path / "b.csv").write_text("mass,x,y\n" + "\n".join(f"{20 + k},{k % 2},{k * 10}" for k in range(5)))
    (tmp_path / "c.csv").write_text("a,b\n1,x\n2,y\n0.0001,z\n9,w")
    (tmp_path / "none.csv").write_text("pt,mass\n1,2\n2,3")
    out = X.read_scans(spark, str(tmp_path)).collect()
    by = {}
    for r in out:
        by.setdefault(r.scan_id.rsplit("/", 1)[-1], []).append(r)
    assert set(by) == {"a.csv", "b.csv", "c.csv"}
    for name, rows in by.items():
        alone = X.read_csv(spark, str(tmp_path / name)).orderBy("pt").collect()
        same = lambda a, b: a == b or (a is None and b != b) or (b is None and a != a)
        for a, b in zip(alone, sorted(rows, key=lambda r: r.pt), strict=True):
            assert all(same(a[c], b[c]) for c in ("pt", "amu", "v", "um", "m", "counts"))


def test_names_of_axes_agree(spark):
    from ionlake.functions.tables import axis_name

    names = ["X (amu)", "Mass", " AMU ", "X(V)", "X(µm)", "X(μm)", "counts 1", ""]
    held = spark.createDataFrame([(n,) for n in names], "n string").select("n", axis_name("n").alias("t")).collect()
    assert [r.t for r in held] == [X.tidy_name(r.n) for r in held]


def test_array_files(spark, folder, stack, tmp_path):
    tiles = S.read_stack(spark, f"{folder}/a.im", f"{folder}/b.im")
    rows = {r.acq_id: r for r in S.export_arrays(tiles, str(tmp_path / "n")).collect()}
    held = np.load(rows["a.im"].path)
    assert str(held["axes"]) == "ZCYX" and held["stack"].dtype == np.uint32 and np.array_equal(held["stack"], stack)
    S.export_arrays(tiles.filter("acq_id = 'a.im'"), str(tmp_path / "t"), "tiff").collect()
    data = (tmp_path / "t" / "a.im.tiff").read_bytes()
    assert data[:4] == b"II*\0" and b"hyperstack=true" in data
    at, pages = int.from_bytes(data[4:8], "little"), []
    while at:
        n = int.from_bytes(data[at : at + 2], "little")
        tag = {int.from_bytes(data[p : p + 2], "little"): int.from_bytes(data[p + 8 : p + 12], "little") for p in range(at + 2, at + 2 + 12 * n, 12)}
        pages.append(np.frombuffer(data[tag[273] : tag[273] + tag[279]], "<u4").reshape(tag[257], tag[256]))
        at = int.from_bytes(data[at + 2 + 12 * n : at + 6 + 12 * n], "little")
    assert np.array_equal(np.array(pages), stack.reshape(-1, *stack.shape[2:]))
    floats = tiles.filter("acq_id = 'b.im'").withColumn("counts", F.transform("counts", lambda c: c / 2))
    S.export_arrays(floats, str(tmp_path / "f"), "npz").collect()
    assert np.load(str(tmp_path / "f" / "b.im.npz"))["stack"].dtype == np.float32


def test_many_files_read_their_headers_in_tasks(spark, folder, monkeypatch):
    some = S.read_stack(spark, f"{folder}/a.im", f"{folder}/b.im").filter("plane = 1 and ch_idx = 0").collect()
    reader = S.StackReader({"paths": ",".join([f"{folder}/a.im", f"{folder}/b.im"] * 40)})
    splits = reader.partitions()
    assert len(splits) == 80 and all(s.head is None for s in splits)
    assert sum(b.num_rows for s in splits[:2] for b in reader.read(s)) == S.read_stack(spark, f"{folder}/a.im", f"{folder}/b.im").count()
    assert len(some) == 2


def test_printers(spark, folder):
    lines = [r.line for r in B.header_lines(S.read_headers(spark, str(folder))).filter("path like '%a.im'").orderBy("place").collect()]
    assert "n planes: 4" in lines and sum(x.startswith("channel ") for x in lines) == 3
    parts = spark.createDataFrame([(1, "A", 2, 0, 0.25, 100.0, 50.0, 200.0), (1, "A", 2, 1, 0.75, 1000.0, 500.0, 2000.0)], "acq_id int, channel string, k int, component int, weight double, mean_counts double, p5 double, p95 double")
    assert [r.line for r in B.mixture_lines(parts).orderBy("component").collect()] == ["A, component 1 of 2: weight 25.0%, mean 100.0, from 50.00 to 200.0", "A, component 2 of 2: weight 75.0%, mean 1000, from 500.0 to 2000"]
    stats = spark.createDataFrame([(1, "r", "A", 4, 0.5, 2.5, 10), (1, "none", None, 0, None, None, None)], "acq_id int, roi string, channel string, n_pixels long, fraction double, mean double, total long")
    assert sorted(r.line for r in B.roi_lines(stats).collect()) == ["none: empty", "r, A: 4 pixels (50.0%), mean 2.5, total 10"]
    table = spark.createDataFrame([(2, None), (1, "x")], "a int, b string")
    assert [r.line for r in B.text_table(table, ["a"]).orderBy("place").collect()] == ["a\tb", "1\tx", "2\tN/A"]
