"""Zip archives: lines as the whole text gives them, packed and unpacked piece by piece."""

import io
import zipfile

import pyarrow as pa
import pytest

from floodspark import params as P
from floodspark.session import ship_package
from floodspark.sources import archives as AR

TEXTS = ["", "one", "one\n", "a\r\nb\rc\n\nd\x85e\x0bf\n", "\r\n" * 9, "x" * 40 + "\r\n" + "é;1,5\r"]


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1000])
def test_lines_of_pieces_equal_lines_of_the_text(piece, monkeypatch):
    monkeypatch.setattr(AR, "PIECE", piece)
    for text in TEXTS:
        assert [x for part in AR._lines(io.BytesIO(text.encode(P.RAW_ENCODING))) for x in part] == text.splitlines()


def test_a_member_is_handed_on_in_pieces():
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m.csv", "station;1,5\n" * 400_000)
    batches = list(AR._unzip([pa.RecordBatch.from_arrays([pa.array(["a.zip"]), pa.array([packed.getvalue()])], names=["path", "content"])]))
    assert sum(b.num_rows for b in batches) == 400_000 and max(b.num_rows for b in batches) < 100_000
    assert [batches[-1].column("line_no")[-1].as_py(), batches[1].column("line_no")[0].as_py()] == [400_000, batches[0].num_rows + 1]


def test_round_trip(spark, tmp_path):
    ship_package(spark)
    rows = [(f"{y}.zip", m, n, f"{y} {m} {n}") for y in (2020, 2027) for m in ("b.csv", "a.csv") for n in range(1, 30_000 if m == "a.csv" else 4)]
    d = spark.createDataFrame(rows, "archive string, member string, line_no long, line string")
    AR.write_archives(d.repartition(5), f"{tmp_path}/z")
    got = AR.scan_archives(spark, f"{tmp_path}/z")
    assert sorted(map(tuple, got.drop("year_folder").collect())) == sorted(rows)
    assert {tuple(r) for r in got.select("archive", "year_folder").distinct().collect()} == {("2020.zip", "2020"), ("2027.zip", "temp")}
