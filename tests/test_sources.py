from __future__ import annotations

import gzip
import io
import struct
import tarfile

import numpy as np
import pytest

from nearfield.sources import files, log


def records(rows, code):
    return b"".join(struct.pack(f"<I{len(r)}{code}", len(r), *r) for r in rows)


def test_readers(spark, tmp_path):
    (tmp_path / "a.fvecs").write_bytes(records([(1.5, 2.5), (3.5, 4.5)], "f"))
    (tmp_path / "mixed.fvecs").write_bytes(records([(1.0, 2.0, 3.0), (4.0,)], "f"))
    (tmp_path / "a.bvecs.gz").write_bytes(gzip.compress(records([(1, 2, 3), (4, 5, 6)], "B")))
    (tmp_path / "a.bin").write_bytes(files.flat_bytes(np.array([[1, 2], [3, 4], [5, 6]])) + b"tail")
    read = lambda name: [tuple(r) for r in files.read_any(spark, str(tmp_path / name)).collect()]
    assert read("a.fvecs") == [(0, [1.5, 2.5]), (1, [3.5, 4.5])]
    assert read("mixed.fvecs") == [(0, [1.0, 2.0, 3.0]), (1, [4.0])]
    assert read("a.bvecs.gz") == [(0, [1.0, 2.0, 3.0]), (1, [4.0, 5.0, 6.0])]
    assert read("a.bin") == [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])]
    body = records([(10, 20)], "I")
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as tar:
        info = tarfile.TarInfo("x/truth.ivecs")
        info.size = len(body)
        tar.addfile(info, io.BytesIO(body))
    assert [tuple(r) for r in files.read_ground_truth(spark, str(tmp_path / "t.tar.gz")).collect()] == [(0, 1, 10), (0, 2, 20)]
    assert files.convert(spark, str(tmp_path / "a.bin"), str(tmp_path / "out")) == 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    with pytest.raises(ValueError, match="dimension"):
        files.convert(spark, str(tmp_path / "mixed.fvecs"), str(tmp_path / "out2"))
    with pytest.raises(ValueError, match="extension"):
        files.read_any(spark, "x.csv")


def test_large_files_are_read_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "WHOLE", 100)
    rows = [(float(i), i / 2, -1.0) for i in range(500)]
    (tmp_path / "f").mkdir()
    (tmp_path / "f/large.fvecs").write_bytes(records(rows, "f"))
    (tmp_path / "f/small.fvecs").write_bytes(records([(7.0, 8.0)], "f"))
    (tmp_path / "b.bvecs").write_bytes(records([(i % 256, 1) for i in range(300)], "B"))
    got = files.read_fvecs(spark, str(tmp_path / "f")).collect()
    assert sorted(map(tuple, got)) == sorted([(i, list(r)) for i, r in enumerate(rows)] + [(0, [7.0, 8.0])])
    got = files.read_any(spark, str(tmp_path / "b.bvecs")).collect()
    assert sorted(map(tuple, got)) == [(i, [float(i % 256), 1.0]) for i in range(300)]
    (tmp_path / "torn.fvecs").write_bytes(records(rows, "f")[:-1])
    with pytest.raises(ValueError, match="truncated"):
        files.read_any(spark, str(tmp_path / "torn.fvecs"))


def test_damaged():
    with pytest.raises(ValueError, match="payload truncated"):
        list(files.parse_flat(struct.pack("<IQ", 2, 3) + b"\0" * 8))
    with pytest.raises(ValueError, match="small"):
        list(files.parse_flat(b"123"))
    with pytest.raises(ValueError, match="truncated"):
        list(files.parse_records(records([(1.0, 2.0)], "f")[:-1], "<f4"))
    with pytest.raises(ValueError, match="ivecs"):
        out = io.BytesIO()
        tarfile.open(fileobj=out, mode="w:gz").close()
        list(files.parse_truth(out.getvalue()))
    data = files.encode_record(5, [1.0, 2.0]) + struct.pack("<Q", 8) + b"12345678" + files.encode_record(6, [])
    assert list(files.decode_records(data + b"\x40")) == [(5, [1.0, 2.0]), (6, [])]


def test_log(spark):
    rows = [(1, "I", 1, [1.0], 0), (2, "I", 1, [2.0], 0), (3, "D", 2, None, 1), (1, "I", 2, [5.0], 1), (4, "I", 2, [6.0], 1), (5, "D", 3, None, 1), (2, "I", 3, [1.0], 1)]
    frame = spark.createDataFrame(rows, log.SCHEMA)
    assert sorted((r["vec_id"], r["embedding"]) for r in log.live(frame).collect()) == [(1, [2.0]), (2, [6.0])]
    assert [r["vec_id"] for r in log.deleted(frame).collect()] == [3]
    assert sorted(map(tuple, log.entry_counts(frame).collect())) == [(0, 2, 56), (1, 5, 132)]
