from __future__ import annotations

import hashlib
import io
import zipfile

import pytest

from wayspark.llm import zip_archive as za

SCHEMA = "page_id bigint, url string, html string, payload string, digest int, first string"
BIG = "<p>" + "x" * 200


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", 1, "f") for i, u, h in rows], SCHEMA)


ROWS = [(5, "u5", BIG), (2, "u2", BIG), (9, None, BIG), (3, "a\r\nb", "short"), (4, "u4", "short"), (6, "é", None), (7, "u", ""), (None, "n", BIG), (8, "u8", "é" * 50), (10, "u10", "é" * 50), (11, "u", "é" * 49 + "a"), (12, "u", "y" * 400_000)]


def test_round_trip(spark):
    got = {r["page_id"]: r for r in za.round_trip(frame(spark, ROWS), with_payload=True).collect()}
    assert len(got) == len(ROWS)
    for i, u, h in ROWS:
        data = (h or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        same = [j for j, _, g in ROWS if j is not None and (g or "") == (h or "")]
        keep = min(same) if len(data) >= 100 else i
        assert (r["record_type"], r["refers_to"]) == (("response", None) if keep == i else ("revisit", keep))
        assert r["payload"] == (data if keep == i else None)
    assert za.round_trip(frame(spark, [])).count() == 0
    twice = za.round_trip(frame(spark, [(1, "u", BIG)] * 2 + [(2, "u", BIG)])).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in twice) == [(1, "response"), (1, "response"), (2, "revisit")]


def test_many_packages_and_ranges(spark):
    rows = [(i, f"u{i}", f"{i} " * (i % 90)) for i in range(300)]
    folder = za.shared_dir(spark) + "/t"
    packages = za.write_archives(frame(spark, rows), folder, most_bytes=2000).cache()
    assert packages.count() > 3 and packages.selectExpr("sum(records)").first()[0] == 300
    for window in (1, 500, 1 << 20):
        got = {r["page_id"]: r["payload_bytes"] for r in za.read_archives(packages, window=window).collect()}
        assert got == {i: len(h) for i, _, h in rows}


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 a comment that looks like an end" + b"z" * 300])
def test_directories(monkeypatch, zip64, comment):
    if zip64:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for i in range(5):
            z.writestr(f"é{i}", bytes([i]) * (100 + i))
        z.writestr("packed", b"q" * 500, zipfile.ZIP_DEFLATED)
        z.comment = comment
    data = out.getvalue()
    f = io.BytesIO(data)
    found = za.members(f, len(data))
    assert set(found) == {f"é{i}" for i in range(5)} | {"packed"}
    for i in range(5):
        at = za.data_offset(f, found[f"é{i}"])
        assert data[at : at + found[f"é{i}"]["size"]] == bytes([i]) * (100 + i)
    with pytest.raises(ValueError):
        za.data_offset(f, found["packed"])
    with pytest.raises(ValueError):
        za.members(io.BytesIO(b"not a zip"), 9)
