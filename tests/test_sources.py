"""Readers, sinks and decoders on small files, good and broken."""

import io
import struct
import zipfile

import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groupaudit.sources import audio, manifest, tables
from groupaudit.streaming import incremental


def wav(x, rate=16_000, channels=1):
    data = np.repeat((x * 32767).astype("<i2"), channels).tobytes()
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * 2 * channels, 2 * channels, 16)
    body = b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


SINE = 0.5 * np.sin(2 * np.pi * 200 * np.arange(50_000) / 50_000)


def test_decoders_and_reject_reasons(spark):
    files = [
        ("ok.wav", wav(SINE[:16_000])), ("stereo.wav", wav(SINE[:16_000], channels=2)), ("fast.wav", wav(SINE, rate=50_000)),
        ("cut.wav", wav(SINE)[:30]), ("empty.wav", wav(SINE[:0])), ("zero.wav", wav(np.zeros(16_000))),
        ("dc.wav", wav(np.full(16_000, 0.25))), ("short.wav", wav(SINE[:800])), ("noise.bin", b"hello"),
    ]
    got = {r["name"]: r for r in audio.decode(spark.createDataFrame(files, "name string, content binary")).collect()}
    assert len(got) == len(files)
    assert got["ok.wav"]["n_samples"] == got["stereo.wav"]["n_samples"] == 16_000
    assert got["ok.wav"]["sha256"] == got["stereo.wav"]["sha256"] != got["ok.wav"]["src_sha256"]
    assert got["fast.wav"]["n_samples"] == 16_000 and got["fast.wav"]["orig_sample_rate"] == 50_000
    why = {k: r["reason"] for k, r in got.items()}
    assert why["ok.wav"] is why["fast.wav"] is None
    assert why["cut.wav"].startswith("unreadable") and why["empty.wav"] == "too short (0.000s)" and why["noise.bin"] == "not a RIFF/WAVE file"
    assert why["zero.wav"] == "digital silence" and why["dc.wav"].startswith("constant") and why["short.wav"] == "too short (0.050s)"
    assert all(got[k]["pcm"] is None for k in why if why[k])


def test_a_batch_is_decoded_in_slices(monkeypatch):
    files = [wav(SINE[: 400 * k]) for k in range(1, 21)] + [b"noise"]
    batch = pa.RecordBatch.from_pydict({"name": [str(i) for i in range(21)], "content": files})
    whole = [r for b in audio._decode(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(audio, "SLICE_BYTES", 20_000)
    out = list(audio._decode(iter([batch.slice(0, 0), batch])))
    assert len(out) > 5 and all(b.num_rows == 1 or sum(len(files[int(n)]) for n in b["name"].to_pylist()) <= 20_000 for b in out)
    assert [r for b in out for r in b.to_pylist()] == whole and len(whole) == 21


def test_resampling_keeps_a_tone_and_removes_what_does_not_fit():
    t = np.arange(50_000) / 50_000
    y = audio.resample(np.sin(2 * np.pi * 1000 * t), 50_000)
    want = np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000)
    assert np.abs(y - want)[200:-200].max() < 0.01
    assert np.abs(audio.resample(np.sin(2 * np.pi * 12_000 * t), 50_000))[200:-200].max() < 0.02


def test_csv_union_with_bom_and_delimiters(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id;name ;x\n1; ann ;2\n".encode())
    (tmp_path / "b.csv").write_text("id,extra\n2,q;r\n")
    rows = {r["_archive"]: r.asDict() for r in tables.read_csv_union(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()}
    assert rows["a"]["name"] == "ann" and rows["a"]["id"] == "1" and rows["a"]["extra"] is None
    assert rows["b"]["extra"] == "q;r" and rows["b"]["x"] is None


def test_manifest_contract(spark, tmp_path):
    good = tmp_path / "m.csv"
    good.write_text("path,speaker_id,label,age\nwav/a-1.wav,s1,healthy,40\n/abs/b.wav,s2,ill,old\n")
    df = manifest.load_manifest(manifest.read_manifest(spark, str(good)), root="/data")
    rows = {r["recording_id"]: r for r in df.collect()}
    assert rows["a-1"]["abs_path"] == "/data/wav/a-1.wav" and rows["b"]["abs_path"] == "/abs/b.wav"
    assert rows["a-1"]["age"] == 40 and rows["b"]["age"] is None
    bad = tmp_path / "bad.csv"
    bad.write_text("path,label\na,b\n")
    with pytest.raises(ValueError, match="speaker_id"):
        manifest.read_manifest(spark, str(bad))
    with pytest.raises(ValueError, match="empty"):
        manifest.check_contract(df.where("label = 'none'"))


def test_both_sinks_conserve_rows(spark, tmp_path):
    rows = [("c", "a", None), ("c", "b", "too short"), ("d", "e", None)]
    df = spark.createDataFrame(rows, "corpus string, name string, reason string")
    manifest.write_outcomes(df, str(tmp_path / "o"))
    ok, bad = (spark.read.parquet(str(tmp_path / "o" / k)).count() for k in ("manifest", "failures"))
    assert (ok, bad) == (2, 1)


def test_archive_listing(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n in ("12-a/12-a_h.wav", "12-a/overview.csv", "x/7_b.NSP"):
            z.writestr(n, "abc")
    (tmp_path / "one.zip").write_bytes(buf.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"junk")
    members = tables.archive_members(tables.read_archives(spark, str(tmp_path)))
    inv = {r["archive"]: r for r in tables.archive_inventory(members, ["wav", "nsp"]).collect()}
    assert (inv["one.zip"]["n_members"], inv["one.zip"]["n_media"], inv["one.zip"]["n_groups"]) == (3, 2, 2)
    assert inv["one.zip"]["has_overview"] and inv["one.zip"]["n_bytes"] == 9
    assert inv["bad.zip"]["n_members"] == 0 and "unreadable" in inv["bad.zip"]["reason"]


def test_integrity_states_on_real_files(spark, tmp_path):
    for n, t in (("a", "abc"), ("b", "abc"), ("c", "abcd"), ("e", "zzz")):
        (tmp_path / n).write_text(t)
    md5 = "900150983cd24fb0d6963f7d28e17f72"
    listing = spark.createDataFrame([("a", 3, md5), ("b", 3, None), ("c", 3, md5), ("d", 3, md5)], "name string, size long, md5 string")
    got = {r["name"]: r["status"] for r in tables.integrity(listing, tables.present_files(spark, str(tmp_path))).collect()}
    assert got == {"a": "complete_verified", "b": "size_only", "c": "wrong_size", "d": "missing", "e": "unexpected"}


def test_feature_table_is_reused_by_content(spark, tmp_path):
    df = spark.createDataFrame([("r1", "s1", "h1"), ("r2", "s2", "h2")], "recording_id string, speaker_id string, sha string")
    key = tables.content_hash(df, digest="sha", policy={"pooling": "mean"}).first()["content_hash"]
    assert key == tables.content_hash(df.repartition(3), digest="sha", policy={"pooling": "mean"}).first()["content_hash"]
    assert key != tables.content_hash(df, digest="sha", policy={"pooling": "attention"}).first()["content_hash"]
    path = str(tmp_path / "f")
    assert tables.write_features(df, path, key) and not tables.write_features(df, path, key)
    assert tables.load_features(spark, path, key).count() == 2
    with pytest.raises(ValueError, match="speaker_id"):
        tables.write_features(df.drop("speaker_id"), path, "x")


def test_non_finite_features_are_refused(spark, tmp_path):
    rows = [("s1", [0.0, 1.0]), ("s2", [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "speaker_id string, features array<double>")
    path = str(tmp_path / "f")
    tables.write_features(df.where("speaker_id = 's1'"), path, "good")
    tables.write_features(df, path, "bad")
    assert tables.load_features(spark, path, "good").count() == 1
    with pytest.raises(ValueError, match="non-finite"):
        tables.load_features(spark, path, "bad")


def test_recordings_are_read_from_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1-a.wav").write_bytes(wav(SINE[:16_000]))
    (tmp_path / "d" / "2-a.wav").write_bytes(wav(SINE, rate=50_000))
    got = audio.decode(audio.read_recordings(spark, str(tmp_path / "d"))).collect()
    assert {(r["name"], r["orig_format"], r["reason"]) for r in got} == {("1-a.wav", "wav", None), ("2-a.wav", "wav", None)}


def test_incremental_run_picks_up_only_new_files(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.range(10)
    df.write.parquet(src)
    args = dict(source=src, schema=df.schema, out=str(tmp_path / "out"), checkpoint=str(tmp_path / "log"), transform=lambda d: d)
    assert incremental.extract_new(spark, **args) == 1 and incremental.extract_new(spark, **args) == 0
    spark.range(10, 15).write.mode("append").parquet(src)
    incremental.extract_new(spark, **args)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 15 and out.select("id").distinct().count() == 15
    assert incremental.remaining(spark.range(20), out, "id").count() == 5
    assert out.agg(F.max("id")).first()[0] == 14


def test_archive_larger_than_two_gigabytes_is_listed_from_its_end(spark, tmp_path, monkeypatch):
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        z.writestr("12-de/a b.wav", b"x" * 70)
        z.writestr("overview.csv", b"y")
    big = tmp_path / "big one.zip"
    with big.open("wb") as f:
        f.seek(3 << 30)  # a hole in front; the directory is found from the end
        f.write(content.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    files = tables.read_archives(spark, str(tmp_path))
    got = {r["archive"]: r for r in tables.archive_inventory(tables.archive_members(files), ["wav"]).collect()}
    assert (got["big one.zip"]["n_bytes"], got["big one.zip"]["n_members"], got["big one.zip"]["n_groups"]) == (71, 2, 1)
    assert got["big one.zip"]["has_overview"] and got["bad.zip"]["reason"].startswith("unreadable")

    read = []

    class Counted(io.FileIO):
        def readinto(self, b):
            read.append(super().readinto(b))
            return read[-1]

        def readall(self):
            return self.read(1 << 62)

        def read(self, n=-1):
            data = super().read(min(n, 1 << 20) if n >= 0 else 1 << 20)
            read.append(len(data))
            return data

    monkeypatch.setattr(tables, "opened", lambda p: Counted(p))
    listed = list(tables._list_members(iter([pd.DataFrame({"archive": ["big"], "path": [str(big)]})])))[0]
    assert len(listed) == 2 and sum(read) < 200_000


def test_written_archives_hold_their_members(spark, tmp_path):
    rows = [("a.zip", "7-x/1.wav", b"one"), ("a.zip", "8-x/2.wav", b""), ("b.zip", "n.txt", b"three")]
    df = spark.createDataFrame(rows, "archive string, member string, content binary")
    assert sorted(map(tuple, tables.write_archives(df, f"file:{tmp_path}").collect())) == [("a.zip", 2), ("b.zip", 1)]
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert {n: z.read(n) for n in z.namelist()} == {"7-x/1.wav": b"one", "8-x/2.wav": b""}
    assert not list(tmp_path.glob("_*"))


def test_headers_are_read_from_the_first_block(tmp_path):
    import gzip

    from groupaudit.sources.ranged import first_line

    (tmp_path / "a b%20.csv").write_bytes(b"\xef\xbb\xbfid;" + b"n" * 200_000 + b"\r\n1;2\n")
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(b"x,y\n1,2\n"))
    (tmp_path / "d.csv").write_bytes(b"")
    assert first_line(f"file:{tmp_path}/a b%20.csv") == "id;" + "n" * 200_000
    assert first_line(str(tmp_path / "c.csv.gz")) == "x,y" and first_line(f"file://{tmp_path}/d.csv") == ""
