"""Sources and sinks against files made by the standard library."""

import gzip
import hashlib
import io
import json
import os
import struct
import tarfile

import pytest
import zstandard
from pyspark.sql import functions as F

from lodestrata.sources import archives, files


def tar_of(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("ln")
        link.type, link.linkname = tarfile.SYMTYPE, "a"
        t.addfile(link)
    return out.getvalue()


def test_tar(spark, tmp_path):
    data = [("a", b"x" * 2500), ("dir/b", b""), ("c", os.urandom(1000))]
    raw = tar_of(data)
    packed = {"p.tar": raw, "g.tar": gzip.compress(raw), "z.tar": zstandard.compress(raw)}
    for n, d in packed.items():
        (tmp_path / n).write_bytes(d)
    paths = archives.list_paths(spark, [str(tmp_path / n) for n in packed])
    rows = archives.tar_members(paths).orderBy("archive", "ordinal").collect()
    assert [(r.path, r.type, r.size) for r in rows[:4]] == [("a", "file", 2500), ("dir/b", "file", 0), ("c", "file", 1000), ("ln", "symlink", 0)] and len(rows) == 12
    assert [tuple(e) for e in rows[0].extents] == [(0, 2500)] and rows[3].link == "a"
    got = {}
    for r in archives.tar_pieces(paths, 999).orderBy("archive", "ordinal", "start").collect():
        got.setdefault((os.path.basename(r.archive), r.path), bytearray()).extend(r.data)
    assert got == {(n, k): d for n in packed for k, d in data if d}
    kinds = spark.createDataFrame(list(packed.items()), "n string, d binary").select("n", archives.kind(F.col("d")).alias("k"))
    assert dict(kinds.collect()) == {"p.tar": "plain", "g.tar": "gzip", "z.tar": "zstd"}
    (tmp_path / "cut.tar").write_bytes(raw[:1500])
    with pytest.raises(Exception):
        archives.tar_pieces(archives.list_paths(spark, [str(tmp_path / "cut.tar")])).collect()


def test_saved_image(spark, tmp_path):
    config = json.dumps({"rootfs": {"diff_ids": ["sha256:1", "sha256:2"]}}).encode()
    def save(name, images):
        (tmp_path / name).write_bytes(tar_of([("l1.tar", b"1"), ("c.json", config), ("l2.tar", b"2"), ("manifest.json", json.dumps(images).encode())]))
        return archives.saved_images(archives.list_paths(spark, [str(tmp_path / name)]))
    one = {"Config": "c.json", "Layers": ["l1.tar", "l2.tar"]}
    assert [(r.layer, r.path, r.diff_id) for r in save("ok.tar", [one]).orderBy("layer").collect()] == [(0, "l1.tar", "sha256:1"), (1, "l2.tar", "sha256:2")]
    for name, bad in (("two.tar", [one, one]), ("gone.tar", [{**one, "Layers": ["l1.tar", "no"]}]), ("ids.tar", [{**one, "Layers": ["l1.tar"]}])):
        with pytest.raises(Exception):
            save(name, bad).collect()


def test_zip_suffix(spark):
    df = spark.createDataFrame([(1, b"payload" * 9), (2, b""), (3, None)], "id long, data binary")
    z = df.withColumn("data", archives.zip_append(F.col("data"), F.lit(["b.json", "a"]), F.array(F.lit(b"{}"), F.lit(b"PK\x05\x06 inside"))))
    rows = [(r.id, r.payload_size, r.ordinal, r.name, bytes(r.body)) for r in archives.zip_entries(z).orderBy("id", "ordinal").collect()]
    assert rows == [(i, n, k, *e) for i, n in ((1, 63), (2, 0)) for k, e in enumerate((("b.json", b"{}"), ("a", b"PK\x05\x06 inside")))]
    assert archives.zip_entries(df).count() == 0
    with pytest.raises(Exception, match="does not end"):
        archives.zip_entries(z.withColumn("data", F.concat("data", F.lit(b"!")))).collect()


def test_bundles(spark, tmp_path):
    rows = [(b, "chunk", hashlib.sha256(b"%d" % (i % 7)).hexdigest(), i, b"%d" % (i % 7)) for b in ("x", "y") for i in range(20)]
    rows += [("x", "manifest", "m1", 0, b"MANI")]
    out = archives.write_bundles(spark.createDataFrame(rows, "bundle string, part string, key string, ordinal long, object binary"), str(tmp_path / "b"))
    made = {r.bundle: r for r in out.collect()}
    assert {k: r.entries for k, r in made.items()} == {"x": 8, "y": 7} and sorted(os.listdir(tmp_path / "b")) == ["x.zip", "y.zip"]
    index = archives.bundle_index(archives.list_paths(spark, [r.path for r in made.values()]))
    got = archives.bundle_objects(index).collect()
    assert len(got) == 15 and all(r.part == "manifest" or hashlib.sha256(bytes(r.object)).hexdigest() == r.key for r in got)
    with pytest.raises(Exception, match="damaged"):
        archives.bundle_objects(index.withColumn("start", F.col("start") - 1)).collect()


def test_tree_and_holes(spark, tmp_path):
    for d in ("a/b", "skip/me", "c"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "a/b/f").write_bytes(b"123")
    (tmp_path / "c/l").symlink_to("../a")
    rows = {r.path: r for r in files.tree(spark, str(tmp_path), ("skip", "a/none")).collect()}
    assert sorted(rows) == ["a", "a/b", "a/b/f", "c", "c/l"]
    assert rows["a/b/f"].size == 3 and rows["c/l"].link == "../a" and rows["a"].type == "dir"
    with open(tmp_path / "sparse", "wb") as f:
        f.write(b"x" * 4096)
        f.truncate(1 << 20)
        f.seek((1 << 20) + 4096)
        f.write(b"y" * 4096)
    (tmp_path / "dense").write_bytes(b"1")
    holes = files.probe_holes(spark.createDataFrame([(str(tmp_path / n),) for n in ("sparse", "dense")], "path string")).collect()
    assert all(r.path.endswith("sparse") and 4096 <= r.start < r.end <= (1 << 20) + 4096 for r in holes)


def test_small_formats(spark):
    lines = ["1 2 0:1 / /srv/a\\040b rw - t s", "short", "1 2 0:1 / /srv rw", "1 2 0:1 / /srvx rw", "1 2 0:1 / /srv/a\\040b rw", "1 2 0:1 / /srv/c\\134d rw"]
    got = {r.path for r in files.mounts_under(spark.createDataFrame([(x,) for x in lines], "value string"), "/srv").collect()}
    assert got == {"a b", "c\\d"}
    lists = spark.createDataFrame([(1, " g1 \n\n\tg2\r\n"), (2, "")], "id long, text string")
    assert [tuple(r) for r in files.generation_list(lists).orderBy("ord").collect()] == [(1, 0, "g1"), (1, 1, "g2")]
    with pytest.raises(Exception, match="names one twice"):
        files.generation_list(lists.withColumn("text", F.lit("a\na"))).collect()
    block = bytearray(1024 + 128)
    struct.pack_into("<I8xB23xI", block, 1024, 0xE0F5E1E2, 12, 1 << 21)
    df = spark.createDataFrame([(bytes(block),), (None,)], "d binary")
    assert [r[0] for r in df.select(files.super_block_size(F.col("d"))).collect()] == [1 << 33, None]
    with pytest.raises(Exception, match="no super block"):
        df.select(files.super_block_size(F.lit(bytes(2000)))).collect()
    c = spark.createDataFrame([('{"config": {"Cmd": ["a"], "User": "u"}, "os": "x"}',), ('{"Cmd": ["b"]}',)], "t string")
    assert [(r[0].cmd, r[0].user) for r in c.select(files.runtime_config(F.col("t"))).collect()] == [(["a"], "u"), (["b"], None)]
