"""Extraction by rules, a store in a folder, and its list of generations, on real files."""

import hashlib
import io
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import ingest as ig
from lodestrata.sources import archives, extract, folders


def make_tar(path, members):
    with tarfile.open(path, "w", format=tarfile.PAX_FORMAT) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type, info.mode = tarfile.DIRTYPE, 0o755
                t.addfile(info)
            elif isinstance(data, tuple):
                info.type, info.linkname = data
                t.addfile(info)
            else:
                info.size, info.mode = len(data), 0o640
                t.addfile(info, io.BytesIO(data))


def rules(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "ord int, rule string")


def test_extract(spark, tmp_path):
    big = os.urandom(3_000_000)
    make_tar(tmp_path / "a.tar", [("./etc/", None), ("./etc/conf", b"one"), ("etc/deep/x", big), ("usr/bin/tool", b"t"), ("etc/ln", (tarfile.SYMTYPE, "conf")), ("etc/hl", (tarfile.LNKTYPE, "./etc/conf")), ("etc/conf", b"two"), ("var/left", b"out")])
    src = archives.list_paths(spark, [str(tmp_path / "a.tar")])
    out = tmp_path / "out"
    got = extract.extract(src, rules(spark, "etc/:cfg", "usr/bin/tool:", "etc/deep/:d2"), str(out)).collect()
    assert (out / "cfg/conf").read_bytes() == b"two" and (out / "tool").read_bytes() == b"t" and (out / "d2/x").read_bytes() == big
    assert os.readlink(out / "cfg/ln") == "conf" and not (out / "var").exists() and not (out / "left").exists()
    assert (out / "cfg/conf").stat().st_mode & 0o777 == 0o640 and sorted(r.target for r in got if r.type == "file") == ["cfg/conf", "d2/x", "tool"]
    with pytest.raises(Exception, match="no member matches"):
        extract.extract(src, rules(spark, "etc/:cfg", "nothing:x"), str(tmp_path / "o2"))
    with pytest.raises(Exception, match="leaves the archive"):
        extract.rules_of(rules(spark, "../x")).collect()
    with pytest.raises(Exception, match="standard output"):
        extract.rules_of(rules(spark, "a:-", "b:-")).collect()
    assert extract.extract_file(src, "usr/bin/tool", str(tmp_path / "one")) == 1 and (tmp_path / "one").read_bytes() == b"t"
    with pytest.raises(ValueError):
        extract.extract_file(src, "not there", str(tmp_path / "one"))


def test_targets_stay_inside(spark, tmp_path):
    make_tar(tmp_path / "b.tar", [("d/../../evil", b"x")])
    with pytest.raises(Exception, match="leaves the folder"):
        extract.extract(archives.list_paths(spark, [str(tmp_path / "b.tar")]), rules(spark, ":o/"), str(tmp_path / "o"))


def test_store(spark, tmp_path):
    root = str(tmp_path / "store")
    data = [os.urandom(100 + i) for i in range(20)]
    key = [hashlib.sha256(d).hexdigest() for d in data]
    rows = [("chunk", "g1", key[i], bytearray(d), len(d) + (i == 3)) for i, d in enumerate(data)] + [("chunk", "g1", "ab" * 32, bytearray(b"wrong"), 5)]
    df = spark.createDataFrame(rows, "partition string, generation string, key string, data binary, size long")
    states = {r.key: r.state for r in folders.put(df, root).collect()}
    assert states[key[3]] == "bad size" and states["ab" * 32] == "bad digest" and sum(s == "stored" for s in states.values()) == 19
    again = {r.key: r.state for r in folders.put(df, root).collect()}
    assert again[key[0]] == "exists" and again[key[3]] == "bad size"
    folders.put(df.where(F.col("key") == key[0]).withColumn("generation", F.lit("g2")), root).collect()
    have = {(r.generation, r.key): r["size"] for r in folders.listing(spark, root).collect()}
    assert have == {("g1", key[i]): len(d) for i, d in enumerate(data) if i != 3} | {("g2", key[0]): len(data[0])}
    assert not [f for _, _, fs in os.walk(root) for f in fs if f.endswith(".part")]
    got = {r.key: (r.generation, r.data) for r in folders.get(df.select("partition", "key"), root, ["g2", "g1"]).collect()}
    assert got[key[0]] == ("g2", data[0]) and got[key[1]] == ("g1", data[1]) and got[key[3]] == (None, None)


def test_upload_stops_before_the_root(spark, tmp_path):
    def obj(d, bad=False):
        return ("manifest", "g1", hashlib.sha256(d + (b"!" if bad else b"")).hexdigest(), bytearray(d), len(d))

    schema = "partition string, generation string, key string, data binary, size long"
    chunks = spark.createDataFrame([obj(b"c1"), obj(b"c2")], schema)
    top = obj(b"root")
    assert folders.upload(chunks, spark.createDataFrame([obj(b"m1"), top], schema), top[2], str(tmp_path / "s1")) == {"chunks": 2, "manifests": 1, "root": 1}
    with pytest.raises(ValueError, match="bad digest"):
        folders.upload(chunks, spark.createDataFrame([obj(b"m1", bad=True), top], schema), top[2], str(tmp_path / "s2"))
    assert not os.path.exists(folders.place(str(tmp_path / "s2"), "manifest", "g1", top[2]))


def test_generations(spark, tmp_path):
    path = str(tmp_path / "generations")
    assert folders.update_generations(spark, path, lambda g: [*g, "g1"]) == ["g1"]
    assert folders.update_generations(spark, path, lambda g: [*g, "g2"]) == ["g1", "g2"] == folders.read_generations(path)[0]
    for change in (lambda g: [], lambda g: [*g, "g1"], lambda g: [*g, "../x"]):
        with pytest.raises(ValueError):
            folders.update_generations(spark, path, change)
    seen = []

    def other_writer(g):
        if not seen:  # somebody else writes between the read and the write
            seen.append(1)
            with open(path, "a") as f:
                f.write("g3\n")
        return [*g, "g4"]

    assert folders.update_generations(spark, path, other_writer) == ["g1", "g2", "g3", "g4"]
    with pytest.raises(RuntimeError):
        folders.update_generations(spark, path, lambda g: open(path, "a").write("x") and g, tries=2)


def test_contracts(spark):
    images = spark.createDataFrame([(1, 0), (2, 100)], "image long, size long")
    with pytest.raises(Exception, match="outside its image"):
        ig.window_of(images, F.lit(100), F.lit(0)).collect()
    assert [(r["from"], r["to"]) for r in ig.window_of(images.where("size > 0"), F.lit(40), F.lit(0)).collect()] == [(40, 100)]
    rows = spark.createDataFrame([("a", 5), ("a", 6)], "g string, n long")
    with pytest.raises(Exception, match="too many bytes"):
        ig.enforce_limits(rows, "g", "n", 10, 10).collect()
    assert ig.enforce_limits(rows, "g", "n", 10, 11).count() == 1
    bad = spark.createDataFrame([(1, 0, 4, 2, bytearray(b"abc"))], "image long, start long, end long, kind int, data binary")
    with pytest.raises(Exception, match="without its bytes"):
        ig.segments(bad).collect()
