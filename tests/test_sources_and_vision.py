import gzip
import hashlib
import io
import json
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import controls, vision
from kinfold.plans import source_queries
from kinfold.sources import annotations, files, tsv
from kinfold.streaming import sequences


def test_tsv_keeps_empty_strings_and_odd_fields(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('x\ty\n\tNA\n"two\nlines"\tnan\n')
    (tmp_path / "b.tsv.gz").write_bytes(gzip.compress(b"x\ty\n1\t\n"))
    assert sorted(map(tuple, tsv.read_tsv(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv.gz")], ["x", "y"]).collect())) == [("", "NA"), ("1", ""), ("two\nlines", "nan")]
    frame = spark.createDataFrame([(1, None, True, ["b", "a"]), (None, "q", None, [])], "i int, s string, b boolean, l array<string>")
    tsv.write_tsv(frame, str(tmp_path / "out"), compression="gzip")
    assert sorted(map(tuple, tsv.read_tsv(spark, str(tmp_path / "out")).collect())) == [("", "q", "", ""), ("1", "", "YES", "b|a")]
    assert "| q |" in tsv.summary_markdown("T", frame)


def test_shards_and_index(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"run_task_{i}.tsv").write_text(f"a\n{i}\n")
    (tmp_path / "run_task_0_status.tsv").write_text("a\nbad\n")
    assert sorted(r[0] for r in tsv.read_shards(spark, str(tmp_path), "run").collect()) == ["0", "1", "2"]
    with pytest.raises(ValueError, match="no tables"):
        tsv.read_shards(spark, str(tmp_path), "other")
    index = spark.createDataFrame([(str(tmp_path / "run_task_1.tsv"),)], "p string")
    assert tsv.read_indexed(spark, index, "p", 1).count() == 1
    with pytest.raises(ValueError, match="listed tables"):
        tsv.read_indexed(spark, index, "p", 2)


def test_provenance_and_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.bin").write_bytes(b"abc")
    rows = {r["kind"]: r["value"] for r in tsv.provenance(spark, [str(tmp_path / "in")], {"k": 3}).collect()}
    assert rows == {"input": hashlib.sha256(b"abc").hexdigest(), "parameter": "3"}
    there = files.hash_files(spark, str(tmp_path / "in"))
    path = there.first()["path"]
    manifest = spark.createDataFrame([(path, 3, "0"), ("gone", 1, "1")], "path string, bytes long, sha256 string")
    assert {tuple(r) for r in files.verify_manifest(manifest, there).collect()} == {(path, "hash"), ("gone", "missing")}
    assert [r["relative_path"] for r in files.list_files(spark, str(tmp_path / "in")).collect()] == ["x.bin"]


def test_a_table_in_several_files_is_one_entry(spark, tmp_path):
    (tmp_path / "labels.parquet").mkdir()
    for name, content in (("part-0.parquet", b"a"), ("part-1.parquet", b"bc")):
        (tmp_path / "labels.parquet" / name).write_bytes(content)
    (tmp_path / "pages.parquet").write_bytes(b"d")
    found = {tuple(r) for r in source_queries.file_inventory(spark, str(tmp_path)).collect()}
    assert found == {("labels.parquet", ".parquet", True, True, 64), ("pages.parquet", ".parquet", True, True, 64)}


def archives(folder):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a/one.JPG", b"1")
        f.writestr("../evil.txt", b"2")
        f.writestr("a/b/two.json", b"{}")
    (folder / "x.zip").write_bytes(z.getvalue())
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("d/three.png")
        info.size = 3
        f.addfile(info, io.BytesIO(b"333"))
        link = tarfile.TarInfo("d/link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        f.addfile(link)
    (folder / "y.tgz").write_bytes(t.getvalue())
    (folder / "z.txt").write_bytes(b"plain")


def test_archives(spark, tmp_path):
    archives(tmp_path)
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    kinds = {r["path"].rpartition("/")[2]: r["k"] for r in raw.select("path", files.archive_kind(F.col("content")).alias("k")).collect()}
    assert kinds == {"x.zip": "zip", "y.tgz": "gzip", "z.txt": None}
    members = files.archive_members(raw)
    assert members.count() == 5
    assert {(r["member"], bytes(r["content"])) for r in files.extract_members(raw).collect()} == {("a/one.JPG", b"1"), ("a/b/two.json", b"{}"), ("d/three.png", b"333")}
    assert {(r["kind"], r["extension"]) for r in files.archive_summary(members).collect()} >= {("image", "jpg"), ("annotation", "json"), ("image", "png")}


def test_annotations(spark, tmp_path):
    for name in ("coco", "yolo", "lists", "records"):
        (tmp_path / name).mkdir()
    doc = {"images": [{"id": 1, "file_name": "p/A.jpg", "width": 3, "height": 4}, {"id": 2, "file_name": "b.jpg"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 7}, {"id": 2, "image_id": 1, "category_id": 8}], "categories": [{"id": 7, "name": "x"}, {"id": 8, "name": "y"}]}
    (tmp_path / "coco" / "c.json").write_text(json.dumps(doc))
    summary, images = annotations.read_coco(spark, str(tmp_path / "coco"))
    assert summary.first()["n_annotations"] == 2 and summary.first()["category_names"] == "x|y"
    assert {r["basename"]: (r["annotation_count"], r["category_ids"]) for r in images.collect()} == {"a.jpg": (2, [7, 8]), "b.jpg": (0, None)}
    (tmp_path / "yolo" / "l.txt").write_text("0 .1 .2 .3 .4\n\n2 .1 .2 .3 .4\nnoise\n")
    row = annotations.read_yolo(spark, str(tmp_path / "yolo")).first()
    assert (row["n_objects"], row["class_ids"], row["n_other_lines"]) == (2, [0, 2], 1)
    (tmp_path / "lists" / "train.txt").write_text("# skip.jpg\nimages/One.JPG 3\ntwo.png\n")
    (tmp_path / "lists" / "test.txt").write_text("two.png\n")
    assert {r["file_name"]: r["splits"] for r in annotations.read_split_lists(spark, str(tmp_path / "lists")).collect()} == {"one.jpg": "train", "two.png": "test|train"}
    (tmp_path / "records" / "r.json").write_text(json.dumps({"id": "9", "files": [{"name": "f.zip", "size": 5, "computed_md5": "A" * 32, "download_url": "u"}, {"key": "g.zip", "size": 6, "checksum": "md5:" + "b" * 32, "links": {"self": "v"}}]}))
    assert {(r["file_name"], r["bytes"], r["checksum"], r["url"]) for r in annotations.read_records(spark, str(tmp_path / "records")).collect()} == {("f.zip", 5, "md5:" + "a" * 32, "u"), ("g.zip", 6, "md5:" + "b" * 32, "v")}


def picture(seed=7, h=60, w=84):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    out = np.stack([(x * 255 / w), (y * 255 / h), ((x + y) % 64) * 4], 2)
    for _ in range(12):
        cy, cx, s = r.integers(0, h), r.integers(0, w), r.integers(4, 12)
        out[(y - cy) ** 2 + (x - cx) ** 2 < s * s] = r.integers(0, 256, 3)
    return out.astype(np.uint8)


def png(pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_are_decoded_and_hashed(spark, tmp_path):
    p = picture()
    (tmp_path / "a.png").write_bytes(png(p))
    (tmp_path / "broken.png").write_bytes(b"nothing")
    got = {r["origin"].rpartition("/")[2]: r for r in files.read_images(spark, str(tmp_path)).collect()}
    assert got["a.png"]["pixel_sha256"] == hashlib.sha256(f"{p.shape[1]}x{p.shape[0]}|RGB|".encode() + p.tobytes()).hexdigest()
    assert not got["broken.png"]["read_ok"]


def test_exif():
    body = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHI4s", 0x0112, 3, 1, b"\x06\0\0\0") + struct.pack("<HHI4s", 0x010F, 2, 4, b"Cam\0") + b"\0\0\0\0"
    data = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 8) + b"Exif\0\0" + body + b"\xff\xda"
    assert files.exif(data) == {"orientation": "6", "make": "Cam"} and files.exif(b"\xff\xd8\xff\xe1\0") == {}


@pytest.mark.parametrize("kind", ["mirror_horizontal", "rotate90", "rotate180", "brightness_065"])
def test_copies_are_alike_and_others_are_not(kind):
    p = picture()
    same, other = vision.direct(p, vision.transformed(p, kind)), vision.direct(p, np.random.default_rng(7).integers(0, 256, p.shape).astype(np.uint8))
    assert same["ncc"] > 0.95 and same["ssim"] > 0.75 and other["score"] < 0.5
    a, b = vision.hashes(p), vision.hashes(vision.transformed(p, kind))
    least = min(bin(int(x, 16) ^ int(y, 16)).count("1") for x in a["phash_variants"] for y in b["phash_variants"])
    assert least <= 6 and 0 < a["gray_entropy"] <= 8


def test_features_and_canvases():
    p = picture()
    f = vision.colour_features(p)
    assert f.shape == (124,) and np.isfinite(f).all() and np.isclose(f[:16].sum(), 1)
    assert (vision.canvas(p, "border")[30, 42] == 127).all() and (vision.canvas(p, "center")[0] == 127).all()
    assert vision.canvas(p, "blur").shape == vision.canvas(p, "gray").shape == p.shape
    assert vision.direct(p, p[:, :20])["score"] == -999.0  # another aspect


def test_transforms_cut_and_light_as_stated():
    p = picture()
    h, w = p.shape[:2]
    assert vision.transformed(p, "corner_crop_20").shape[:2] == (int(h * 0.8), int(w * 0.8))
    assert vision.transformed(p, "center_crop_15").shape[:2] == (h - 2 * max(1, round(h * 0.075)), w - 2 * max(1, round(w * 0.075)))
    assert vision.transformed(p, "combined_crop_brightness").shape[:2] == (h - 2 * max(1, round(h * 0.1)), w - 2 * max(1, round(w * 0.1)))
    assert (vision.transformed(p, "brightness_135") == np.clip(p * 1.35, 0, 255).astype(np.uint8)).all()
    with pytest.raises(ValueError):
        vision.transformed(p, "none")
    flat = np.full((20, 20), 7.0)
    assert vision.correlation(flat, flat + 3) == 1.0 and np.isnan(vision.correlation(flat, flat, np.zeros((20, 20), bool)))
    assert (vision.matched_light(p[..., 0].astype(float), flat) == flat).all()


def test_controls(spark):
    items = spark.createDataFrame([(i, f"h{i // 2}" if i < 40 else f"u{i}", f"s{i % 3}", "ab"[i % 2], (i * 0x9E3779B97F4A7C15) % 2**63, f"o{i // 2}") for i in range(100)], "i long, c string, s string, y string, v long, o string")
    exact = controls.exact_positives(items, "i", "c", "s", 15).collect()
    assert len(exact) == 15 and all(r["item_a"] // 2 == r["item_b"] // 2 and r["item_a"] != r["item_b"] for r in exact)
    drawn = controls.synthetic_positives(items, "i", ["s", "y"], ["crop", "mirror"], 12).groupBy("transform", "s").count().collect()
    assert all(r["count"] == 4 for r in drawn)
    known = spark.createDataFrame([(1, 3)], "item_a long, item_b long")
    got = controls.random_negatives(items, "i", "y", "v", "o", known, 30).collect()
    used = [x for r in got for x in (r["item_a"], r["item_b"])]
    assert len(got) == 30 and max(map(used.count, used)) <= 3
    assert all(bin(((r["item_a"] * 0x9E3779B97F4A7C15) % 2**63) ^ ((r["item_b"] * 0x9E3779B97F4A7C15) % 2**63)).count("1") >= 12 for r in got)
    assert controls.disjoint(known, spark.createDataFrame([(3, 1)], "item_a long, item_b long")) == 1
    names = spark.createDataFrame([(1, "A b"), (2, "a-B"), (3, "c")], "k int, n string")
    assert [r["slug"] for r in controls.task_manifest(names, "n", "k").orderBy("task_id").collect()] == ["a-b", "a-b-2", "c"]
    vectors = spark.createDataFrame([(1, [0.6, 0.8]), (2, [float("nan"), 0.0]), (2, [2.0, 0.0])], "i int, v array<float>")
    assert controls.check_vectors(vectors, "i", "v").first().asDict() == {"n_rows": 3, "n_items": 2, "least_size": 2, "largest_size": 2, "n_not_finite": 1, "n_not_normed": 2}
    seen = spark.createDataFrame([("g", "negative", "VERIFIED_DERIVATIVE_STRONG", 1, 2), ("g", "negative", "REJECTED_NOT_DERIVATIVE", 1, 3)], "group string, expected string, relation string, item_a int, item_b int")
    assert controls.performance(seen).first()["passes"] is False and controls.hidden_relations(seen).count() == 1


def test_streams(spark, tmp_path):
    rows = [(1, 10, "2024-01-01 00:00:00"), (1, 11, "2024-01-01 00:00:05"), (1, 12, "2024-01-01 00:10:00"), (2, 13, "2024-01-01 00:00:00"), (1, 14, "2024-01-01 00:10:09")]
    batch = spark.createDataFrame(rows, "u long, e long, t string").withColumn("t", F.to_timestamp("t"))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(make, mode):
        stream = make(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{mode}{make.__name__}")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(tuple(r) for r in spark.sql("select * from out").collect())

    def near(s):
        return sequences.adjacent(s, "u", "e", "t", 15)

    def in_sessions(s):
        return sequences.sessions(s, "u", "t", late="0 seconds").select("u", "n_events")

    def once(s):
        return sequences.first_seen(s, ["u"], "t").select("u")

    assert run(near, "append") == [(1, 10, 11, 5.0), (1, 12, 14, 9.0)]
    assert run(in_sessions, "append")[:2] == [(1, 2), (2, 1)]
    assert run(once, "append") == [(1,), (2,)]
