"""Readers, sinks, alignment and points against small made-up captures."""

import io
import math
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from planimeter.functions import expr
from planimeter.functions.shared import stored
from planimeter.operators import align, damage, points, scenes
from planimeter.plans import fixtures
from planimeter.sources import captures, sinks
from planimeter.sources import scenes as scene_files


def quaternion(axis, angle):
    axis = np.array(axis, float) / np.linalg.norm(axis)
    return [*(axis * math.sin(angle / 2)).tolist(), math.cos(angle / 2)]


def matrix(q):
    x, y, z, w = np.array(q) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def test_odometry_by_header_in_file_order(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        lines = ["frame, timestamp, x, y, z, qx, qy, qz, qw, fx, fy, cx, cy"] + [f"{i:06d}, {9 - i}.5, {i}, 0, 1, 0, 0, 0, 1, , 5, , 7" for i in range(5)]
        (tmp_path / name / "odometry.csv").write_text("\n".join(lines) + "\n")
        (tmp_path / name / "camera_matrix.csv").write_text("2, 0, 3\n0, 4, 5\n0, 0, 1\n")
    k = captures.read_intrinsics(spark, f"{tmp_path}/*/camera_matrix.csv")
    out = captures.read_odometry(spark, f"{tmp_path}/*/odometry.csv", k).orderBy("capture_id", "pose_index").collect()
    assert [(r.capture_id, r.pose_index, r.frame, r.ts, r.t[0], r.fx, r.fy, r.cx, r.cy) for r in out] == [(n, i, f"{i:06d}", 9.5 - i, float(i), 2.0, 5.0, 3.0, 7.0) for n in "ab" for i in range(5)]
    imu = spark.createDataFrame([("a", i, 0.0, 3.0, 4.0 if i < 4001 else 400.0) for i in range(4100)], "capture_id string, row_ord int, a_x double, a_y double, a_z double")
    assert captures.gravity(imu).first().g == 5.0
    assert [captures.frame_number(F.lit(x)) is not None for x in ("1", "x")] and spark.range(1).select(captures.frame_number(F.lit(" 012 ")), captures.frame_number(F.lit("x1"))).first()[:] == (12, None)


def test_trajectory_is_inverted_with_y_up(spark, tmp_path):
    rng = np.random.default_rng(1)
    (tmp_path / "c").mkdir()
    rows, want = [], {}
    for i in range(20):
        r, t = rng.standard_normal(3) if i else np.zeros(3), rng.standard_normal(3)
        rows.append(f"{i / 10:.4f} " + " ".join(map(repr, [*map(float, r), *map(float, t)])))
        angle = np.linalg.norm(r)
        turn = matrix(quaternion(r, angle)) if angle else np.eye(3)
        up = np.array([[1, 0, 0], [0, 0, 1], [0, -1, 0]])
        want[f"{i / 10:.3f}"] = (up @ turn.T, up @ (-turn.T @ t))
    (tmp_path / "c" / "walk.traj").write_text("9.9 1 2\n\n" + "0.1 0 0 0 9 9 9\n" + "\n".join(rows) + "\n")
    out = captures.read_trajectory(spark, f"{tmp_path}/c/walk.traj").collect()
    assert {r.key for r in out} == set(want)
    for r in out:
        assert np.allclose(matrix(r.q), want[r.key][0]) and np.allclose(r.t, want[r.key][1])


def test_kinds_by_root_files(spark):
    files = {
        "a": ["adjacency.json", "r/1.jpg"], "b": ["adjacency.json", "depth/1.png", "odometry.csv"], "c": ["rgb.mp4"], "d": ["odometry.csv"], "e": ["1.jpg", "2.PNG", "n/3.jpg"], "f": ["n/1.jpg", "n/2.jpg"], "g": ["n/x.mp4"], "h": ["depth/1.png", "1.jpg"],
    }
    rows = [(k, f"/data/{k}/{p}") for k, v in files.items() for p in v]
    out = {r.capture_id: r.kind for r in captures.classify(spark.createDataFrame(rows, "capture_id string, path string")).collect()}
    assert out == {"a": "photo_property", "b": "lidar_bundle", "c": "video", "d": "video", "e": "photo_folder", "f": "unknown", "g": "unknown", "h": "unknown"}


def png(values, filters):
    """A 16-bit grey PNG whose rows use the given filters."""
    height, width = values.shape
    raw, above = b"", bytes(2 * width)
    for y in range(height):
        line = values[y].astype(">u2").tobytes()
        out = bytearray()
        for x in range(len(line)):
            a, b, c = (line[x - 2] if x > 1 else 0), above[x], (above[x - 2] if x > 1 else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((line[x] - (0, a, b, (a + b) // 2, paeth)[filters[y]]) & 255)
        raw += bytes([filters[y]]) + bytes(out)
        above = line
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_depth_png_of_every_filter(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 65536, (10, 13))
    df = spark.createDataFrame([("c", "f", bytearray(png(values, [y % 5 for y in range(10)])))], "capture_id string, frame string, content binary")
    out = captures.read_depth_png(df).collect()
    assert {(r.v, r.u): r.value for r in out} == {(v, u): int(values[v, u]) for v in range(10) for u in range(13)}


def test_archives_and_pinholes(spark):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        for name, text in (("x/cam_1.0004.pincam", "4 3 1.5 2.5 2 1"), ("x/cam_2.5.pincam", "bad"), ("readme.txt", ""), ("x/cam_abc.pincam", "")):
            z.writestr(name, text)
    m = scene_files.zip_members(spark.createDataFrame([("c", bytearray(sink.getvalue()))], "capture_id string, content binary"))
    assert {(r.key, r.member) for r in m.collect()} == {("1.000", "x/cam_1.0004.pincam"), ("2.500", "x/cam_2.5.pincam")}
    assert [tuple(r)[1:] for r in scene_files.pinhole(m).collect()] == [("1.000", 4, 3, 1.5, 2.5, 2.0, 1.0)]


def test_json_objects(spark, tmp_path):
    for n, text in (("a", '{"x": 1}'), ("b", "[1]"), ("c", "{oops")):
        (tmp_path / f"{n}.json").write_text(text)
    out = {r.path[-6]: r.problem for r in scene_files.read_json_objects(spark, f"{tmp_path}/*.json").collect()}
    assert out == {"a": None, "b": "must be a JSON object", "c": "not JSON"}


def test_bundles_need_frames_with_everything(spark):
    poses = [("a", f"{i}.000", [float(i), 0.0, 0.0], [0.0, 0.0, 0.0, 1.0]) for i in range(12)] + [("b", "1.000", [0.0] * 3, [0.0, 0.0, 0.0, 1.0])]
    p = spark.createDataFrame(poses, "capture_id string, key string, t array<double>, q array<double>")
    pictures = p.where("key <> '3.000'").select("capture_id", "key", F.lit(b"x").alias("content"))
    k = p.select("capture_id", "key", F.lit(960).alias("width"), F.lit(720).alias("height"), *[F.lit(v).alias(n) for n, v in (("fx", 10.0), ("fy", 11.0), ("cx", 12.0), ("cy", 13.0))])
    frames, few = sinks.bundle_frames(p, pictures, pictures, k)
    assert frames.count() == 11 and [tuple(r) for r in few.collect()] == [("b", 1)]
    text = {r.name: r.content for r in sinks.odometry_text(frames).collect()}
    lines = text["odometry.csv"].split("\n")
    assert len(lines) == 12 and lines[1].startswith("0.000,0.000,0.000000") and lines[3].startswith("2.000,") and lines[-1].endswith("20.000000,22.000000,24.000000,26.000000")
    assert text["camera_matrix.csv"] == "20.000000, 0, 24.000000\n0, 22.000000, 26.000000\n0, 0, 1"


def test_documents_are_written_and_read(spark, tmp_path):
    rows = [("a", "plan.json", '{"x": "é"}'), ("a", "notes.txt", "one\ntwo"), ("b", "plan.json", "{}")]
    sinks.write_documents(spark.createDataFrame(rows, "folder string, name string, content string"), f"{tmp_path}/out")
    assert {tuple(r) for r in sinks.read_documents(spark, f"{tmp_path}/out").collect()} == set(rows)


def test_depth_points_and_colours(spark):
    q = quaternion([0, 1, 0], 0.3)
    pixels = [("c", f"{f}", v, u, 1000 + 10 * v + u, 2 if (v + u) % 7 else 1, 12, 10) for f in range(3) for v in range(10) for u in range(12)]
    pixels += [("c", "3", v, u, 2000, None, 12, 10) for v in range(5) for u in range(12)] + [("c", "9", 0, 0, 2000, 2, 12, 10)]
    df = spark.createDataFrame(pixels, "capture_id string, frame string, v int, u int, mm int, conf int, width int, height int")
    poses = spark.createDataFrame([("c", str(f), [float(f), 1.0, 2.0], q, 10.0, 11.0, 6.0, 5.0) for f in range(5)], "capture_id string, frame string, t array<double>, q array<double>, fx double, fy double, cx double, cy double")
    got = {(r.frame, r.v, r.u): (r.x, r.y, r.z) for r in points.depth_points(df, poses).collect()}
    want = {}
    for f in range(4):
        good = [(v, u, mm) for _, g, v, u, mm, conf, *_ in pixels if g == str(f) and (conf is None or conf >= 2)]
        for v, u, mm in sorted(good)[::3] if len(good) >= 40 else []:
            z = mm / 1000
            want[str(f), v, u] = matrix(q) @ np.array([(u - 6) * z / 10, (v - 5) * z / 11, z]) + [f, 1, 2]
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    picture = spark.createDataFrame([("c", str(f), v, u, v, u, f, 24, 20) for f in range(4) for v in range(20) for u in range(24)], "capture_id string, frame string, v int, u int, r int, g int, b int, width int, height int")
    out = damage.coloured_points(df, poses, picture).collect()
    assert out and {int(r.frame) for r in out} == {0, 1, 2, 3} and all(r.b == int(r.frame) and r.r < 20 and r.g < 24 for r in out)


def test_spaced_poses(spark):
    rng = random.Random(3)
    walk = [[0.05 * i + rng.random() / 50, 0.0, 0.0] for i in range(600)]
    rows = [("c", i, t, [0.0, 0.0, 0.0, 0.2 if i % 10 == 3 else 1.0]) for i, t in enumerate(walk)]
    got = points.spaced_poses(spark.createDataFrame(rows, "capture_id string, pose_index int, t array<double>, q array<double>")).first().kept
    kept = []
    for _, i, t, q in rows:
        if q[3] > 0.5 and (not kept or t[0] - walk[kept[-1]][0] >= 0.18):
            kept.append(i)
    assert len(kept) > 90 and got == [kept[int(x)] for x in np.linspace(0, len(kept) - 1, 90)]


def test_colours_of_known_values(spark):
    cases = {(255, 255, 255): (255, 128, 128), (0, 0, 0): (0, 128, 128), (255, 0, 0): (136, 208, 195), (0, 255, 0): (224, 42, 211), (0, 0, 255): (82, 207, 20)}
    for rgb, lab in cases.items():
        r = spark.range(1).select(expr.rgb_to_lab(*map(F.lit, rgb)).alias("x")).first().x
        assert all(abs(a - b) <= 1 for a, b in zip((r.l, r.a, r.b), lab))


def test_rotation_between():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.standard_normal((2, 3))
        r = align.rotation_between(a, b)
        assert np.allclose(r @ r.T, np.eye(3)) and np.isclose(np.linalg.det(r), 1) and np.allclose(r @ (a / np.linalg.norm(a)), b / np.linalg.norm(b))
    for a in np.eye(3):
        r = align.rotation_between(a, -a)
        assert np.allclose(r @ a, -a) and np.isclose(np.linalg.det(r), 1)
    assert (align.rotation_between([0, 1, 0], [0, 1.0, 1e-4]) == np.eye(3)).all()


@pytest.fixture(scope="module")
def room(spark):
    specs = spark.createDataFrame([("a", 0.0, 0.0, 3.0, 2.4, 2.2)], "capture_id string, x0 double, z0 double, x1 double, z1 double, height_m double")
    return stored(fixtures.room_cloud(specs).withColumn("frame_index", F.floor(F.col("x") * 20).cast("int")))


def test_floor_frames_level_a_tilted_room(spark, room):
    tilt = math.radians(2.5)
    turned = room.select("capture_id", "ord", (F.col("x") * math.cos(tilt) - F.col("y") * math.sin(tilt)).alias("x"), (F.col("x") * math.sin(tilt) + F.col("y") * math.cos(tilt) - 1.4 + F.when(F.col("frame_index") > 45, 0.01).otherwise(0.0)).alias("y"), "z", "frame_index")
    frames = stored(align.floor_frames(turned))
    f = frames.first()
    assert f.method == "floor plane" and abs(f.tilt_deg - 2.5) < 1.0 and f.residual < 0.03
    flat = align.replayed(turned, frames)
    assert flat.columns == turned.columns
    low = flat.where("y < 0.2").agg(F.max("y"), F.min("y")).first()
    assert low[0] - low[1] < 0.12 and abs(low[0] + low[1]) < 0.1
    off = align.anchor_off(turned).agg(F.percentile("y", 0.02)).first()[0]
    assert abs(off) < 0.15 and align.floor_frames(turned, anchor=False).first().method == "floor anchor disabled"
    few = align.floor_frames(turned.limit(30)).first()
    assert few.method == "floor mode" and few.tilt_deg is None


def test_loops_close_where_the_walk_returns(spark):
    rng = np.random.default_rng(5)
    wall = np.stack([np.r_[np.linspace(0, 4, 300), np.full(300, 4.0), np.linspace(0, 4, 300)], np.r_[np.zeros(300), np.linspace(0, 3, 300), np.full(300, 3.0)]], axis=1) + rng.normal(0, 0.003, (900, 2))
    yaw, shift = math.radians(2), np.array([0.08, -0.05])
    back = (wall - shift) @ np.array([[math.cos(yaw), -math.sin(yaw)], [math.sin(yaw), math.cos(yaw)]])
    rows = [("a", i, float(x), 1.2, float(z), 0) for i, (x, z) in enumerate(wall)] + [("a", 1000 + i, float(x), 1.2, float(z), 50) for i, (x, z) in enumerate(wall[:20])]
    rows += [("a", 2000 + i, float(x), 1.2, float(z), 100) for i, (x, z) in enumerate(back)] + [("b", i, float(i % 7), 1.2, 0.0, i) for i in range(40)]
    cloud = spark.createDataFrame(rows, "capture_id string, ord long, x double, y double, z double, frame_index int")
    fits = stored(align.loop_fits(cloud))
    by = {r.capture_id: r for r in fits.collect()}
    assert by["a"].fired and abs(by["a"].yaw - yaw) < 0.01 and by["a"].rmse_after < 0.5 * by["a"].rmse_before and by["b"].reason == "too few points"
    out = align.closed_loops(cloud, fits)
    at = {r.ord: (r.x, r.z) for r in out.where("capture_id = 'a'").collect()}
    f = by["a"]
    turn, centre = np.array([[math.cos(f.yaw), math.sin(f.yaw)], [-math.sin(f.yaw), math.cos(f.yaw)]]), np.array([f.cx, f.cz])
    assert np.allclose([at[i] for i in range(900)], wall)
    assert np.allclose([at[2000 + i] for i in range(900)], (back - centre) @ turn + centre + [f.tx, f.tz])
    assert np.allclose([at[1000 + i] for i in range(20)], (wall[:20] + (wall[:20] - centre) @ turn + centre + [f.tx, f.tz]) / 2)
    assert out.where("capture_id = 'b'").count() == 40


def test_alignment_of_points():
    rng = np.random.default_rng(6)
    b = rng.random((200, 2)) * 4
    yaw, shift = 0.05, np.array([0.04, 0.03])
    a = (b - shift) @ np.array([[math.cos(yaw), -math.sin(yaw)], [math.sin(yaw), math.cos(yaw)]])
    got, moved, before, after = align.align_2d(a, b)
    assert abs(got - yaw) < 1e-6 and np.allclose(moved, shift) and after < 1e-9 < before


def test_triangulation_and_its_gates(spark):
    rng = np.random.default_rng(7)
    k = (500.0, 500.0, 320.0, 240.0)
    rows, want = [], {}
    for i in range(60):
        q0, q1 = quaternion(rng.standard_normal(3), 0.1), quaternion(rng.standard_normal(3), 0.1)
        t0, t1 = np.zeros(3), np.array([0.3 if i % 5 else 0.001, 0.05, 0.0])
        p = np.array([rng.uniform(-0.5, 0.5), rng.uniform(-0.5, 0.5), rng.uniform(1, 8)])
        cam = [matrix(q).T @ (p - t) for q, t in ((q0, t0), (q1, t1))]
        uv = [(k[0] * c[0] / c[2] + k[2], k[1] * c[1] / c[2] + k[3]) for c in cam]
        if i % 7 == 0:
            uv[1] = (uv[1][0], uv[1][1] + 60)
        rays = [p - t0, p - t1]
        wide = math.degrees(math.acos(min(1.0, rays[0] @ rays[1] / np.linalg.norm(rays[0]) / np.linalg.norm(rays[1])))) > 0.8
        if i % 7 and all(0.35 < c[2] < 6 for c in cam) and wide:
            want[i] = p
        rows.append((i, *map(float, (*uv[0], *uv[1])), k, k, t0.tolist(), t1.tolist(), q0, q1))
    camera = "struct<fx:double,fy:double,cx:double,cy:double>"
    df = spark.createDataFrame(rows, f"id int, u0 double, v0 double, u1 double, v1 double, k0 {camera}, k1 {camera}, t0 array<double>, t1 array<double>, q0 array<double>, q1 array<double>")
    got = {r.id: (r.x, r.y, r.z) for r in align.triangulated(df).collect()}
    assert set(got) == set(want) and all(np.allclose(got[i], want[i], atol=1e-6) for i in want)
    frames = spark.createDataFrame([("c", i, [0.1 * i * i, 0.0, 0.0]) for i in range(6)], "capture_id string, ord int, t array<double>")
    assert {(r["first"], r["second"]) for r in align.frame_pairs(frames).collect()} == {(a, b) for a in range(6) for b in (a + 1, a + 2) if b < 6 and 0.08 <= 0.1 * (b * b - a * a) <= 1.3 + 1e-9}
    matches = spark.createDataFrame([("c", 0, 1, i % 80, i) for i in range(1600)] + [("c", 1, 2, 5, i) for i in range(24)], "capture_id string, first int, second int, distance int, ord int")
    good = align.good_matches(matches).collect()
    assert len(good) == 700 and max(r.distance for r in good) <= 56


def test_camera_height_scales_photos(spark):
    rng = np.random.default_rng(8)
    floor = np.stack([rng.random(400) * 3, rng.normal(0, 0.002, 400), rng.random(400) * 3], axis=1)
    cloud = np.concatenate([floor, rng.random((200, 3)) * [3, 2, 3] + [0, 0.3, 0]])
    rows = [("a", i, *map(float, p)) for i, p in enumerate(cloud)]
    cams = [("a", [float(i), 0.7, 1.0], quaternion([1, 0, 0], math.pi)) for i in range(3)] + [("b", [0.0] * 3, [0.0, 0.0, 0.0, 1.0])]
    c = spark.createDataFrame(rows, "capture_id string, ord long, x double, y double, z double")
    s = stored(align.camera_height_scale(c, spark.createDataFrame(cams, "capture_id string, t array<double>, q array<double>")))
    by = {r.capture_id: r for r in s.collect()}
    assert abs(by["a"].scale - 2) < 0.05 and not by["a"].degraded and by["b"].scale_source == "failed_no_floor_plane" and by["b"].scale == 1.0
    assert abs(align.scaled(c, s).agg(F.max("y")).first()[0] - 2 * cloud[:, 1].max()) < 0.2


def test_depth_agreement(spark):
    low = [("c", t / 10, v, u, 1000 + v, 2, 16, 12) for t in range(60) for v in range(12) for u in range(16)]
    high = [("c", t / 10 + (0.03 if t % 2 else 0.2), v, u, 1010 + v // 2, 32, 24) for t in range(60) for v in range(24) for u in range(32)]
    a = spark.createDataFrame(low, "capture_id string, ts double, v int, u int, mm int, conf int, width int, height int")
    b = spark.createDataFrame(high, "capture_id string, ts double, v int, u int, mm int, width int, height int")
    r = align.depth_agreement(a, b, frames=20, pixels=50).first()
    assert r.pixels == 50 * r.frames and 0 < r.frames <= 20 and r.median_abs_m == 0.01 and r.p90_abs_m == 0.01


def ply(xyz, faces):
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(xyz)}\nproperty double x\nelement face {len(faces)}\nend_header\n"
    return head.encode() + b"".join(struct.pack("<dddBBB", *p, 1, 2, 3) for p in xyz) + b"".join(struct.pack(f"<B{len(f)}I", len(f), *f) for f in faces)


def test_scenes_become_ground_truth(spark):
    box = lambda x0, y0, x1, y1, z: [(x0, y0, z), (x1, y0, z), (x1, y1, z), (x0, y1, z)]
    wall = [(4.0, 0.0, 0.0), (4.0, 3.0, 0.0), (4.0, 3.0, 2.5), (4.0, 0.0, 2.5)]
    fan = [(0, 1, 2), (0, 2, 3)]
    shapes = [(box(0, 0, 4, 3, 0.0), [0, 0, 1]), (box(4, 0, 7, 3, 0.0), [0, 0, 1]), (box(0, 0, 1, 1, 0.1), [0, 0, 1]), (wall, [1, 0, 0]), (box(0, 0, 4, 3, 2.6), [0, 0, -2.0])]
    files = [(f"/data/s/{'entities/' if i % 2 else ''}{i}.ply", bytearray(ply(p, fan))) for i, (p, _) in enumerate(shapes)] + [("/data/s/notes.ply", bytearray(b""))]
    entities = scene_files.read_polygons(scene_files.numbered_entities(spark.createDataFrame(files, "path string, content binary")))
    sink = io.BytesIO()
    np.save(sink, np.array([[[(p[0][0] + p[2][0]) / 2, (p[0][1] + p[2][1]) / 2, p[0][2]], n] for p, n in shapes], float))
    planes = scene_files.read_planes(spark.createDataFrame([("s", bytearray(sink.getvalue()))], "scene string, content binary"))
    rows = stored(entities.join(planes, ["scene", "index"]))
    assert rows.where("index = 0").first().loop[0].asDict() == {"x": 0.0, "z": 0.0}
    quad = lambda y0, y1: [[4.0, y0, 0.0], [4.0, y1, 0.0], [4.0, y1, 2.0], [4.0, y0, 2.0]]
    import json

    doors = json.dumps({"doors": [{"vertices": quad(1.0, 1.9), "normal": [1, 0, 0]}, {"vertices": quad(2.0, 2.2), "normal": [1, 0, 0]}, {"vertices": quad(1.0, 1.9), "normal": [0, 0, 1]}]})
    cut = stored(scene_files.quads(spark.createDataFrame([("s", doors)], "scene string, doc string"), "door"))
    doc = json.loads(scenes.scene_documents(rows, cut).first().document)
    assert [(r["room_id"], r["floor_area_m2"], r["ceiling_height_m"]) for r in doc["rooms"]] == [("s_floor_00", 12.0, 2.6), ("s_floor_01", 9.0, None)]
    assert doc["rooms"][0]["walls"][0]["length_m"] == 3.0 and doc["footprint_m2"] == 21.0 and [x["area_m2"] for x in doc["excluded_horizontal_polygons"]] == [1.0]
    assert [(o["opening_id"], o["width_m"]) for o in doc["rooms"][0]["openings"]] == [("door_0", 0.9), ("door_2", 0.9)] and [o["opening_id"] for o in doc["openings_not_scored"]] == ["door_1"]
    assert [(x["room_a"], x["room_b"], x["opening_id"]) for x in doc["adjacencies"]] == [("s_floor_00", "s_floor_01", "door_0")]
