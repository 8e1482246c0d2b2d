"""Sources and sinks on generated files."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import admin, audio, files
from scriptorium.streaming import live


def test_lenient_and_strict_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(path), "a long").collect()) == [1, 2]
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a long").count() == 0
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"a": 1}\n\n[2]\n{"a": \n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(bad), "a long").collect()
    rows, wrong = files.check_jsonl(spark, str(bad), "a long")
    assert [r.a for r in rows.collect()] == [1]
    assert sorted((r.line, r.value) for r in wrong.collect()) == [(3, "[2]"), (4, '{"a": ')] and wrong.first().file.endswith("b.jsonl")


def test_documents_and_arrays(spark, tmp_path):
    path = str(tmp_path / "doc.json")
    files.write_json(spark, {"items": [{"id": "1", "n": 2}]}, path)
    files.write_json(spark, {"items": [{"id": "é", "n": 3}]}, path)
    assert files.read_json(spark, path) == {"items": [{"id": "é", "n": 3}]} and files.read_json(spark, path + "x") is None
    assert [tuple(r) for r in files.read_rubric(spark, path, "id: string, n: int").collect()] == [("é", 3)]
    for n in (0, 1, 2, 30):
        files.write_array(spark.range(n).select("id", F.concat(F.lit("t\n"), F.col("id").cast("string")).alias("t")).coalesce(1), str(tmp_path / "array.json"))
        assert json.loads((tmp_path / "array.json").read_text()) == [{"id": i, "t": f"t\n{i}"} for i in range(n)]
    assert not any(".parts" in x or x.endswith(".tmp") for x in files.children(spark, str(tmp_path)))


def test_scenes_preference_and_many(spark, tmp_path):
    for scene, names in (("a", ("clean.jsonl", "asr_sim.jsonl")), ("b", ("clean.jsonl",)), ("c", ())):
        (tmp_path / "raw" / scene).mkdir(parents=True)
        for n in names:
            (tmp_path / "raw" / scene / n).write_text(json.dumps({"x": f"{scene}-{n}"}) + "\n")
    raw = str(tmp_path / "raw")
    assert files.scenes_with(spark, raw, "clean.jsonl") == ["a", "b"] and files.scenes_with(spark, raw, "asr_sim.jsonl") == ["a"]
    assert files.preferred(spark, f"{raw}/a").endswith("asr_sim.jsonl") and files.preferred(spark, f"{raw}/a", "clean").endswith("clean.jsonl")
    assert files.preferred(spark, f"{raw}/b").endswith("clean.jsonl") and files.preferred(spark, f"{raw}/b", "asr") is None
    (tmp_path / "by").mkdir()
    for scene in "ab":
        (tmp_path / "by" / f"{scene}.jsonl").write_text('{"x": "1"}\n')
    assert sorted((r.x, r.scene) for r in files.read_scenes(spark, str(tmp_path / "by"), "x string").collect()) == [("1", "a"), ("1", "b")]
    assert files.read_scenes(spark, str(tmp_path / "no"), "x string").count() == 0
    with pytest.warns(UserWarning, match="missing"):
        assert files.read_many(spark, [f"{raw}/a/clean.jsonl", f"{raw}/zz"], "x string").count() == 1
    with pytest.raises(FileNotFoundError):
        files.read_many(spark, [f"{raw}/zz"], "x string")


def test_split_cache_and_order(spark, tmp_path):
    rows = spark.range(10).withColumn("t", (F.col("id") % 3).cast("string"))
    files.write_split(rows, F.col("id") < 7, str(tmp_path / "k"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "k")).count() == 7 and spark.read.json(str(tmp_path / "r")).count() == 3
    files.write_split(rows, F.lit(True), str(tmp_path / "k2"), str(tmp_path / "r2"))
    assert not files.exists(spark, str(tmp_path / "r2"))
    cache = spark.createDataFrame([], "key string, value string")
    found, new = files.cached(rows, cache, ["t"], lambda x: x.withColumn("value", F.concat(F.lit("v"), "t")), str(tmp_path / "new"))
    assert {r.value for r in found.collect()} == {"v0", "v1", "v2"} and new.count() == 3
    again, none = files.cached(rows, new.select("key", "value"), ["t"], lambda x: x.withColumn("value", F.lit("never")), str(tmp_path / "none"))
    assert none.count() == 0 and "never" not in {r.value for r in again.collect()}
    assert files.with_order(rows).select("ord").distinct().count() == 10


def test_wave_windows(spark, tmp_path):
    samples = [0.5] * 1000
    stereo = b"".join(struct.pack("<hh", round(32767 * x), 0) for x in samples)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(stereo), b"WAVE", b"fmt ", 16, 1, 2, 16000, 64000, 4, 16, b"data", len(stereo))
    (tmp_path / "a.wav").write_bytes(head + stereo)
    rows = audio.read_wav(spark, str(tmp_path / "a.wav")).orderBy("seq").collect()
    assert len(rows) == 2 + 31 and all(len(r.window) == 512 for r in rows)
    assert abs(rows[0].window[0] - 0.25) < 1e-3 and rows[1].window[487] > 0.2 and rows[1].window[488] == 0 == rows[-1].window[0]


def test_env_append_reset(spark, tmp_path):
    (tmp_path / ".env").write_text("# c\nA=1\nexport B = 'x y'\nC=\nA=2\n=no\n")
    env = {"C": "own"}
    assert admin.load_env(spark, str(tmp_path / ".env"), env) == {"A": "1", "B": "x y"} and env["C"] == "own"
    assert admin.load_env(spark, str(tmp_path / "none"), env) == {}
    for _ in range(2):
        admin.append_batch(spark.range(3), str(tmp_path / "out"), 7)
    admin.append_batch(spark.range(2), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "batch=*")).count() == 5
    for name in ("run/s/clean.jsonl", "run/s/asr.jsonl", "run/seeds/a.json", "run/final/x.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    gone = admin.reset(spark, str(tmp_path / "run"), dry_run=True)
    assert [g.split("/run/")[1] for g in gone] == ["final", "s/asr.jsonl"] and (tmp_path / "run/final/x.json").exists()
    admin.reset(spark, str(tmp_path / "run"))
    assert not (tmp_path / "run/final").exists() and (tmp_path / "run/s/clean.jsonl").exists() and (tmp_path / "run/seeds/a.json").exists()


def test_streams_resume(spark, tmp_path):
    at = str(tmp_path)
    source = lambda: live.read_new(spark, f"{at}/in", "id long", files=1)
    files.write_jsonl(spark.range(6).repartition(3), f"{at}/in", append=True)
    assert live.run_available(source(), f"{at}/out", f"{at}/c") == 6
    assert live.run_available(source(), f"{at}/out", f"{at}/c") == 0
    files.write_jsonl(spark.range(6, 8), f"{at}/in", append=True)
    live.run_available(source(), f"{at}/out", f"{at}/c")
    assert sorted(r.id for r in spark.read.schema("id long").json(f"{at}/out").collect()) == list(range(8))
