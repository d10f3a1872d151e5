"""A kept manifest: merges change the buckets of their files alone, a repeat changes nothing, and a lost merge leaves what was."""

import datetime
import random

from marquee.operators import intake
from marquee.operators.manifest_store import ManifestStore, merge_files, read_manifest

T = datetime.datetime(2026, 2, 1)
COLUMNS = "name string, length long, modified timestamp, note string"


def shape(df):
    return sorted(map(tuple, df.select("file_name", "name", "length", "modified", "note", "updated").collect()))


def test_merges_are_those_of_all_files(spark, tmp_path):
    rng = random.Random(4)
    store = ManifestStore(str(tmp_path / "m"), COLUMNS, 4)
    assert shape(read_manifest(spark, store)) == []
    rows, seen = [], {}
    for n in range(4):
        batch = [(f"f{rng.randint(0, 30)}.{rng.choice(['png', 'exe'])}", rng.choice([0, 5, 30 << 20, None]) if rng.random() < 0.3 else 7, T + datetime.timedelta(hours=rng.randint(0, 20)), f"{n}-{i}") for i in range(20)]
        batch += [(None, 5, T, "no name"), ("late.png", 5, None, "no time")]
        files = spark.createDataFrame(batch, COLUMNS)
        before, old = {r.name: [(f.name, f.stat().st_mtime_ns) for f in r.rglob("part-*")] for r in tmp_path.glob("m/*/bucket=*")}, dict(seen)
        changed = merge_files(files, store)
        rows += [r for r in batch if r[0] and r[1] and r[2] and r[1] < 20 << 20 and r[0].endswith("png")]
        for name, length, modified, note in batch:
            if (name, length, modified, note) in rows and (name not in seen or modified > seen[name][1]):
                seen[name] = (note, modified, name in old)
        after = {r.name: [(f.name, f.stat().st_mtime_ns) for f in r.rglob("part-*")] for r in tmp_path.glob("m/*/bucket=*")}
        assert all(before[b] == after[b] for b in before if int(b.split("=")[1]) not in changed)
        got = {r.file_name: (r.modified, r.updated) for r in read_manifest(spark, store).collect()}
        assert got == {k: (m, u) for k, (_, m, u) in seen.items()}
        assert merge_files(files, store) == []
        assert len(after) <= 4


def test_lost_merge_leaves_what_was(spark, tmp_path):
    store = ManifestStore(str(tmp_path / "m"), COLUMNS, 2)
    files = spark.createDataFrame([(f"f{i}.png", 5, T, "a") for i in range(9)], COLUMNS)
    merge_files(files, store)
    was = shape(read_manifest(spark, store))
    lost = tmp_path / "m" / "generation=1"
    (lost / "bucket=0").mkdir(parents=True)
    (lost / "bucket=0" / "part-0.parquet").write_bytes(b"half")
    assert shape(read_manifest(spark, store)) == was
    later = spark.createDataFrame([("f1.png", 6, T + datetime.timedelta(hours=1), "b")], COLUMNS)
    assert len(merge_files(later, store)) == 1
    got = {r.file_name: (r.note, r.updated) for r in read_manifest(spark, store).collect()}
    assert got == {f"f{i}.png": (("b", True) if i == 1 else ("a", False)) for i in range(9)}
    one = intake.manifest(files, files.select(files.name.alias("file_name")).limit(0))
    assert one.count() == 9
