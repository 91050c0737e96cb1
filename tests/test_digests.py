import hashlib
import os

from sheetwise.sources import artifacts, digests


def test_same_as_files_and_in_bounded_chunks(spark, tmp_path):
    """Small files share partitions, a large one is read in chunks; paths, lengths and digests are those of the plain reader."""
    contents = {f"sub{i % 3}/f{i:03d}": bytes([i % 251]) * (i * 7) for i in range(60)} | {"p.png": artifacts.PNG_SIGNATURE + b"0" * 600, "short.png": artifacts.PNG_SIGNATURE, "empty": b"", "large": os.urandom(3_000_000)}
    for name, data in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    root = f"file://{tmp_path}"
    out = digests.digests(spark, root, share=20_000)
    got = {os.path.relpath(r.path, tmp_path): (r.length, r.sha256, r.is_png) for r in out.collect()}
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest(), n == "p.png") for n, d in contents.items()}
    plain = {r.path.removeprefix("file:"): r.sha256 for r in artifacts.files(spark, str(tmp_path)).collect()}
    assert {r.path: r.sha256 for r in out.where("length > 0").collect()} == plain  # Spark's reader passes over empty files
    reader = digests.DigestReader({"path": root, "share": "20000"})
    packs = reader.partitions()
    assert 2 < len(packs) < 20 and sum(len(p.names) for p in packs) == len(contents)


def test_a_large_file_is_never_held(tmp_path):
    """A sparse file of 300 MB is hashed with little more memory than a chunk."""
    import tracemalloc

    with open(tmp_path / "huge", "wb") as f:
        f.truncate(300 << 20)
    reader = digests.DigestReader({"path": f"file://{tmp_path}"})
    tracemalloc.start()
    [batch] = reader.read(reader.partitions()[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.column("length").to_pylist() == [300 << 20] and peak < 6 * digests.CHUNK


def test_no_files(spark, tmp_path):
    assert digests.digests(spark, f"file://{tmp_path}").collect() == []
