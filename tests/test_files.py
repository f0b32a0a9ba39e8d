import hashlib

from ledgerloom.sources import files


def test_hashes_of_small_and_streamed_files(spark, tmp_path, monkeypatch):
    contents = {"a b.bin": b"", "b.json": b"x" * 70_000, "c.csv": bytes(range(256)) * 40}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    wanted = [{"path": str(tmp_path / n), "bytes": len(c), "sha256": hashlib.sha256(c).hexdigest()} for n, c in contents.items()]
    paths = [str(tmp_path / n) for n in reversed(contents)]
    assert files.hashes(spark, paths) == wanted
    monkeypatch.setattr(files, "HASHED_WHOLE", 20_000)
    assert files.hashes(spark, paths) == wanted
    assert files.hashes(spark, []) == []


def test_text_is_written_in_place(spark, tmp_path):
    path = str(tmp_path / "sub" / "m.json")
    assert not files.exists(spark, path)
    for text in ("first — longer", "é2"):
        files.write_text(spark, path, text)
        assert files.exists(spark, path) and open(path, encoding="utf-8").read() == text
