"""Files too large for a cell, and large files hashed piece by piece."""

import hashlib

from attesta.sources import files as fl


def test_a_file_over_two_gigabytes(spark, tmp_path):
    size = 2**31 + 5
    with open(tmp_path / "big one.pdf", "wb") as f:     # sparse
        f.write(b"%PDF-1.7")
        f.truncate(size - 1)
        f.seek(size - 1)
        f.write(b"x")
    (tmp_path / "small.pdf").write_bytes(b"%PDF-1.7 x")
    digest, zeros, left = hashlib.sha256(b"%PDF-1.7"), bytes(1 << 24), size - 9
    while left:
        digest.update(zeros[:min(left, 1 << 24)])
        left -= min(left, 1 << 24)
    digest.update(b"x")
    files = fl.scan_files(spark, str(tmp_path))
    got = {r["file_name"]: (r["size"], r["sha256"]) for r in files.select("file_name", "size", "sha256").collect()}
    assert got == {"big one.pdf": (size, digest.hexdigest()), "small.pdf": (10, hashlib.sha256(b"%PDF-1.7 x").hexdigest())}
    checked = {r["file_name"]: (r["ok"], r["reason"]) for r in fl.check_files(files).select("file_name", "ok", "reason").collect()}
    assert checked == {"big one.pdf": (False, f"File is {size} bytes; limit is {20 << 20}"), "small.pdf": (True, None)}


def test_pieces_of_files_with_odd_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fl, "IN_MEMORY", 1)
    items = {"a b.txt": b"xyz" * 4_000_000, "ü+%20#.txt": b"yy", "one.txt": b"1", "none.txt": b""}
    (tmp_path / "deep er").mkdir()
    for name, data in items.items():
        (tmp_path / "deep er" / name).write_bytes(data)
    got = {r["file_name"]: (r["size"], bytes(r["content"]), r["sha256"]) for r in fl.scan_files(spark, str(tmp_path)).collect()}
    assert got == {n: (len(d), d, hashlib.sha256(d).hexdigest()) for n, d in items.items()}
