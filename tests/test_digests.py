import hashlib

import pytest

from quern.sources import digests
from quern.sources.readers import discover


def tree(content, block):
    blocks = [content[i : i + block] for i in range(0, max(1, len(content)), block)]
    return hashlib.sha256(b"".join(hashlib.sha256(b).digest() for b in blocks)).hexdigest()


def test_a_digest_is_that_of_the_blocks_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(digests, "BLOCK", 10)
    contents = {"b.csv": b"x" * 10, "sub/c d é%20.csv": bytes(range(256)), "sub/d.csv": b"y" * 101}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r["relative_path"].rsplit("/", 1)[-1]: (r["etag"], r["size"]) for r in discover(spark, str(tmp_path)).collect()}
    assert got == {n.rsplit("/", 1)[-1]: (tree(c, 10), len(c)) for n, c in contents.items()}


def test_a_file_above_two_gigabytes(spark, tmp_path):
    """Larger than a row can hold; the last byte tells the two apart."""
    size, at = (2 << 30) + 12_345, {}
    for name, last in (("a.csv", b"1"), ("b.csv", b"2")):
        with open(tmp_path / name, "wb") as f:
            f.truncate(size - 1)
            f.seek(size - 1)
            f.write(last)
    for r in discover(spark, str(tmp_path)).collect():
        at[r["relative_path"]] = r["etag"]
        assert r["size"] == size
    zeros = hashlib.sha256(bytes(digests.BLOCK)).digest()
    rest = bytes(size % digests.BLOCK - 1)
    want = lambda last: hashlib.sha256(zeros * (size // digests.BLOCK) + hashlib.sha256(rest + last).digest()).hexdigest()
    assert at == {"a.csv": want(b"1"), "b.csv": want(b"2")}


def test_no_files(spark, tmp_path):
    (tmp_path / "other.txt").write_text("x")
    assert discover(spark, str(tmp_path)).count() == 0
    (tmp_path / "a.csv").write_text("x")
    first = discover(spark, str(tmp_path))
    assert discover(spark, str(tmp_path), known=first).collect() == first.collect()


def test_an_edit_that_keeps_the_size_is_seen(spark, tmp_path):
    (tmp_path / "a.csv").write_text("abc")
    first = [r["etag"] for r in discover(spark, str(tmp_path)).collect()]
    (tmp_path / "a.csv").write_text("abd")
    assert first != [r["etag"] for r in discover(spark, str(tmp_path)).collect()]


@pytest.mark.parametrize("path", ["file:/tmp/x", "/tmp/x", "file:///tmp/x"])
def test_local_paths(tmp_path, path):
    place = tmp_path / "x"
    place.write_text("here")
    with digests.opened(path.replace("/tmp/x", str(place))) as f:
        assert f.read() == b"here"


@pytest.mark.parametrize("n", [0, 1, 49, 50, 51, 120, 500])
def test_first_lines_are_the_first(spark, tmp_path, n):
    """Files by name, lines as they stand, whatever task reads what."""
    from quern.sources.files import first_lines, split_by_date

    want = []
    for name, k in (("b.dat", 70), ("a.dat", 50), ("c.dat", 90)):
        (tmp_path / name).write_text("\n".join(f"{name}{i},2020-01-0{i % 3 + 1}T00:00:00Z,{i}" + "\n" * (i % 2) for i in range(k)))
    for name in ("a.dat", "b.dat", "c.dat"):
        want += [x for x in (tmp_path / name).read_text().split("\n") if x]
    assert sorted(r["value"] for r in first_lines(spark, str(tmp_path), n).collect()) == sorted(want[:n])
    if n == 120:
        split_by_date(spark, str(tmp_path), f"{tmp_path}/out", 40, 3)
        assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()) == sorted(want[:120])
