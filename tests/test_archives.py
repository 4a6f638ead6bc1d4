"""Verified archives: whole contents, hash gate, unsafe members, broken lines and archives cut short."""

import hashlib
import io
import json
import tarfile

import pytest

from behaviorlens.sources.archives import BATCH_ROWS, verified_archives


def archive(path, members):
    with tarfile.open(path, "w:gz") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
                tar.addfile(info)
            else:
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    return str(path), hashlib.sha256(path.read_bytes()).hexdigest()


def lines(n):
    return b"".join(json.dumps({"i": i}).encode() + b"\n" for i in range(n))


def test_whole_archives(spark, tmp_path):
    many = 2 * BATCH_ROWS + 5
    made = dict([archive(tmp_path / "a.tar.gz", [("d", None), ("d/x.json", lines(many)), ("y.json", b"")]), archive(tmp_path / "b.tar.gz", [("x.json", b'{"k": "\xc3\xa4"}\r\n')])])
    made = {"file://" + k if k.endswith("b.tar.gz") else k: v for k, v in made.items()}
    df = verified_archives(spark, made)
    assert df.rdd.getNumPartitions() == 2
    found = sorted(tuple(r) for r in df.collect())
    a, b = made
    assert found == sorted([(a, "d/x.json", i, json.dumps({"i": i})) for i in range(many)] + [(b, "x.json", 0, '{"k": "ä"}')])
    first = verified_archives(spark, {a: made[a]}, most_rows=3)
    assert [r["line_no"] for r in first.collect()] == [0, 1, 2]
    assert verified_archives(spark, {}).count() == 0


BAD = {
    "unsafe": [("../x", lines(1))], "absolute": [("/x", lines(1))], "repeated": [("x", lines(1)), ("x", lines(1))], "incomplete last line": [("x", lines(1) + b'{"i": 2}')],
    "no JSON": [("x", b"{\n")], "no object": [("x", b"[1]\n")], "above the limit": [("x", b'{"a": "' + b"x" * 70_000 + b'"}\n')], "no readable": [("d", None), ("x", b"")],
}


@pytest.mark.parametrize("why", sorted(BAD))
def test_refused(spark, tmp_path, why):
    path, digest = archive(tmp_path / "a.tar.gz", BAD[why])
    with pytest.raises(Exception, match=why if why not in ("absolute", "repeated") else "unsafe, repeated"):
        verified_archives(spark, {path: digest}).collect()


def test_hash_sizes_and_cut_archives(spark, tmp_path):
    path, digest = archive(tmp_path / "a.tar.gz", [("x", lines(50)), ("y", lines(5))])
    for kwargs, why in (({"most_compressed": 10}, "no file of 1 to"), ({"most_expanded": 20}, "expanded size"), ({"most_members": 1}, "too many members")):
        with pytest.raises(Exception, match=why):
            verified_archives(spark, {path: digest}, **kwargs).collect()
    with pytest.raises(Exception, match="another SHA-256"):
        verified_archives(spark, {path: "0" * 64}).collect()
    with pytest.raises(Exception, match="no SHA-256"):
        verified_archives(spark, {path: "zz"}).collect()
    cut = tmp_path / "cut.tar.gz"
    cut.write_bytes(open(path, "rb").read()[:-30])
    with pytest.raises(Exception, match="incomplete or unreadable"):
        verified_archives(spark, {str(cut): hashlib.sha256(cut.read_bytes()).hexdigest()}, most_rows=1).collect()
