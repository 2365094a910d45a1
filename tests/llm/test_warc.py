"""WARC archives that are damaged, padded, nested or of the same name."""

import gzip
import io

import pytest
from pyspark.sql import functions as F

from lexiqua.llm import warc


def record(name, body):
    return b"WARC/1.1\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (name, len(body), body)


def blocks(data):
    return [b for _, _, b in warc.read_records(warc.Inflated(io.BytesIO(data)))]


def test_padding_and_members():
    one, two = gzip.compress(record(1, b"abc")), gzip.compress(record(2, b"") + record(3, b"x" * 200_000))
    whole = [b"abc", b"", b"x" * 200_000]
    assert blocks(one + two) == blocks(one + two + bytes(5)) == blocks(one + bytes(200_000) + two + bytes(70_000)) == whole
    assert blocks(b"") == blocks(gzip.compress(b"")) == blocks(gzip.compress(b"\r\n\r\n") + bytes(3)) == []


@pytest.mark.parametrize("cut", [1, 5, 9, 40, 5_000, 60_000])
def test_a_cut_stream_is_an_error(cut):
    import random

    data = gzip.compress(record(1, random.Random(1).randbytes(100_000)))
    with pytest.raises(EOFError):
        blocks(data[:-cut])
    with pytest.raises(EOFError):
        blocks(gzip.compress(record(0, b"whole")) + data[:-cut])


def test_incomplete_records_are_errors():
    with pytest.raises(EOFError):
        blocks(gzip.compress(record(1, b"abcdef")[:-6]))
    for head in (b"WARC/1.1\r\nContent-Length: 3\r\n", b"WARC/1.1\r\nX: y\r\n\r\nabc", b"hello\r\n", record(1, b"abc") + b"abc"):
        with pytest.raises(ValueError):
            blocks(gzip.compress(head))
    with pytest.raises(ValueError):
        blocks(gzip.compress(record(1, b"a")) + b"junk")
    with pytest.raises(ValueError):
        blocks(b"no gzip at all")


def test_nested_and_same_named_archives(spark, tmp_path):
    source, target = tmp_path / "in", f"file://{tmp_path}/out"
    names = ["a.gz", "a.warc.gz", "deep/a.gz", "deep/down/b.txt.gz"]
    for n, name in enumerate(names):
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_bytes(gzip.compress(b"".join(record(10 * n + k, b"page %d" % k) for k in range(n + 1))))
    made = warc.normalise(spark, f"file://{source}", target)
    assert sorted(r["records"] for r in made.collect()) == [1, 2, 3, 4] and made.select("archive").distinct().count() == 4
    index = spark.read.schema(warc.INDEX).json(f"{target}/*.idx")
    ids = {r["record"] for r in index.collect()}
    assert ids == {f"<urn:page:{10 * n + k}>" for n in range(4) for k in range(n + 1)}
    # the same again writes the same files
    assert warc.normalise(spark, f"file://{source}", target).agg(F.sum("records")).first()[0] == 10
    assert len(list((tmp_path / "out").glob("*.warc.gz"))) == 4


def test_a_damaged_archive_ends_the_job(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.gz").write_bytes(gzip.compress(record(1, bytes(range(256)) * 400))[:-20])
    with pytest.raises(Exception, match="ends within a member"):
        warc.normalise(spark, f"file://{source}", f"file://{target}").collect()
    assert not [p for p in target.iterdir() if p.name.endswith((".warc.gz", ".idx"))]
