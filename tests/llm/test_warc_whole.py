"""Archives with records out of the ordinary."""

from __future__ import annotations

import gzip
import random

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import pytest

from canoply.llm import warc


def test_long_url(spark, compare, tmp_path):
    pages = {"page_id": [1, 2, 3], "url": ["u" * (1 << 21), "v", "w" * (1 << 20)], "html": ["same", "same", "other"]}
    pq.write_table(pa.table(pages), tmp_path / "pages.parquet")
    assert compare(warc.op4_warc(spark, str(tmp_path)), warc.OP4_SQL, tmp_path)


def archive(n):
    rng = random.Random(1)
    out = []
    for i in range(n):
        block = bytes(rng.randrange(256) for _ in range(3000))
        head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Block-Digest: sha1:{warc.digest(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
        out.append(head.encode() + block + b"\r\n\r\n")
    return out


def ids(got):
    return [x[3]["warc-record-id"][10:-1] for x in got if x[0] == "record"]


def test_bad_record_in_a_member():
    parts = archive(5)
    bad = [parts[0], parts[1][:-9] + b"????" + parts[1][-5:], *parts[2:]]
    zipped = gzip.compress(b"".join(bad))
    got = list(warc.salvage(zipped + gzip.compress(parts[0])))
    assert ids(got) == ["0", "2", "3", "4", "0"]
    assert [x[1:] for x in got if x[0] == "gap"] == [(0, len(zipped), "block digest differs")]


def test_damaged_member():
    parts = archive(40)
    zipped = gzip.compress(b"".join(parts))
    cut = list(warc.salvage(zipped[: len(zipped) * 3 // 4]))
    assert ids(cut) == [str(i) for i in range(len(ids(cut)))] and len(ids(cut)) >= 25
    assert [x[:3] for x in cut if x[0] == "gap"] == [("gap", 0, len(zipped) * 3 // 4)]
    wrong = bytearray(zipped)
    wrong[-6] ^= 255  # the trailer
    got = list(warc.salvage(bytes(wrong) + gzip.compress(parts[7])))
    assert ids(got) == [*map(str, range(40)), "7"] and [x[1:3] for x in got if x[0] == "gap"] == [(0, len(wrong))]


@pytest.mark.parametrize("piece", [24, 700, 1 << 20])
def test_pieces_of_a_file_read_as_the_whole(tmp_path, piece):
    parts = archive(12)
    bad = parts[3][:-9] + b"????" + parts[3][-5:]
    zipped = gzip.compress(parts[4] + parts[5])
    for k, data in enumerate((b"".join(parts), b"??" + bad + zipped + b"WARC/1.0" + parts[6] + zipped[:90] + parts[7] + parts[8][:500], b"", b"WARC/1.1\r", parts[1] + b"\x1f\x8b", bad * 2)):
        file = tmp_path / f"a{k}"
        file.write_bytes(data)
        with pafs.LocalFileSystem().open_input_file(str(file)) as f:
            ranged = warc.Ranged(f, piece)
            assert list(warc.salvage(ranged)) == list(warc.salvage(data))
            assert len(ranged.held) <= 2 and all(len(x) <= piece for _, x in ranged.held)


def test_marks_ahead():
    rng = random.Random(3)
    for _ in range(300):
        data = b"".join(rng.choice([b"ab", b"abc", b"a", b"-", b"xy"]) for _ in range(rng.randint(0, 40)))
        at = rng.randint(0, 20)
        want = min((x for x in (data.find(b"abc", at), data.find(b"xy", at)) if x >= 0), default=len(data))
        assert warc.ahead(data, at, (b"abc", b"xy"), rng.randint(3, 9)) == want


def test_archive_of_three_gigabytes(spark, tmp_path):
    """A sparse file: records around a gap of zeros, beyond what one value of Spark holds."""
    one, two, far = *archive(2), 3 << 30
    with open(tmp_path / "big.warc", "wb") as f:
        f.write(one)
        f.seek(far)
        f.write(two)
    (tmp_path / "small.warc").write_bytes(two)
    got = sorted((r.path.rpartition("/")[2], r.kind, r["at"], r.length, r.payload_bytes) for r in warc.read(spark, str(tmp_path)).collect())
    assert got == [
        ("big.warc", "gap", len(one), far - len(one), None),
        ("big.warc", "record", 0, len(one), 3000),
        ("big.warc", "record", far, len(two), 3000),
        ("small.warc", "record", 0, len(two), 3000),
    ]


def test_tasks_of_many_archives(spark, tmp_path):
    parts = archive(9)
    for i, x in enumerate(parts):
        (tmp_path / f"{i}.warc").write_bytes(x)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    found = warc.read(spark, f"file://{tmp_path}", payloads=True, task_bytes=7000)
    rows = found.collect()
    assert found.rdd.getNumPartitions() == 5 and sorted(r.record_id for r in rows) == [f"<urn:page:{i}>" for i in range(9)]
    assert {bytes(r.payload) for r in rows} == {x[-3004:-4] for x in parts}
