"""The salvage reader on damage of all kinds, its time, and repeated or null ids."""

import os
import random
import time

import pytest

from bitquarry.llm import warc
from llm.test_operators_brute_force import pages


def record(k, payload=None):
    payload = payload if payload is not None else b"payload %d " % k * 30
    return warc.page_record(k, "u", payload, warc.sha256(payload), None)


def ids(found):
    return [x[2]["warc-record-id"].removeprefix("<urn:page:").removesuffix(">") for x in found if x[2] is not None]


def covered(found, size):
    """Places of records and gaps, in order and without holes."""
    spans = sorted({(x[0], x[1]) for x in found})
    at = 0
    for begin, length in spans:
        assert begin == at
        at += length
    assert at == size


def test_plain_records_after_a_damaged_member_and_the_reverse():
    member = bytearray(warc.member(record(1), 3))
    member[40] ^= 0xFF
    data = warc.member(record(0), 3) + bytes(member) + record(2) + b"garbage" + warc.member(record(3), 3) + record(4)
    found = list(warc.read_archive(data))
    assert ids(found) == ["0", "2", "3", "4"]
    assert [x[3] for x in found if x[2] is None][1] == "no version line"
    covered(found, len(data))


def test_records_before_the_damage_of_one_large_member_are_kept():
    records = [record(k, os.urandom(3000)) for k in range(60)]
    member = bytearray(warc.member(b"".join(records), 0))
    # The bytes are stored as they are: all can be read but the checksums of one record and the member.
    member[bytes(member).index(records[40][-1000:-900])] ^= 0x10
    found = list(warc.read_archive(bytes(member)))
    assert ids(found) == [str(k) for k in range(60) if k != 40] and [x[2] for x in found].count(None) == 1
    rng = random.Random(4)
    records = [record(k, " ".join(f"w{rng.randrange(999)}" for _ in range(600)).encode()) for k in range(60)]
    member = bytearray(warc.member(b"".join(records), 3))
    member[len(member) // 2 : len(member) // 2 + 60] = b"\xff" * 60
    found = list(warc.read_archive(bytes(member)))
    got = ids(found)
    assert got[:25] == [str(k) for k in range(25)] and len(got) < 60 and [x[2] for x in found].count(None) == 1
    # Without digests nothing proves such records.
    bare = [b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3000\r\n\r\n" + os.urandom(3000) + b"\r\n\r\n" for _ in range(60)]
    member = bytearray(warc.member(b"".join(bare), 3))
    member[len(member) * 2 // 3] ^= 0x10
    assert [x[2] for x in warc.read_archive(bytes(member))] == [None]


def test_false_starts_in_a_gap():
    junk = (warc._MAGIC + b"\0" * 7 + b"WARC/1.0\r\n") * 50
    data = record(0) + junk + warc.member(record(1), 3) + warc._MAGIC
    found = list(warc.read_archive(data))
    assert ids(found) == ["0", "1"] and [x[2] for x in found].count(None) == 2
    covered(found, len(data))


def test_members_have_a_bounded_size():
    bomb = warc.member(b"\0" * 5_000_000, 9)
    with pytest.raises(warc.Damaged, match="too large"):
        warc.inflate(bomb, 0, most=1_000_000)
    assert warc.inflate(b"xx" + bomb + b"yy", 2) == (b"\0" * 5_000_000, len(bomb) + 2)


def test_time_is_linear():
    one = b"".join(warc.member(record(k, os.urandom(4000)), 1) for k in range(1500))

    def seconds(data):
        began = time.process_time()
        assert sum(1 for _ in warc.read_archive(data)) == len(data) // len(one) * 1500
        return time.process_time() - began

    few, many = seconds(one), seconds(one * 4)
    assert many < 8 * few + 0.5


def test_repeated_and_null_ids(spark):
    big, other = "x" * 200, "y" * 200
    df = pages(spark, [(3, "u", big), (3, "v", big), (5, "u", big), (None, "u", big), (None, "u", other), (None, "w", other), (7, "u", "z" * 99), (8, "u", "z" * 99)])
    rows = warc.page_rows(warc.read_archives(warc.write_archives(warc.plan_revisits(df)))).collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in rows) == sorted(
        [("3", "response", None), ("3", "response", None), ("5", "revisit", 3), ("None", "revisit", 3), ("None", "response", None), ("None", "response", None), ("7", "response", None), ("8", "response", None)], key=str
    )
