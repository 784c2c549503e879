"""Operator 9's reader on files that aren't what it wrote: many false members, many false records, no archive at all."""

import random
import time

import pytest

from cladewise.llm import warc

RECORD = warc.record("response", "7", "u", __import__("hashlib").sha1(b"body").hexdigest(), 4, b"body", None)


def spans(data):
    out = list(warc.salvage(data))
    at = 0
    for _, start, end, _ in out:
        assert at <= start < end
        at = end
    return [(what, start, end, x["payload"] if what == "record" else x) for what, start, end, x in out]


def took(data):
    start = time.process_time()
    spans(data)
    return time.process_time() - start


@pytest.mark.parametrize(
    "piece",
    [warc.member(b"no record"), b"\x1f\x8b\x08\xff", b"WARC/1.1\r\n", b"WARC/1.1\r\nA: b\r\n", b"\x1f\x8b\x08\xffWARC/1.1\r\n", b"WARC/1.1\r\nA: b\r\nContent-Length: 5\r\n\r\n"],
)
def test_false_pieces_take_time_in_proportion(piece):
    small, large = (piece * (n // len(piece)) for n in (1 << 20, 1 << 22))
    assert took(large) < 10 * max(took(small), 0.05)
    data = small + warc.member(RECORD) + small + RECORD + small
    assert [x for x in spans(data) if x[0] == "record"] == [("record", len(small), len(small) + len(warc.member(RECORD)), b"body"), ("record", 2 * len(small) + len(warc.member(RECORD)), 2 * len(small) + len(warc.member(RECORD)) + len(RECORD), b"body")]


@pytest.mark.parametrize("data", [b"x", b"\0" * 100_000, bytes(random.Random(3).randbytes(200_000)), b"%PDF-1.4\r\n" * 9])
def test_no_archive_is_one_gap(data):
    assert [(what, start, end) for what, start, end, _ in spans(data)] == [("gap", 0, len(data))]
    assert spans(b"") == []


def test_random_damage_loses_only_what_it_hits():
    draw = random.Random(11)
    for _ in range(40):
        records = [warc.record("revisit", str(k), "u", "d", 3, b"", "1") for k in range(12)]
        parts = [warc.member(r) if draw.random() < 0.5 else r for r in records]
        hit = draw.randrange(12)
        broken = bytearray(parts[hit])
        broken[0] ^= 0xFF
        data = b"".join([*parts[:hit], bytes(broken), *parts[hit + 1 :]])
        out = list(warc.salvage(data))
        names = [x["fields"]["warc-record-id"] for what, *_, x in out if what == "record"]
        assert names == [f"<{warc.NAME}{k}>" for k in range(12) if k != hit]
        assert [(s, e) for what, s, e, _ in out if what == "gap"] == [(sum(map(len, parts[:hit])), sum(map(len, parts[: hit + 1])))]
