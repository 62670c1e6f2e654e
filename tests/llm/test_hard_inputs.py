"""Inputs that are made to be slow or to collide."""

from __future__ import annotations

import random
import struct
import time
import zlib

import pytest

from zonaris.llm import decontam, media, minhash
from zonaris.llm.textkit import words


def thue_morse(letters: str, n: int) -> str:
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 1 << 14])
def test_long_words_that_no_polynomial_tells_apart(spark, n):
    a, b = thue_morse("ab", n), thue_morse("ba", n)
    assert len(set(words([f"{a} {b} {a}"]).hash.tolist())) == 2
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    if n == 2048:
        assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, spark.createDataFrame([(7, a)], "item_id bigint, text string")).collect()} == {(1, 7), (3, 7)}


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"xyz") + chunk(b"IEND", b"")
GIF = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"!\xf9\x04\0\0\0\0\0" + b"," + bytes(8) + b"\0\2" + b"\3abc\2xy\0" + b";"


def plain_png(b: bytes, start: int) -> int | None:
    at = start + 8
    while at + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        if at + 12 + n > len(b) or (at == start + 8 and (kind != b"IHDR" or n != 13)) or not kind.isalpha():
            return None
        if zlib.crc32(b[at + 4 : at + 8 + n]) != struct.unpack_from(">I", b, at + 8 + n)[0]:
            return None
        at += 12 + n
        if kind == b"IEND":
            return at - start
    return None


def plain_gif(b: bytes, start: int) -> int | None:
    if len(b) < start + 14:
        return None
    at = start + 13 + (3 << (b[start + 10] & 7) + 1 if b[start + 10] & 128 else 0)
    while at < len(b):
        if b[at] == 0x3B:
            return at + 1 - start
        if b[at] == 0x2C and at + 10 < len(b):
            at += 11 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 128 else 0)
        elif b[at] == 0x21:
            at += 2
        else:
            return None
        while at < len(b) and b[at]:
            at += b[at] + 1
        at += 1
    return None


def test_walks_find_what_single_walks_find():
    rnd = random.Random(1)
    some = 0
    for _ in range(400):
        parts = [rnd.choice([PNG, GIF, PNG[: rnd.randint(8, len(PNG))], GIF[: rnd.randint(6, len(GIF))], bytes(rnd.choices(b"\0\1\2\3!,;ab", k=rnd.randint(0, 12))), b"GIF8", b"\x89PNG\r\n\x1a\n"]) for _ in range(rnd.randint(1, 8))]
        raw = b"".join(parts)
        file = media.File(raw)
        for at in range(len(raw)):
            if raw.startswith(b"GIF8", at):
                assert media._gif(file, at) == plain_gif(raw, at)
            if raw.startswith(b"\x89PNG\r\n\x1a\n", at):
                assert media._png(file, at) == plain_png(raw, at)
        some += len(media.sniff(raw))
    assert some > 200


@pytest.mark.parametrize("part", [b"GIF8aaaaaaaaa!", b"GIF8aaaaaa\x01aa!", "É".encode()[:0] + b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + bytes(17) + struct.pack(">I", 4_000_000) + b"IDAT"])
def test_five_megabytes_that_lead_nowhere(part):
    raw = part * (5_000_000 // len(part))
    start = time.perf_counter()
    assert media.sniff(raw) == []
    assert time.perf_counter() - start < 8  # under 2 s on an idle core
