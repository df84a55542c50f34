"""Units of blocks decode alone; damage is noticed where it is."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from wayfold.llm import rans
from wayfold.llm.bpe import BYTE_BPE, encoder
from wayfold.llm.common import content, shared_path

SIZES = [3, 1, 700, 40, 2500, 1, 999, 1000, 1001, 5]


def file(block=1000):
    ids = np.random.default_rng(7).zipf(1.4, sum(SIZES)).clip(1, 40_000).astype(np.uint16)
    return ids, *rans.file_bytes([str(k) for k in range(len(SIZES))], ids, SIZES, block)


def test_units_hold_whole_documents():
    assert rans.runs(SIZES, 1000) == [(0, 4, 744), (4, 1, 2500), (5, 2, 1000), (7, 1, 1000), (8, 1, 1001), (9, 1, 5)]
    assert rans.runs([], 1000) == []


def test_a_unit_decodes_from_its_bytes_alone():
    ids, data, base, places = file()
    header, table = rans.header_of(data[:base])
    for u, place in zip(header["units"], places, strict=True):
        got = rans.unit_ids(data[place["at"] : place["at"] + place["bytes"]], table, u["blocks"])
        n = sum(SIZES[u["first"] : u["first"] + u["docs"]])
        assert got.tolist() == ids[u["first_id"] : u["first_id"] + n].tolist()
    assert [len(u["blocks"]) for u in header["units"]] == [1, 3, 1, 1, 2, 1]


def test_damage_is_noticed_in_its_unit_only():
    _, data, base, places = file()
    header, table = rans.header_of(data[:base])
    bad = bytearray(data)
    bad[places[1]["at"] + places[1]["bytes"] // 2] ^= 1
    parts = [bytes(bad[p["at"] : p["at"] + p["bytes"]]) for p in places]
    with pytest.raises(ValueError, match="checksum"):
        rans.unit_ids(parts[1], table, header["units"][1]["blocks"])
    for k in (0, 2, 3, 4, 5):
        rans.unit_ids(parts[k], table, header["units"][k]["blocks"])
    with pytest.raises(ValueError, match="damaged"):
        rans.header_of(bytes(base))


def test_files_of_many_units_are_read_back(spark):
    texts = [(k, "abc def " * (k * 37 % 50)) for k in range(200)] + [(500, "long text " * 3000), (501, None), (None, "x"), (3, "again")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    manifest = rans.write(docs, shared_path(spark, "rans-test"), file_ids_limit=1500, block=100)
    rows = spark.read.parquet(manifest).collect()
    assert len(rows) > 3 and max(len(r.units) for r in rows) > 3
    assert all(zlib.crc32(content(r.file)) == r.crc32 for r in rows)
    enc, at, want = encoder(BYTE_BPE), 0, []
    for key, text in sorted(((k, t or "") for k, t in texts), key=lambda d: (d[0] is not None, d[0] or 0, d[1])):
        ids = [*next(iter(enc.encode([text]))), 2]
        want.append((None if key is None else str(key), at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rans.read(spark, manifest).collect()), key=lambda r: r[1]) == want
