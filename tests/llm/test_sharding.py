"""Shards of a k-d tree: sizes, slots and places against a plain version."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import pytest

from trialspark.llm import sharding as K

KIND = "doc_id long, text string, lang string, source string, n_chars double, shard int, node string, size string"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], KIND)


def plain_shards(rows, shards):
    """Shard of each row by sorting every cell; rows that tie on all are told apart by their position."""
    def number(text):
        return None if text is None else int(text[:6].encode().hex().upper().ljust(12, "0")[:12], 16)

    points = []
    for i, (key, text, lang, source, n) in enumerate(rows):
        body = (text or "").encode()
        crc = zlib.crc32(body)
        h = md5(":".join(str(x) for x in (key, crc) if x is not None).encode()).hexdigest()
        x = [number(lang), number(source), None if n is None or n != n or abs(n) == float("inf") else n]
        points.append([i, len(body) + 1, int(h[:10], 16), x])
    for d in range(3):
        values = [p[3][d] for p in points if p[3][d] is not None]
        low, high = min(values, default=0), max(values, default=0)
        span = float(high) - low if high > low else 1.0
        for p in points:
            p[3][d] = 0 if p[3][d] is None else int((float(p[3][d]) - low) / span * ((1 << K.STEPS) - 2)) + 1
    out = {}

    def cut(cell, first, leaves):
        if leaves == 1 or not cell:
            for p in cell:
                out[p[0]] = first
            return
        width = [max(p[3][d] for p in cell) - min(p[3][d] for p in cell) for d in range(3)]
        d = max(range(3), key=lambda d: (width[d], -d))
        cell = sorted(cell, key=lambda p: (p[3][d], p[2], p[0]))
        left = leaves // 2
        rest = sum(p[1] for p in cell) * left // leaves
        sides = [], []
        for p in cell:
            sides[0 if 2 * rest >= p[1] else 1].append(p)
            rest -= p[1]
        cut(sides[0], first, left)
        cut(sides[1], first + left, leaves - left)

    cut(points, 0, shards)
    return out


def made(seed=4):
    rng = random.Random(seed)
    rows = [(i, "x" * rng.randint(0, 40) + rng.choice(["", "é", "字"]), rng.choice(["en", "de", None, ""]),
             rng.choice(["srcé1", "srcé2", "web"]), rng.choice([None, float("nan"), float("inf"), 1.0, rng.random() * 100]))
            for i in range(150)]
    return rows + [(None, None, None, None, None), (None, "y" * 30, "en", "web", 1.0), (7, "", "en", None, -5.0)]


@pytest.mark.parametrize("shards", [8, 5, 1])
def test_shards(spark, shards):
    rows = made()
    got = K.kd_shards(docs_of(spark, rows), shards=shards).collect()
    want = plain_shards(rows, shards)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == Counter(
        (k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), want[i]) for i, (k, t, *_) in enumerate(rows))
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))


def test_equal_rows_are_spread(spark):
    """A third of all rows are equal in everything; shards differ by less than two rows."""
    rows = made()[:100] + [(1, "same text", "en", "web", 3.0)] * 60
    got = K.kd_shards(docs_of(spark, rows), shards=4).collect()
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert len(got) == 160 and max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in got)
    again = K.kd_shards(docs_of(spark, rows[::-1]).repartition(3), shards=4).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_target_bytes(spark):
    rows = [(i, "z" * 99, "en", f"s{i % 7}", float(i)) for i in range(64)]
    got = K.kd_shards(docs_of(spark, rows), target_bytes=800).collect()
    assert Counter(r["shard"] for r in got) == {s: 8 for s in range(8)}


def test_empty_table_and_huge_document(spark):
    assert K.kd_shards(docs_of(spark, [])).collect() == []
    rows = [(0, "x" * 100_000, "en", "a", 1.0), *((i, "y", "en", "a", 1.0) for i in range(1, 10))]
    got = K.kd_shards(docs_of(spark, rows), shards=4).collect()
    assert len(got) == 10 and len({r["shard"] for r in got}) > 1


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [r for r in made()[:60]] + [(1, "same", "en", "web", 3.0)] * 20
    docs = docs_of(spark, rows).drop("shard")
    K.write_shards(docs, f"{tmp_path}/shards", shards=4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert back.select("shard", "slot").distinct().count() == 80


def test_native_plan(spark):
    text = K.kd_shards(docs_of(spark, made()))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
