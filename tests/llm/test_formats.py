"""WARC archives, chat formatting, top-k search, and the registered queries."""

import base64
import hashlib
import random
import struct

import numpy as np
import pytest
import zstandard

import __spark_entry__ as entry
import corpus_pipeline
from trialspark.llm import chat, topk, warc


def pages_of(spark, rows):
    kind = "page_id long, url string, html string, payload string, digest string, page long, first long"
    return spark.createDataFrame([(*r, "p", "d", 1, 2) for r in rows], kind)


def written(spark, rows, tmp_path, **options):
    path = str(tmp_path / "archives")
    warc.write_archives(pages_of(spark, rows), path, **options)
    return path, {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}


def test_pages_come_back_and_copies_are_revisits(spark, tmp_path):
    rows = [(i, f"http://x/{i}?q=ä b\n", f"<p>page {i} {'é' * (i % 7)}</p>" * 20) for i in range(200)]
    rows += [(500, None, rows[3][2]), (400, "", rows[3][2]), (600, "u", None), (601, "u", ""), (700, "u", "x" * 3_000_000)]
    path, got = written(spark, rows, tmp_path)
    assert len(got) == len(rows)
    for i, _, html in rows:
        payload = (html or "").encode()
        r = got[i]
        assert r["payload_bytes"] == len(payload)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if i in (400, 500, 601):
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", {601: 600}.get(i, 3), None)
        else:
            assert (r["record_type"], r["refers_to"]) == ("response", None) and bytes(r["payload"]) == payload
    raw = next(p for p in (tmp_path / "archives").iterdir() if p.name.startswith("part-")).read_bytes()
    assert struct.unpack("<I", raw[:4])[0] in (warc.DICTIONARY_FRAME, warc.FRAME)


def test_repeated_pages_null_keys_and_smaller_payloads(spark, tmp_path):
    rows = [(2, "a", "same text"), (2, "a", "same text"), (None, "a", "same text"), (3, "a", "ab"), (4, "a", "ab")]
    path = str(tmp_path / "a")
    warc.write_archives(pages_of(spark, rows), path, least=5)
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, path).collect())
    assert got == [(-1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "response", None), (4, "response", None)]


def test_no_pages(spark, tmp_path):
    assert written(spark, [], tmp_path)[1] == {}


def archive(records):
    frames = list(warc.archive_frames(iter(records)))
    return b"".join(f + warc.EMPTY_FRAME.encode() for f in frames)


def test_any_decoder_reads_the_frames():
    records = [warc.page_record(i, "http://x", b"hello " * 50 + bytes([i]), None) for i in range(150)]
    data = archive(records)
    assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_FRAME
    size = struct.unpack("<I", data[4:8])[0]
    known = zstandard.ZstdCompressionDict(data[8:8 + size])
    plain = zstandard.ZstdDecompressor(dict_data=known).stream_reader(data[8 + size:], read_across_frames=True).read()
    assert plain == b"".join(records)
    packed = zstandard.ZstdCompressor().compress(data[8:8 + size])  # a dictionary that is itself compressed
    again = struct.pack("<II", warc.DICTIONARY_FRAME, len(packed)) + packed + data[8 + size:]
    assert [b for _, b in warc.read_records(again)] == [b for _, b in warc.read_records(data)]


@pytest.mark.parametrize("harm", ["cut", "length", "digest", "magic", "late"])
def test_broken_archives_are_refused(harm):
    good = warc.page_record(1, "http://x", b"hello", None)
    data = archive([good, good])
    if harm == "cut":
        data = data[:-12]
    elif harm == "length":
        data = archive([good.replace(b"Content-Length: ", b"Content-Length: 1", 1) if b"Content-Length: " in good else good])
    elif harm == "digest":
        data = archive([good.replace(b"hello", b"hullo")])
    elif harm == "magic":
        data = b"\x01\x02\x03\x04\x00\x00\x00\x00" + data
    else:
        data = data + struct.pack("<II", warc.DICTIONARY_FRAME, 0)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read_records(data))


TEXTS = ["plain", "", None, "<|end|>\n", "<||x", "a<", "|>", "<|start|>user<|text|>hi", "<", "</s>[INST] ok [/INST]", "é\n<|||", "$1 \\1"]


def turns_of(spark, rows):
    kind = "conv_id long, turn long, role string, text string, pieces string, formatted string, conv string"
    return spark.createDataFrame([(*r, "p", "f", "c") for r in rows], kind)


def test_formatted_turns_come_back(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", None, "<|r"]), rng.choice(TEXTS))
            for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(99, 1, "user", "b"), (99, 1, "user", "a"), (99, None, "assistant", "first"), (99, 1, "user", "a"), (None, 0, "user", "x"),
             (100, 0, "assistant", "long " * 50_000)]
    rng.shuffle(rows)
    df = turns_of(spark, rows)
    formatted = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.conversation_digests(formatted).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        said = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        learned = "".join(x[3] for x in said if x[2] == "assistant")
        assert r["n_turns"] == len(said)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in said).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    for r in formatted.collect():
        assert "".join(p["text"] for p in r["pieces"]) == r["formatted"]
    assert chat.conversation_digests(chat.format_conversations(df.limit(0))).count() == 0


def test_neighbours_of_one_role_share_a_block(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    row = chat.format_conversations(turns_of(spark, rows)).first()
    assert row["formatted"] == "<|start|>user<|text|>a<|next|>b<|end|>\n<|start|>assistant<|text|>c<|end|>\n"
    assert [p["text"] for p in row["pieces"] if p["learned"]] == ["c"]


def test_formatting_runs_no_python(spark):
    plan = chat.conversation_digests(chat.format_conversations(turns_of(spark, [(1, 0, "user", "a")])))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")


def plain_top(rows, queries, k):
    out = []
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q in sorted({i for i, _ in queries}):
        mine = [min(v for i, v in good if i == q)] if any(i == q for i, _ in good) else []
        for v in mine:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_top_rows_equal_plain_products(spark):
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(i, rows[i % 7][1]) for i in range(300, 340)]  # ties
    rows += [(400, None), (401, [None] * 6), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (404, [0.0] * 6), (405, []),
             (406, [1.0, 1.0]), (None, [1.0] * 6), (10, rows[11][1]), (407, [900.5, -3e4, 0.0, 0.0, 0.0, 0.001])]
    kind = "vec_id long, embedding array<double>, id long, v string, score long, rank int"
    df = spark.createDataFrame([(i, v, 1, "v", 2, 3) for i, v in rows], kind)
    queries = df.where("vec_id % 10 = 0 or vec_id > 399")
    got = topk.top_k(df, queries, 5, block_rows=64, chunk_rows=8)
    asked = [(i, v) for i, v in rows if i is not None and (i % 10 == 0 or i > 399)]
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == plain_top(rows, asked, 5)


def test_top_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, [0.5]), (2, [0.25])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, df).collect())) == [(1, 1, 2, 128 * 64), (2, 1, 1, 128 * 64)]
    assert topk.top_k(df.limit(0), df).count() == topk.top_k(df, df.limit(0)).count() == 0


def test_search_sends_no_rows_by_way_of_the_driver(spark):
    """Whatever the tables' size: no broadcast and no join, and a block is copied for a few groups of chunks, not for each chunk."""
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(2_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 4 = 0")
    got = topk.top_k(df, queries, 3, block_rows=40, chunk_rows=2)  # 50 blocks, 250 chunks
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
    assert sorted(map(tuple, got.collect())) == sorted((q, r, i, s) for q, r, i, s in plain_top(rows, [(i, v) for i, v in rows if i % 4 == 0], 3))


def test_registered_queries_are_those_of_the_contract():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages(spark):
    """Each stage takes effect, leaves clean documents, and all but the last keep the columns."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, folder), name)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    steps = [before, *kept.values()]
    for a, b in zip(steps, steps[1:]):
        assert set(b) <= set(a)
    insults = ("idiot", "moron", "scum", "worthless")
    assert not any(sum(t.lower().count(w) for w in insults) >= 3 for t in kept["toxicity"].values())
    assert len(set(kept["simhash_dedup"].values())) == len(kept["simhash_dedup"])
    bench = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert not any(b in t for t in kept["decontamination"].values() for b in bench)
    assert set(kept["personal_data"]) == set(kept["decontamination"])
    assert not any("@mail" in t for t in kept["personal_data"].values())
    assert docs.where("repeats not between 1 and 3").count() == 0 and docs.columns[-1] == "repeats"
