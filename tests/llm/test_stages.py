"""Stages of the pipeline against plain versions on their own input."""

import numpy as np

import corpus_pipeline
from test_pairs import plain_components, plain_overlap, plain_print
from trialspark.llm import decontaminate as C
from trialspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_overlaps(words, item):
    """Whether some offset of the item accepts an overlap; offsets with too few equal words are left out first."""
    least = min(13, len(item))
    i, j = np.nonzero(words[:, None] == item[None, :])
    shifts, equal = np.unique(i - j, return_counts=True)
    for shift in shifts[equal >= 0.8 * least - 1e-9].tolist():
        a, b = max(0, shift), min(len(words), shift + len(item))
        if plain_overlap(words[a:b].tolist(), item.tolist() if b - a == len(item) else item[a - shift:b - shift].tolist() + [-1]):
            return True
    return False


def test_first_stages_keep_what_plain_versions_keep(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows, kept = [(r["doc_id"], r["text"]) for r in docs.collect()], {}
    given = {"toxicity": rows}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.settle(stage(spark, docs, FOLDER), name)
        given[name] = rows
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        kept[name] = sorted(rows, key=lambda r: r[0])

    toxic = {r["doc_id"] for r in QUERIES["op2_toxicity"](spark, FOLDER).collect() if r["predicted"]}
    assert kept["toxicity"] == sorted((r for r in given["toxicity"] if r[0] not in toxic), key=lambda r: r[0])

    lowest = {}
    for row, root in zip(given["simhash_dedup"], plain_components([plain_print(t) for _, t in given["simhash_dedup"]])):
        lowest[root] = min(lowest.get(root, row), row, key=lambda r: r[0])
    assert kept["simhash_dedup"] == sorted(lowest.values(), key=lambda r: r[0])

    codes = C._Codes()
    items = [C._tokens(r["text"], codes) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    items = [w for w in items if len(w) >= C.MIN_WORDS]
    clean = [r for r in given["decontamination"] if not any(plain_overlaps(C._tokens(r[1], codes), w) for w in items)]
    assert kept["decontamination"] == sorted(clean, key=lambda r: r[0])


def test_stages_keep_columns_with_clashing_names(spark, tmp_path):
    """Columns called as the stages' own ones come through unchanged; `repeats` is the mix's."""
    names = ["__text", "__features", "__hash", "__key", "__version", "version", "fp", "size", "pattern", "repeats", "__low"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for i, name in enumerate(names):
        docs = docs.withColumn(name, docs["doc_id"] * 100 + i)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, FOLDER), name)
    assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars", *names}
    rows = docs.collect()
    assert len(rows) > 50
    for r in rows:
        assert all(r[n] == r["doc_id"] * 100 + i for i, n in enumerate(names) if n != "repeats") and 1 <= r["repeats"] <= 3
