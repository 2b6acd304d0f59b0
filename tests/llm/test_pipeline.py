"""The pipeline on the smallest tables, stage by stage, against plain Python."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def similarity(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.encode().lower().split(), b.encode().lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    out["input"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        if name != "token_files":
            assert made.columns == columns
        path = str(tmp_path_factory.mktemp(name) / "out")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        order = ["_metadata.file_path", "_metadata.row_index"]
        out[name] = docs.select(*docs.columns, *order).sort(*order).collect()
    return out


def test_quality_follows_labels(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages["quality"]}
    right = [(d in kept) == bool(q) for d, q in labels.items()]
    assert sum(right) >= 0.95 * len(right)


def test_one_of_each_group_stays(stages):
    before, after = {r.doc_id: r.text for r in stages["quality"]}, {r.doc_id for r in stages["near_duplicates"]}
    for d in set(before) - after:
        assert any(similarity(before[d], before[e]) > 0.6 for e in before if e != d)
    kept = sorted(after)
    assert len({before[d] for d in kept}) == len(kept)
    assert not any(similarity(before[a], before[b]) > 0.9 for k, a in enumerate(kept) for b in kept[:k])


def test_leaks_go_and_clean_documents_stay(spark, stages):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 8]) for i in range(max(1, len(w) - 7))}
    leaks = {r.doc_id for r in stages["near_duplicates"] if any(tuple(words(r.text)[i : i + 8]) in windows for i in range(len(words(r.text))))}
    assert {r.doc_id for r in stages["decontamination"]} == {r.doc_id for r in stages["near_duplicates"]} - leaks


def test_mixing_keeps_all(stages):
    assert sorted(r.doc_id for r in stages["mixing"]) == sorted(r.doc_id for r in stages["decontamination"])


def test_tokens_follow_the_mixed_order(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    start, expected = 0, []
    for r in stages["mixing"]:
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 0]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r)[:4] for r in stages["token_files"]) == sorted(expected)
