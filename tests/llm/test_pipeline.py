"""The pipeline's stages, each on its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_targets, prose

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def write(spark, path, docs, labels, bench):
    for name, rows, schema in (("documents", docs, COLUMNS), ("labels", labels, "doc_id bigint, quality int, toxic int"), ("benchmark", bench, "item_id bigint, text string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")


def test_pipeline(spark, tmp_path):
    leak = prose(900, 30)
    docs = [(i, prose(i, 150), "en", f"s{i % 2}", 1) for i in range(60)]
    docs += [(100, docs[0][1], "en", "s0", 1), (101, docs[1][1].replace(" ", "  "), "en", "s0", 1), (102, prose(200) + " " + leak, "en", "s1", 1), (103, "short.", "en", "s1", 1), (104, None, "en", "s1", 1), (105, "THE!! " * 100, "en", "s1", 1)]
    write(spark, str(tmp_path), docs, [], [(1, leak)])
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in rows}
    assert not kept & {100, 101, 102, 103, 104, 105}
    stages = dict(corpus_pipeline.STAGES)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, gone in (("quality rules", {103, 104, 105}), ("near-duplicates", {100, 101}), ("decontamination", {102})):
        out = stages[name](spark, frame, str(tmp_path))
        assert out.columns == frame.columns
        assert {d[0] for d in docs} - {r.doc_id for r in out.collect()} == gone
    taken = {}
    for r in rows:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert max(taken.values()) <= 3


def test_stages_on_odd_rows_and_labels(spark, tmp_path):
    bad = ["grobnik", "snarfel", "plutzer"]
    docs, labels = [], []
    for i in range(480):
        words = prose(5000 + i, 90).split()
        if i % 4 == 0:
            for k in (10, 41, 72):  # each of the three words
                words.insert(k, bad[(i + k) % 3])
        docs.append((i, " ".join(words), "en", "s" + str(i % 3), 1))
        if i % 6:
            labels.append((i, 1, int(i % 4 == 0)))
    same = prose(1, 120)
    odd = [(900, same, "en", None, 1), (900, same, "en", None, 1), (None, prose(2, 120), None, "s1", None), (None, same, "de", "s1", 1), (901, None, "en", "s0", 1), (902, "", "en", "s0", 1), (903, "x" * 200_000, "en", "s0", 1), (904, prose(3, 30_000), "en", "s0", 1)]
    write(spark, str(tmp_path), docs + odd, [*labels, (4, 1, 0), (None, 1, 1), (7777, 1, 1), (5, None, None)], [(1, prose(77, 30)), (2, None), (3, "")])
    stages = dict(corpus_pipeline.STAGES)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clashing = frame.withColumn("score", F.lit(1)).withColumn("size", F.lit("x")).withColumn("kept", F.lit(True)).withColumn("node", F.lit(1)).withColumn("item_id", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        wanted = [*frame.columns, "copy_index"] if name == "mixing" else frame.columns
        rows = Counter(stage(spark, frame, str(tmp_path)).collect())
        out = stage(spark, clashing, str(tmp_path))
        assert out.columns == wanted and Counter(out.collect()) == rows
        empty = stage(spark, frame.limit(0), str(tmp_path))
        assert empty.columns == wanted and empty.count() == 0
    ids = lambda name: Counter(r.doc_id for r in stages[name](spark, frame, str(tmp_path)).collect())
    everything = Counter(r.doc_id for r in frame.collect())
    assert set(everything) - set(ids("quality rules")) == {901, 902, 903}
    toxic = ids("toxicity")
    assert sum(i in toxic for i in range(0, 480, 4)) <= 12 and sum(i in toxic for i in range(480) if i % 4) >= 345
    once = ids("near-duplicates")
    assert once[900] == 1 and once[None] == 1 and once[901] == once[902] == 1 and sum(once.values()) == len(docs) + 6
    assert ids("decontamination") == everything
    # Words that the mix takes of each source come near its target.
    sizes, taken = Counter(), Counter()
    for r in frame.collect():
        sizes[r.source] += len((r.text or "").split())
    for r in stages["mixing"](spark, frame, str(tmp_path)).collect():
        taken[r.source] += len((r.text or "").split())
    want = brute_targets(sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in ("s1", "s2"))
