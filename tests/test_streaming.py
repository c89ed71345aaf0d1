"""A stream of proposals in any order ends with the glossary that the batch run has."""

import json
import os
import random

import pytest

from parlance.plans import parts
from parlance.streaming import glossary


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, glossary.STATE_STORE)
    yield spark
    spark.conf.set(key, before)


def streamed(spark, folder, batches):
    """Terms after each batch of files, from one checkpoint: every batch is a start anew."""
    os.makedirs(f"{folder}/in")
    out = []
    for i, batch in enumerate(batches):
        with open(f"{folder}/in/{i}.json", "w") as f:
            f.write("\n".join(json.dumps(m) for m in batch))
        source = spark.readStream.schema(glossary.PROPOSALS).json(f"{folder}/in")
        query = glossary.streamed_terms(source).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
        out.append({tuple(r) for r in spark.read.schema(glossary.TERMS).parquet(f"{folder}/out").select("run_id", "source", "target", "notes", "origin").collect()})
    return out


def test_any_order_gives_the_batch_result(rocks, tmp_path):
    rng = random.Random(1)
    message = lambda r, p, *terms: {"run_id": r, "part_index": p, "terms": [{"source": s, "target": t, "notes": n} for s, t, n in terms]}
    words = ["Word", "word ", "other", "Third", "", "é", "É"]
    messages = [message(r, p, *[(rng.choice(words), f"{r}{p}{k}", rng.choice([None, "n"])) for k in range(3)]) for r in "ab" for p in range(6)] + [message("seeds", 0, ("only", "s", None)), message("none", 0)]
    rng.shuffle(messages)
    messages += messages[:4]  # some come twice
    got = streamed(rocks, str(tmp_path), [messages[:5], messages[5:11], messages[11:]])
    assert got[0] <= got[1] <= got[2]
    rows = [(m["run_id"], m["part_index"], [tuple(t.values()) for t in m["terms"]]) for m in messages[:14] if m["part_index"]]
    translated = rocks.createDataFrame(rows, "run_id string, part_index int, proposed array<struct<source: string, target: string, notes: string>>")
    seeds = rocks.createDataFrame([(m["run_id"], i, *t.values()) for m in messages[:14] if not m["part_index"] for i, t in enumerate(m["terms"])], "run_id string, ord int, source string, target string, notes string")
    batch = {tuple(r) for r in parts.proposed_terms(translated, seeds).select("run_id", "source", "target", "notes", "origin").collect()}
    assert got[2] == batch


def test_a_missing_part_holds_back(rocks, tmp_path):
    one = lambda p: {"run_id": "r", "part_index": p, "terms": [{"source": f"s{p}", "target": "t", "notes": None}]}
    got = streamed(rocks, str(tmp_path), [[one(0), one(2), one(3)], [one(1)]])
    assert {s for _, s, *_ in got[0]} == {"s0"} and {s for _, s, *_ in got[1]} == {"s0", "s1", "s2", "s3"}


def test_other_state_stores_are_refused(spark):
    with pytest.raises(ValueError, match="providerClass"):
        glossary.streamed_terms(spark.createDataFrame([], glossary.PROPOSALS))
