"""The glossary of every run as a stream: parts propose terms in any order, and their terms are merged in the parts' own order.

State is kept for each run: the next part's number, parts that came too early, and the keys of the terms that stand. A part is
held back until all before it have come, so that the first to propose a term is the first in the run, not on the wire.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.glossary import trim

#: A part's message. part_index 0 has the run's seeds; n numbers the messages of a part from 0, and last says how many there are.
PROPOSALS = "run_id string, part_index int, terms array<struct<source: string, target: string, notes: string>>"
TERMS = "run_id string, ord long, source string, target string, notes string, origin string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(StatefulProcessor):
    """Gives each term of a run once, when its turn has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "part int")
        self.early = handle.getMapState("early", "part int", "terms string")
        self.known = handle.getMapState("known", "key string", "part int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        turn = self.next.get()[0] if self.next.exists() else 0
        for frame in rows:
            for part, terms in zip(frame["part_index"], frame["terms"], strict=True):
                # a part that comes again, as after a restart of its sender, changes nothing
                if part is not None and part >= turn and not self.early.containsKey((int(part),)):
                    told = [[t["source"], t["target"], t["notes"]] for t in (terms if terms is not None else ())]
                    self.early.updateValue((int(part),), (json.dumps(told, ensure_ascii=False),))
        out = []
        while self.early.containsKey((turn,)):
            for n, (source, target, notes) in enumerate(json.loads(self.early.getValue((turn,))[0])):
                if not trim(source or "") or not trim(target or "") or self.known.containsKey((name := trim(source).lower(),)):
                    continue
                self.known.updateValue((name,), (turn,))
                out.append((key[0], (turn << 31) + n, source, target, notes, "translator" if turn else "seed"))
            self.early.removeKey((turn,))
            turn += 1
        self.next.update((turn,))
        if out:
            yield pd.DataFrame(out, columns=["run_id", "ord", "source", "target", "notes", "origin"])

    def close(self) -> None:
        pass


def streamed_terms(proposals: DataFrame) -> DataFrame:
    """The terms of every run (run_id, ord, source, target, notes, origin), each when it stands, from a stream of parts' proposals.

    proposals: run_id, part_index (0: the run's seeds, which every run sends, if only with no terms; then from 1 without gaps) and
    terms. Seeds win, and earlier parts before later ones, in whatever order they arrive; a part that arrives twice counts once; terms
    without a source or a target are left out; a part that never comes holds back all after it. Needs RocksDB as the state store."""
    spark: SparkSession = proposals.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STATE_STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STATE_STORE}")
    return proposals.select("run_id", "part_index", "terms").groupBy("run_id").transformWithStateInPandas(statefulProcessor=Fold(), outputStructType=TERMS, outputMode="Append", timeMode="None")
