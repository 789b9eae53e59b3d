"""Order-dependent operators with keyed state: online template mining and adaptive bins.

Lines of a source must arrive in order across micro-batches; inside one they are sorted. The keyed
state needs the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.operators.drain import Tree, tokenize

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

MINED = "source string, n_tokens int, line_no long, cluster long, template string"
BINNED = "source string, line_no long, template string, bin long"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Keyed(StatefulProcessor):
    """One string of state per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", T.StructType([T.StructField("text", T.StringType())]))

    def close(self) -> None:
        pass

    def _load(self) -> str | None:
        return self.held.get()[0] if self.held.exists() else None


class Miner(_Keyed):
    """Prefix tree of one (source, n_tokens) bucket."""

    def __init__(self, depth: int, st: float, max_child: int):
        self.args = (depth, st, max_child)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(rows).sort_values("line_no")
        tree = Tree(*self.args, self._load())
        cluster = [tree.assign(list(t)) for t in data["toks"]]
        if tree.changed:
            self.held.update((tree.state(),))
        templates = [" ".join(t) for t in tree.templates()]
        yield pd.DataFrame(
            {
                "source": key[0],
                "n_tokens": key[1],
                "line_no": data["line_no"],
                "cluster": cluster,
                "template": [templates[c] for c in cluster],
            }
        )


class Binner(_Keyed):
    """Bin number and open bin of one source."""

    def __init__(self, k: int):
        self.k = k

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(rows).sort_values("line_no")
        saved = (self._load() or "0").split("\0")
        current, seen, out = int(saved[0]), set(saved[1:]), []
        for t in data["template"]:
            out.append(current)
            seen.add(t)
            if len(seen) == self.k:
                current, seen = current + 1, set()
        self.held.update(("\0".join([str(current), *sorted(seen)]),))
        yield pd.DataFrame(
            {"source": key[0], "line_no": data["line_no"], "template": data["template"], "bin": out}
        )


def mine_stream(
    lines: DataFrame, depth: int = 5, st: float = 0.5, max_child: int = 3, patterns: Sequence[str] = ()
) -> DataFrame:
    """Each line with its cluster and that cluster's template after the micro-batch.

    A line too short to be routed is its own template and has no cluster.
    """
    tokenized = tokenize(lines, patterns).select("source", "n_tokens", "line_no", "toks")
    routed = tokenized["n_tokens"] >= depth - 2
    mined = (
        tokenized.filter(routed)
        .groupBy("source", "n_tokens")
        .transformWithStateInPandas(Miner(depth, st, max_child), MINED, "append", "none")
    )
    own = F.array_join("toks", " ").alias("template")
    short = tokenized.filter(~routed).select("source", "n_tokens", "line_no", F.lit(None).cast("long").alias("cluster"), own)
    return mined.unionByName(short)


def bins_stream(lines: DataFrame, k: int = 5) -> DataFrame:
    """Adaptive bins of an endless series."""
    return (
        lines.select("source", "line_no", "template")
        .groupBy("source")
        .transformWithStateInPandas(Binner(k), BINNED, "append", "none")
    )
