"""Greedy packing of prompts into batches under a limit of tokens and of prompts.

The running sum starts anew at each batch, which no window frame expresses; it is folded
over Arrow batches of a group's sorted rows, so that a group of any size streams. Groups (a
day, a project, a session) are independent and run in parallel.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens
from ..schemas import PROMPT_OVERHEAD, STRATEGIES


def greedy_batches(prompts: DataFrame, text: str, group: str, order: list[str], max_tokens: int, max_prompts: int | None = None, longest_first: bool = False) -> DataFrame:
    """prompts with tokens and batch (from 0 in each group). The effective limit is max_tokens less the overhead; a longer prompt is a batch of its own."""
    limit = max_tokens - PROMPT_OVERHEAD
    rows = prompts.withColumn("tokens", estimate_tokens(F.col(text)))
    sort = [F.desc("tokens")] if longest_first else []
    rows = rows.repartition(group).sortWithinPartitions(group, *sort, *order)
    at_group, at_tokens = rows.columns.index(group), rows.columns.index("tokens")

    def fold(batches):
        now, batch, total, n = object(), -1, 0, 0
        for b in batches:
            out = []
            for g, t in zip(b.column(at_group).to_pylist(), b.column(at_tokens).to_pylist()):
                t = t or 0
                if g != now:
                    now, batch, total, n, full = g, -1, 0, 0, True
                alone = t > limit
                if alone or full or total + t > limit or (max_prompts is not None and n >= max_prompts):
                    batch, total, n = batch + 1, 0, 0
                total, n, full = total + t, n + 1, alone
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "batch"])

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())])
    return rows.mapInArrow(fold, schema)


#: Strategies of known models, in the order in which names are looked for.
MODELS = {"llama3.2": "micro", "phi3:mini": "micro", "gemma3:4b": "micro", "mistral:7b": "small", "llama3:8b": "small", "codellama:7b": "small", "llama3:70b": "standard", "mixtral": "standard", "qwen2.5:14b": "standard"}


def strategy_of(model: str) -> tuple[str, tuple[int, int]]:
    """Batch strategy of a model: by exact name, else by the first known name within it, else micro."""
    low = model.lower()
    name = MODELS.get(low) or next((s for m, s in MODELS.items() if m in low), "micro")
    return name, STRATEGIES[name]


def strategy_column(model: Column) -> Column:
    """Name of the strategy of a model, as strategy_of gives it."""
    low, out = F.lower(model), F
    for test in (lambda m: low == m, lambda m: low.contains(m)):
        for m, s in MODELS.items():
            out = out.when(test(m), s)
    return out.otherwise("micro")
