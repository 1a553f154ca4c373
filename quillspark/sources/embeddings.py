"""Embeddings from a model server, fetched in partitions; failures are null, and the rows stay."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fetch(text: str, host: str = "http://localhost:11434", model: str = "nomic-embed-text", timeout_s: float = 30.0) -> list[float] | None:
    """One embedding, or None."""
    body = json.dumps({"model": model, "prompt": text}).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(f"{host}/api/embeddings", body, {"content-type": "application/json"}), timeout=timeout_s) as r:
            got = json.load(r).get("embedding")
    except (OSError, ValueError):
        return None
    return [float(x) for x in got] if got else None


def with_embeddings(df: DataFrame, text: str, get: Callable[[str], list[float] | None] = fetch, batch: int = 10, pause_s: float = 0.1, out: str = "embedding") -> DataFrame:
    """df with an embedding per row; after each batch there is a pause."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = []
            for i in range(0, len(p), batch):
                found += [get(t) if t else None for t in p[text].iloc[i : i + batch]]
                if i + batch < len(p):
                    time.sleep(pause_s)
            yield p.assign(**{out: found})

    return df.mapInPandas(run, schema)


def usable(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows that have an embedding."""
    return df.filter(F.col(column).isNotNull())
