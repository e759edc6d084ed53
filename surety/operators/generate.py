"""The boundary to models: user functions over Arrow batches. No model is part of the library."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def generate(df: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], prompt="direct_prompt", out="prediction") -> DataFrame:
    """Adds out. make is called once a task and gives a function from prompts to texts, so a model loads once."""
    schema = T.StructType([f for f in df.schema if f.name != out] + [T.StructField(out, T.StringType())])
    names = [f.name for f in schema]

    def run(batches):
        model = make()
        for part in batches:
            part[out] = model(part[prompt].tolist())
            yield part[names]

    return df.mapInPandas(run, schema)


def first_token_logits(df: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], prompt="meta_prompt", out="logits") -> DataFrame:
    """Adds the logits of the first generated position as an array."""
    schema = T.StructType([f for f in df.schema if f.name != out] + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    names = [f.name for f in schema]

    def run(batches):
        model = make()
        for part in batches:
            part[out] = [[float(v) for v in row] for row in model(part[prompt].tolist())]
            yield part[names]

    return df.mapInPandas(run, schema)


def tokenise(df: DataFrame, make: Callable[[], Callable[[list[str]], list[list[int]]]], text="prompt", out="ids", max_length: int | None = None) -> DataFrame:
    """Adds token ids, cut to max_length."""
    schema = T.StructType([f for f in df.schema if f.name != out] + [T.StructField(out, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in schema]

    def run(batches):
        encode = make()
        for part in batches:
            part[out] = [ids[:max_length] for ids in encode(part[text].tolist())]
            yield part[names]

    return df.mapInPandas(run, schema)


def remote_chat(df: DataFrame, make: Callable[[], Callable[[str], dict]], direct="direct_prompt", meta="meta_prompt") -> DataFrame:
    """Adds prediction, meta_answer and token counts from a remote model.

    The function takes a prompt and gives {text, prompt_tokens, completion_tokens}. A failed call gives an empty text
    and no tokens; missing counts are 0.
    """
    added = {"prediction": T.StringType(), "meta_answer": T.StringType(), "prompt_tokens": T.LongType(), "completion_tokens": T.LongType(), "total_tokens": T.LongType()}
    schema = T.StructType([f for f in df.schema if f.name not in added] + [T.StructField(k, t) for k, t in added.items()])
    names = [f.name for f in schema]

    def run(batches):
        call = make()

        def safe(prompt):
            try:
                return call(prompt) or {}
            except Exception:
                return {}

        for part in batches:
            rows = []
            for a, b in zip(part[direct], part[meta], strict=True):
                x, y = safe(a), safe(b)
                sent = sum(int(z.get("prompt_tokens") or 0) for z in (x, y))
                got = sum(int(z.get("completion_tokens") or 0) for z in (x, y))
                rows.append((x.get("text") or "", y.get("text") or "", sent, got, sent + got))
            part = part.drop(columns=[c for c in added if c in part])
            yield pd.concat([part.reset_index(drop=True), pd.DataFrame(rows, columns=list(added))], axis=1)[names]

    return df.mapInPandas(run, schema)
