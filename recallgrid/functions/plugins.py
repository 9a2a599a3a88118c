"""Places where a caller's own model goes in, with rule-based stand-ins."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def extractive_completer(prompts: pd.Series) -> pd.Series:
    """Default completer: first three sentences and the last."""

    def short(text: str) -> str:
        s = [p.strip() for p in re.split(r"[.!?]", text or "") if p.strip()]
        return text if len(s) <= 4 else f"{'. '.join(s[:3])}. ... {s[-1]}"

    return prompts.map(short)


def complete(prompts: DataFrame, completer: Callable[[pd.Series], pd.Series] = extractive_completer, column: str = "prompt") -> DataFrame:
    """Adds `reply` to rows with a prompt, by a Series to Series function."""

    def run(s: pd.Series) -> pd.Series:
        return completer(s)

    return prompts.withColumn("reply", F.pandas_udf(run, "string")(F.col(column)))


def classify(rows: DataFrame, classifier: Callable[[pd.Series], pd.Series], column: str = "content") -> DataFrame:
    """Adds `label`, by a Series to Series function."""

    def run(s: pd.Series) -> pd.Series:
        return classifier(s)

    return rows.withColumn("label", F.pandas_udf(run, "string")(F.col(column)))


def extract(requests: DataFrame, chat: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Raw replies `(transcript, part, status, reply)` of a batch function over
    requests `(transcript, part, text)`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield chat(pdf)[["transcript", "part", "status", "reply"]]

    return requests.select("transcript", "part", "text").mapInPandas(run, "transcript long, part long, status int, reply string")
