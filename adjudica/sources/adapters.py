"""What only Python does: dates in free text, JSON within prose, a model's answer."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from adjudica import settings as S


def fuzzy_date(x: Column, default: str) -> Column:
    """ISO text of a date in free text, its missing parts from the given day; null if there is none."""
    @F.arrow_udf("string")
    def made(texts: pa.Array) -> pa.Array:
        from datetime import datetime

        from dateutil import parser

        def one(value: str | None) -> str | None:
            try:
                return parser.parse(value, fuzzy=True, default=datetime.fromisoformat(default)).date().isoformat() if value else None
            except (ValueError, OverflowError):
                return None

        return pa.array([one(t.as_py()) for t in texts], pa.string())

    return made(x)


def json_block_of(text: str | None) -> str | None:
    """The first balanced {...}; braces within strings count as text."""
    start = (text or "").find("{")
    if start < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for at in range(start, len(text)):
        c = text[at]
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = quoted
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : at + 1]
    return None


def json_block(x: Column) -> Column:
    @F.arrow_udf("string")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([json_block_of(t.as_py()) for t in texts], pa.string())

    return made(x)


def ask(df: DataFrame, prompt_col: str, client: Callable[[], Callable[[str], str | None]] | None = None, tries: int = S.DEFAULTS.model_tries, pause: float = S.DEFAULTS.model_pause, out: str = "answer") -> DataFrame:
    """Adds a model's answer to each prompt. Equal prompts are asked once; the client is made once a partition. A call
    that fails is tried again after a pause in seconds. Without a client, every answer is null."""
    if client is None:
        return df.withColumn(out, F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for frame in frames:
            answers = []
            for prompt in frame["_prompt"]:
                answer = None
                for attempt in range(tries):
                    time.sleep(pause if attempt else 0)
                    try:
                        answer = call(prompt)
                        break
                    except Exception:  # noqa: BLE001  a model that fails leaves the rules to answer
                        continue
                answers.append(answer)
            yield frame.assign(**{"_answer": answers})

    asked = df.select(F.col(prompt_col).alias("_prompt"), F.sha2(prompt_col, 256).alias("_key")).filter("_prompt is not null").dropDuplicates(["_key"])
    answered = asked.mapInPandas(run, "_prompt string, _key string, _answer string").select("_key", F.col("_answer").alias(out))
    return df.withColumn("_key", F.sha2(prompt_col, 256)).join(answered, "_key", "left").drop("_key")


def answers_map(answer: Column) -> Column:
    """A map of strings from the JSON object in a model's answer."""
    return F.from_json(json_block(answer), "map<string,string>")


def dump(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)
