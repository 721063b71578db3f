"""Calls of a service, in batches, with bounded retries; what keeps failing goes to a table of its own.

A call takes a list of texts and returns a list of answers, one of which may be an exception. A batch that fails as a whole
counts as one try of each of its rows; they are then tried one by one, so that a bad row doesn't take others with it. No
row is tried more than ``attempts`` times. Waits grow as ``base * 2^n`` up to ``most``, and up to a tenth more.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from korvane.session import unused

Call = Callable[[list[str]], Sequence["str | BaseException"]]
ATTEMPTS, BASE, MOST = 3, 1.0, 60.0


def backoff(n: int, base: float = BASE, most: float = MOST, draw: float | None = None) -> float:
    """Seconds before try n + 1; ``draw`` from 0 to 1 sets how much of the tenth is added."""
    wait = min(base * 2**n, most)
    return wait + 0.1 * wait * (random.random() if draw is None else draw)


def tried(texts: list[str], call: Call, attempts: int = ATTEMPTS, base: float = BASE, most: float = MOST) -> list[tuple[str | None, str | None, int]]:
    """(answer, error, tries) of each text; an error only where no try succeeded."""
    out: list = [(None, None, 0)] * len(texts)
    left = list(range(len(texts)))
    for n in range(attempts):
        if not left:
            break
        if n:
            time.sleep(backoff(n - 1, base, most))
        groups = [left] if n == 0 else [[i] for i in left]  # after a failure one by one
        failed = []
        for group in groups:
            try:
                answers = list(call([texts[i] for i in group]))
                if len(answers) != len(group):
                    raise ValueError(f"{len(answers)} answers to {len(group)} texts")
            except Exception as error:
                answers = [error] * len(group)
            for i, answer in zip(group, answers, strict=True):
                bad = isinstance(answer, BaseException)
                out[i] = (None, f"{type(answer).__name__}: {answer}", n + 1) if bad else (answer, None, n + 1)
                failed += [i] * bad
        left = failed
    return out


def called(rows: DataFrame, text_col: str, call: Call, path: str, attempts: int = ATTEMPTS, base: float = BASE, most: float = MOST, batch: int = 50) -> tuple[DataFrame, DataFrame]:
    """(answered, rejected): ``rows`` with ``answer``, and those without one with their ``error``; both with ``tries``.

    All is written at ``path`` first, so that no row is called again when a result is read twice. Null texts aren't
    called; their answer is null.
    """
    spark = rows.sparkSession
    taken = {"answer", "error", "tries"} & {c.lower() for c in rows.columns}
    if taken:
        raise ValueError(f"columns are taken: {', '.join(sorted(taken))}")
    schema = StructType([*rows.schema, StructField("answer", StringType()), StructField("error", StringType()), StructField("tries", IntegerType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), batch):
                cut = part.iloc[a : a + batch]
                known = [i for i, t in enumerate(cut[text_col]) if t is not None]
                found = dict(zip(known, tried([cut[text_col].iloc[i] for i in known], call, attempts, base, most), strict=True))
                results = [found.get(i, (None, None, 0)) for i in range(len(cut))]
                yield cut.assign(**{c: [r[k] for r in results] for k, c in enumerate(("answer", "error", "tries"))})

    failed = unused(rows, "_failed")
    rows.mapInPandas(run, schema).withColumn(failed, F.col("error").isNotNull()).write.mode("overwrite").partitionBy(failed).parquet(path)
    whole = spark.read.schema(StructType([*schema, StructField(failed, BooleanType())])).parquet(path)
    return whole.where(~F.col(failed)).drop(failed, "error"), whole.where(F.col(failed)).drop(failed, "answer")
