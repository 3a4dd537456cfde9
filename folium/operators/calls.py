"""Calls of a slow outside function over rows: blocks under a budget, halving on failure, a token bucket, repair with a cap.

The function is injected: it takes a list of (id, text) and returns a dict from ids to answers; it may leave ids out, or raise. A
block that fails is asked again as halves, down to single rows; what an answer leaves out is asked once more. Each row
is accepted once, from the first answer that has it, and rows that were not asked for are dropped. Blocks are formed
within partitions, so calls run in parallel; a task that is lost asks its rows again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from folium.operators.lineage import settle

Call = Callable[[list[tuple]], dict]


class TokenBucket:
    """Lets `burst` through at once, then `rate` a second; take() waits. clock and sleep can be replaced."""

    def __init__(self, rate: float, burst: int, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.level, self.at = float(burst), clock()

    def take(self) -> None:
        now = self.clock()
        self.level, self.at = min(self.burst, self.level + (now - self.at) * self.rate), now
        if self.level < 1:
            self.sleep((1 - self.level) / self.rate)
            self.at = self.clock()
            self.level = 1.0
        self.level -= 1


def ask(block: list[tuple], call: Call, before: Callable[[], None] = lambda: None) -> tuple[dict, dict]:
    """Answers and numbers of calls, by id. A failure halves the block; what is left out is asked again once."""
    answers, calls = {}, dict.fromkeys((k for k, _ in block), 0)
    todo = [(block, False)]
    while todo:
        rows, again = todo.pop()
        before()
        for k, _ in rows:
            calls[k] += 1
        try:
            given = call(rows)
        except Exception:  # whatever the outside function raises is a failed call
            if len(rows) > 1:
                half = len(rows) // 2
                todo += [(rows[half:], again), (rows[:half], again)]
            continue
        wanted = {k for k, _ in rows}
        answers.update({k: v for k, v in given.items() if k in wanted and k not in answers and v is not None})
        left = [(k, t) for k, t in rows if k not in answers]
        if left and not again:
            todo.append((left, True))
    return answers, calls


def called(rows: DataFrame, id_col: str, text_col: str, call: Call, answer_type: str, budget: int = 4000, rate: float | None = None, burst: int = 1) -> DataFrame:
    """id_col, answer, state (answered or unanswered) and n_calls of each row; ids are unique. budget: characters of a block, or one row. rate: calls a second of one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = TokenBucket(rate, burst) if rate else None

        def answered(block: list[tuple]) -> pd.DataFrame:
            answers, calls = ask(block, call, bucket.take if bucket else lambda: None)
            out = [(k, answers.get(k), "answered" if k in answers else "unanswered", calls[k]) for k, _ in block]
            return pd.DataFrame(out, columns=[id_col, "answer", "state", "n_calls"], dtype=object)

        block, size = [], 0
        for batch in batches:
            for k, t in zip(batch[id_col].tolist(), batch["_text"].tolist()):
                if block and size + len(t) > budget:
                    yield answered(block)
                    block, size = [], 0
                block.append((k, t))
                size += len(t)
        if block:
            yield answered(block)

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")).mapInPandas(run, f"{id_col} {kind}, answer {answer_type}, state string, n_calls int")


def repaired(rows: DataFrame, text_col: str, rewrite: Callable[[Column, Column, int], Column], problem: Callable[[Column, Column], Column], attempts: int = 2) -> DataFrame:
    """rows with draft, state (accepted, or verbatim after the last attempt) and attempt.

    rewrite(source, last draft, attempt) gives a draft, problem(source, draft) what is wrong with it, null if nothing. Only rows with a problem
    are written again; after `attempts` the source itself stands.
    """
    source = F.col(text_col)
    open_, out = rows.withColumn("draft", rewrite(source, F.lit(None).cast("string"), 0)), None
    for attempt in range(attempts + 1):
        checked = settle(open_.withColumn("_problem", problem(source, F.col("draft"))))
        good = checked.where("_problem IS NULL").drop("_problem").withColumns({"state": F.lit("accepted"), "attempt": F.lit(attempt)})
        out = good if out is None else out.unionByName(good)
        open_ = checked.where("_problem IS NOT NULL").drop("_problem")
        if attempt < attempts:
            open_ = open_.withColumn("draft", rewrite(source, F.col("draft"), attempt + 1))
    return out.unionByName(open_.withColumns({"draft": source, "state": F.lit("verbatim"), "attempt": F.lit(attempts)}))
