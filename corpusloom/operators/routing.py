"""Model calls by task: which model a task goes to, by which name that model takes a cap of tokens, and requests that
stay within a budget of tokens and a number of calls at once.

The tables of models and tasks are settings of a deployment, a few rows each; they enter a plan as literals.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.remote import Remote
from corpusloom.streaming.sinks import shared_dir


@dataclass(frozen=True)
class Routes:
    """`models`: the name of each model's parameter for a cap. `tasks`: the model of each task; all others go to
    `default`. `caps`: the cap of tasks whose calls name none; 0 is no cap. Unknown models take `cap_name`."""

    default: str
    models: dict[str, str]
    tasks: dict[str, str] = field(default_factory=dict)
    caps: dict[str, int] = field(default_factory=dict)
    cap_name: str = "max_tokens"

    def model(self, task: Column) -> Column:
        return F.coalesce(looked_up(self.tasks, task), F.lit(self.default))

    def parameters(self, task: Column, budget: Column, own: Column) -> Column:
        """JSON of a call's parameters: its own ones, and its budget or its task's cap under the model's name for it,
        unless its own ones have that name already."""
        cap = F.coalesce(budget.cast("long"), F.nullif(looked_up(self.caps, task).cast("long"), F.lit(0)))
        name = F.coalesce(looked_up(self.models, self.model(task)), F.lit(self.cap_name))
        given = F.coalesce(own, F.create_map().cast("map<string,long>"))
        named = F.when(cap.isNotNull() & ~F.map_contains_key(given, name), F.create_map(name, cap)).otherwise(F.create_map().cast("map<string,long>"))
        entries = F.array_sort(F.map_entries(F.map_concat(given, named)))  # equal parameters are equal strings
        return F.to_json(F.map_from_entries(entries))


def looked_up(table: dict, key: Column) -> Column:
    if not table:
        return F.lit(None)
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def requests_of(sizes: list[int], most: int, tokens: int) -> Iterator[slice]:
    """Slices of at most `most` texts that hold at most `tokens` tokens; a text above that goes alone."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start == most or held + n > tokens):
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def answered(calls: DataFrame, prompt: str, routes: Routes, task: str, connect: Callable[[], Remote], budget: str | None = None, own: str | None = None, most: int = 256, tokens: int = 8192, at_once: int = 4) -> DataFrame:
    """`calls` with model, parameters (JSON) and reply. Calls of equal prompt, model and parameters are one call, rows
    without a prompt none (their reply is null, an empty prompt is asked). `connect` gives a task its client, which gets
    (model, parameters, prompts) and answers with a list as long; it is used by `at_once` threads. A text's tokens are
    reckoned as a quarter of its characters. Replies are written to a table of the shared folder first, so that no later
    step or lost executor asks again for what is there. Columns of `calls` named model, parameters, reply are not
    allowed; its rows, repeated ones too, all stay."""
    clash = {"model", "parameters", "reply"} & set(calls.columns)
    if clash:
        raise ValueError(f"calls have columns of their own named {sorted(clash)}")
    none = F.lit(None)
    t = F.col(task)
    routed = calls.withColumns({"model": routes.model(t), "parameters": routes.parameters(t, F.col(budget) if budget else none, F.col(own) if own else none)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remote = connect()
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                work = []
                rows = list(pdf.itertuples(index=False, name=None))
                for (model, parameters), group in groupby(rows, key=lambda r: r[1:3]):
                    texts = [r[0] for r in group]
                    work += [(model, json.loads(parameters), texts[s]) for s in requests_of([-(-len(x) // 4) for x in texts], most, tokens)]
                replies: list = []
                for (_, _, asked), got in zip(work, pool.map(remote, work), strict=True):
                    if len(got) != len(asked):
                        raise ValueError(f"{len(asked)} prompts sent, {len(got)} replies")
                    replies += got
                yield pdf.assign(reply=replies)

    asked = routed.filter(F.col(prompt).isNotNull()).select(F.col(prompt).alias("_prompt"), F.col("model").alias("_model"), F.col("parameters").alias("_parameters")).distinct()
    schema = "_prompt string, _model string, _parameters string, reply string"
    at = f"{shared_dir(calls.sparkSession)}/replies-{uuid.uuid4().hex}"
    asked.sortWithinPartitions("_model", "_parameters").mapInPandas(run, schema).write.parquet(at)
    replies = calls.sparkSession.read.schema(schema).parquet(at)
    same = (F.col(prompt) == F.col("_prompt")) & (F.col("model") == F.col("_model")) & (F.col("parameters") == F.col("_parameters"))
    return routed.join(replies, same, "left").drop("_prompt", "_model", "_parameters")
