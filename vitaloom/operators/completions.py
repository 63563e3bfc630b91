"""Profiles from a user-supplied completion client instead of the native extractor.

A client is anything with `complete_json(system_prompt, user_prompt) -> str`. It is built
once per partition on the executors; what it answers is written to a table before it is
parsed, so that a retry or a later run does not repeat paid calls.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaloom import constants as C
from vitaloom import schemas as S
from vitaloom.operators.artifacts import not_yet_stored
from vitaloom.operators.extract import prompts
from vitaloom.operators.validate import conform_profiles, parse_payloads
from vitaloom.sources.tables import stored


class CompletionClient(Protocol):
    def complete_json(self, system_prompt: str, user_prompt: str) -> str: ...


ClientFactory = Callable[[], CompletionClient]
# name -> (settings) -> factory
Providers = Mapping[str, Callable[[dict[str, str]], ClientFactory]]


def client_factory(
    providers: Providers, provider: str, settings: dict[str, str] | None = None
) -> ClientFactory:
    """The factory registered under a name; an unknown name fails before any job starts."""
    name = provider.lower()
    if name not in providers:
        raise ValueError(f"Unsupported provider: {name}")
    return providers[name](settings or {})


def complete(prompted: DataFrame, factory: ClientFactory) -> DataFrame:
    """(doc_id, raw_response, error) of (doc_id, prompt); a failed call is a row.

    Any further columns stay. A task that fails asks its whole partition again.
    """
    kept = [f for f in prompted.schema if f.name not in ("doc_id", "prompt")]
    schema = S.T.StructType([*S.COMPLETION.fields, *kept])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for batch in batches:
            client = client or factory()
            rows = []
            for doc_id, prompt in zip(batch["doc_id"], batch["prompt"]):
                try:
                    rows.append((doc_id, client.complete_json(C.SYSTEM_PROMPT, prompt), None))
                except Exception as problem:  # one failed call must not lose the others
                    rows.append((doc_id, None, f"{type(problem).__name__}: {problem}"))
            answers = pd.DataFrame(rows, columns=[f.name for f in S.COMPLETION.fields])
            for field in kept:
                answers[field.name] = batch[field.name].to_numpy()
            yield answers

    return prompted.select("doc_id", "prompt", *[f.name for f in kept]).mapInPandas(run, schema)


def prompt_key(model: str, job_description: str | None = None) -> Column:
    """Digest of all a prompt is made of, and of the model that is asked."""
    job = F.col(job_description) if job_description else F.lit(None).cast("string")
    return F.sha2(
        F.to_json(
            F.struct(
                F.lit(model).alias("model"),
                F.lit(C.SYSTEM_PROMPT + C.PROMPT_TASK).alias("task"),
                job.alias("job"),
                F.col("text").alias("text"),
            )
        ),
        256,
    )


def extract_with_client(
    docs: DataFrame,
    factory: ClientFactory,
    folder: str,
    job_description: str | None = None,
    tasks: int | None = None,
    model: str = "",
) -> DataFrame:
    """(doc_id, profile, violations, reason) of (doc_id, text).

    Prompts answered in `folder` by the same model are not asked again; failed calls and
    changed texts, job descriptions or models are. Of several answers the newest counts.
    `tasks` spreads slow calls over that many tasks; the fewer rows a task has, the fewer
    calls a task that fails repeats. Prompts are built after that, in the task.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("prompt_key", prompt_key(model, job_description))
    answered = stored(spark, folder, S.KEPT_COMPLETION).where(F.col("error").isNull())
    todo = not_yet_stored(keyed, answered, "doc_id", "prompt_key")
    if tasks:
        todo = todo.repartition(tasks, "doc_id")
    asked = complete(prompts(todo, "doc_id", "prompt_key", job_description=job_description), factory)
    asked.withColumn("attempt", F.lit(time.time_ns())).select(
        *S.KEPT_COMPLETION.names
    ).write.mode("append").parquet(folder)

    newest = F.when(F.col("raw_response").isNotNull(), F.col("attempt"))
    responses = (
        stored(spark, folder, S.KEPT_COMPLETION)
        .groupBy("doc_id", "prompt_key")
        .agg(
            F.max_by("raw_response", newest).alias("raw_response"),
            F.max_by("error", "attempt").alias("error"),
        )
    )
    parsed = parse_payloads(
        keyed.select("doc_id", "prompt_key").join(responses, ["doc_id", "prompt_key"])
    )
    failed = F.when(F.col("raw_response").isNull(), F.col("error"))
    return conform_profiles(
        parsed.withColumn("reason", F.coalesce(failed, F.col("reason")))
    ).select("doc_id", "profile", "violations", "reason")
