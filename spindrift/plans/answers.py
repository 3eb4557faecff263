"""Questions answered from retrieved chunks in one go, with any language model: context, prompt, answer, citations, grounding
and confidence, many queries in one job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rag
from ..sources import store


@dataclass(frozen=True)
class Model:
    """A language model: prompts and the best chunks' texts in, answers out, as columns; and how it counts tokens."""

    name: str
    generate: Callable[[Column, Column], Column]
    count_tokens: Callable[[Column], Column] = T.token_estimate


def stand_in(sentences: int = 3) -> Model:
    """Answers with the first sentences of the best chunk; the same context, the same answer."""
    return Model("stand-in", lambda prompt, best: F.array_join(F.slice(T.sentences(best), 1, sentences), " "))


def batched(name: str, load: Callable[[], Callable[[list[str]], list[str]]], size: int = 16) -> Model:
    """A model that is loaded once in a task and takes prompts in batches; a remote one is called the same way."""

    @F.pandas_udf("string")
    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for p in prompts:
            said: list[str] = []
            for at in range(0, len(p), size):
                said += model(p.iloc[at : at + size].tolist())
            yield pd.Series(said)

    return Model(name, lambda prompt, best: run(prompt))


def ask(
    queries: DataFrame, chunks: DataFrame, model: Model, template: str = "qa", history: DataFrame | None = None, budget: int = rag.BUDGET, **how
) -> DataFrame:
    """query_id, model, answer (with citations), refs, n_chunks, prompt_tokens, grounding_score, risk, confidence, tier for each
    of the queries (query_id, query) that has a context; the others: no answer, no confidence.

    chunks: query_id, doc_id, title, text, score, as a retrieval gives them; history: query_id, history. The context and
    the answers are written once; citations, grounding and confidence read them."""
    ctx = store.kept(rag.build_context(chunks, budget, **how))
    best = ctx.where("place = 1").select("query_id", F.col("text").alias("best"))
    rows = rag.assemble(ctx).join(queries.select("query_id", "query"), "query_id").join(best, "query_id")
    past = F.lit("") if history is None else F.coalesce("history", F.lit(""))
    rows = rows if history is None else rows.join(history, "query_id", "left")
    prompted = rows.select("query_id", "best", rag.render(template, F.col("context"), F.col("query"), past).alias("prompt"))
    said = store.kept(prompted.select(
        "query_id", model.count_tokens(F.col("prompt")).alias("prompt_tokens"), model.generate(F.col("prompt"), F.col("best")).alias("answer")
    ))
    cited, ground, stats = rag.cite(said, ctx), rag.ground(said, ctx), rag.context_stats(ctx)
    sure = rag.confidence(ctx, stats, ground, cited).select("query_id", F.col("overall").alias("confidence"), "tier")
    out = queries.select("query_id").join(said.select("query_id", "prompt_tokens"), "query_id", "left").join(
        cited.select("query_id", F.col("annotated").alias("answer")), "query_id", "left"
    )
    for more in (rag.references(ctx), stats.select("query_id", "n_chunks"), ground.select("query_id", "grounding_score", "risk"), sure):
        out = out.join(more, "query_id", "left")
    return out.select(
        "query_id", F.lit(model.name).alias("model"), "answer", "refs", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "prompt_tokens",
        "grounding_score", "risk", "confidence", "tier"
    )
