"""Training prompts from a problem corpus. PRJ-1, PRJ-5, FLT-1."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import conversation, render_chat, token_count
from .rounds import shuffle_rows, shuffled_sample


def to_conversation(problems: DataFrame, style="boxed", key: str = "problem_id") -> DataFrame:
    """PRJ-1, PRJ-5. ``prompt`` becomes ``[system, user]`` messages, ``solution`` text."""
    return problems.select(
        key,
        conversation(F.col("prompt"), style).alias("prompt"),
        F.col("solution").cast("string").alias("solution"),
    )


def python_tokenizer(count: Callable[[list[str]], list[int]]) -> Callable[[Column], Column]:
    """UDF-3. Wrap a batch tokenizer as a length column; it is built once per worker."""

    @F.pandas_udf("int")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(count(texts.tolist()))

    return lengths


def filter_prompt_length(
    prompts: DataFrame,
    max_tokens: int,
    tokenizer: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """FLT-1. Drop prompts whose rendered form exceeds a token budget.

    The bound is inclusive, prompts are never truncated, and a budget of 0 or less
    turns the filter off. ``tokenizer`` maps the rendered text to its length.
    """
    if max_tokens <= 0:
        return prompts
    rendered = render_chat(F.col("prompt"), add_generation_prompt=True)
    return prompts.where((tokenizer or token_count)(rendered) <= max_tokens)


def training_prompts(
    problems: DataFrame,
    style: str = "boxed",
    max_samples: int | None = None,
    shuffle_seed: int | None = 42,
    max_prompt_tokens: int = 0,
    tokenizer: Callable[[Column], Column] | None = None,
    key: str = "problem_id",
) -> DataFrame:
    """Shuffle, cap, format and length-filter, in that order.

    A cap needs a seed, else partitioning would choose the rows; capped rows carry their
    place in the seeded order as ``row`` and come in no order.
    """
    if max_samples is None:
        chosen = shuffle_rows(problems, shuffle_seed, key)
    elif shuffle_seed is None:
        raise ValueError("a cap needs a shuffle seed")
    else:
        chosen = shuffled_sample(problems, max_samples, shuffle_seed, key)
    return filter_prompt_length(to_conversation(chosen, style, key), max_prompt_tokens, tokenizer)
