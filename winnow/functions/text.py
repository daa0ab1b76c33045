"""Text functions: completions, boxed answers, numbers, answer normalisation.

STR-1..5, STR-13, PRJ-2..4.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_col, let

# Patterns and prompts that scores and prompts depend on.
BOX = "\\boxed{"
NUMBER_PATTERN = r"-?\d+(?:[.,]\d+)?"
THINK_ANSWER_PATTERN = r"^\s*<think>.*?</think>\s*<answer>.*?</answer>\s*$"
CLIPPED_RATIO_PATTERN = r"'completions/clipped_ratio': '([0-9.eE+-]+)'"
SYSTEM_PROMPTS = {
    "boxed": (
        "You are a helpful assistant that solves mathematics problems. "
        "Reason step by step, and put your final answer within \\boxed{}."
    ),
    "think_answer": (
        "A conversation between User and Assistant. The user asks a question, and "
        "the Assistant solves it. The assistant first thinks about the reasoning "
        "process in the mind and then provides the user with the answer. And the "
        "answer should be of the following format: \"Therefore, the final answer "
        "is: \\boxed{ANSWER}. I hope it is correct.\" (without quotes) where "
        "ANSWER is just the final number or expression that solves the problem. "
        "The reasoning process and answer are enclosed within <think> </think> "
        "and <answer> </answer> tags, respectively, i.e., <think> reasoning "
        "process here </think>\n<answer> answer here </answer>."
    ),
}

# The default prompt-length measure counts words and single other characters.
TOKEN_PATTERN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\f]"


def system_prompt(style) -> Column:
    """PRJ-2. System prompt of a style, given as a Python string or a Column.

    An unknown Python string fails at once; an unknown column value fails the job.
    """
    if isinstance(style, str):
        if style not in SYSTEM_PROMPTS:
            raise ValueError(
                f"unknown prompt style {style!r}; expected one of {sorted(SYSTEM_PROMPTS)}"
            )
        return F.lit(SYSTEM_PROMPTS[style])
    chosen = None
    for name, prompt in SYSTEM_PROMPTS.items():
        matches = style == name
        chosen = F.when(matches, prompt) if chosen is None else chosen.when(matches, prompt)
    message = F.concat(F.lit("unknown prompt style "), F.coalesce(style, F.lit("NULL")))
    return chosen.otherwise(F.raise_error(message).cast("string"))


def conversation(prompt, style="boxed") -> Column:
    """PRJ-1. ``[system, user]`` messages for a prompt column."""
    return F.array(
        F.struct(F.lit("system").alias("role"), system_prompt(style).alias("content")),
        F.struct(F.lit("user").alias("role"), as_col(prompt).alias("content")),
    )


def render_chat(messages, add_generation_prompt: bool = True) -> Column:
    """PRJ-3. One string per conversation.

    Each message becomes ``<|role|>\\n`` + content + ``<|end|>\\n``; the generation
    prompt is a trailing ``<|assistant|>\\n``.
    """
    body = F.array_join(
        F.transform(
            as_col(messages),
            lambda m: F.concat(
                F.lit("<|"), m["role"], F.lit("|>\n"),
                F.coalesce(m["content"], F.lit("")), F.lit("<|end|>\n"),
            ),
        ),
        "",
    )
    return F.concat(body, F.lit("<|assistant|>\n")) if add_generation_prompt else body


def token_count(text) -> Column:
    """Default prompt-length measure for FLT-1."""
    return F.regexp_count(as_col(text), F.lit(TOKEN_PATTERN))


def completion_text(messages) -> Column:
    """PRJ-4. Text of a chat completion: the content of its last message, or ``''``.

    Plain string completions need no conversion.
    """
    messages = as_col(messages)
    return F.coalesce(F.get(messages, F.size(messages) - 1)["content"], F.lit(""))


def _last_balanced_box(text: Column) -> Column:
    """Content of the last ``\\boxed{`` whose brace closes, for any nesting, in linear time.

    From the right a brace closes if more ``}`` than ``{`` have been met, so a counter finds
    the opener, as so many boxes from the end. From there a second counter finds the ``}`` that
    takes the depth below 0. Runs of one kind are one step.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(?:\\boxed\{)++|\{++|\}++"), F.lit(0))

    def back(state: Column, run: Column) -> Column:
        size = F.char_length(run)
        boxes = F.startswith(run, F.lit("\\"))
        opened = F.when(boxes, (size / len(BOX)).cast("int")).otherwise(size)
        closing = F.startswith(run, F.lit("}"))
        return F.when(state["found"], state).otherwise(
            F.struct(
                F.when(closing, state["closers"] + size)
                .otherwise(F.greatest(state["closers"] - opened, F.lit(0))).alias("closers"),
                F.when(~boxes, state["boxes"])
                .when(state["closers"] > 0, state["boxes"] + 1)
                .otherwise(state["boxes"] + opened).alias("boxes"),
                (boxes & (state["closers"] > 0)).alias("found"),
            )
        )

    def forth(state: Column, run: Column) -> Column:
        size = F.char_length(run)
        deeper = F.when(F.startswith(run, F.lit("}")), -size).otherwise(size)
        last = state["depth"] + deeper < 0
        return F.when(state["found"], state).otherwise(
            F.struct(
                (state["depth"] + deeper).alias("depth"),
                (state["closers"] + F.when(last, state["depth"] + 1)
                 .when(deeper < 0, size).otherwise(0)).alias("closers"),
                last.alias("found"),
            )
        )

    def start(*counters: str) -> Column:
        return F.struct(*[F.lit(0).alias(c) for c in counters], F.lit(False).alias("found"))

    def content(tail: Column) -> Column:
        braces = F.regexp_extract_all(tail, F.lit(r"\{++|\}++"), F.lit(0))
        return let(
            F.aggregate(braces, start("depth", "closers"), forth),
            lambda end: F.call_function("substring_index", tail, F.lit("}"), end["closers"]),
        )

    return let(
        F.aggregate(F.reverse(runs), start("closers", "boxes"), back),
        lambda opener: F.when(
            opener["found"],
            let(F.call_function("substring_index", text, F.lit(BOX), -opener["boxes"]), content),
        ),
    )


# Box content with up to three further levels of braces. The possessive loops match in
# linear time and without recursion.
_LEVEL = r"[^{}]++"
for _ in range(3):
    _LEVEL = rf"[^{{}}]++|\{{(?:{_LEVEL})*+\}}"
_NESTED = rf"^((?:{_LEVEL})*+)\}}"


def extract_boxed(text) -> Column:
    """STR-1. Content of the last balanced ``\\boxed{...}``, NULL without one.

    Nearly every text is answered by string functions on what follows the last opener:
    no box, a box without or with few levels of braces, or a single box that never
    closes. Only what remains reaches the brace-matching fold over the whole text.
    """
    text = as_col(text)
    tail = F.substring_index(text, BOX, -1)
    only_one = F.locate(BOX, text) + len(BOX) + F.char_length(tail) - 1 == F.char_length(text)
    return (
        F.when(~F.contains(text, F.lit(BOX)), F.lit(None).cast("string"))
        .when(tail.rlike(r"^[^{}]*\}"), F.substring_index(tail, "}", 1))
        .when(~F.contains(tail, F.lit("}")) & only_one, F.lit(None).cast("string"))
        .when(tail.rlike(_NESTED), F.regexp_extract(tail, _NESTED, 1))
        .otherwise(_last_balanced_box(text))
    )


def count_boxed(text) -> Column:
    """STR-2. Number of ``\\boxed{`` openers."""
    text = as_col(text)
    without = F.replace(text, F.lit(BOX), F.lit(""))
    return ((F.char_length(text) - F.char_length(without)) / len(BOX)).cast("int")


def last_number(text) -> Column:
    """STR-3. Last number in the text, NULL without one."""
    matches = F.regexp_extract_all(as_col(text), F.lit("(?U)" + NUMBER_PATTERN), F.lit(0))
    return F.try_element_at(matches, F.lit(-1))


def answer_candidate(text) -> Column:
    """STR-4. Boxed content (also when empty), else the last number, else NULL."""
    return F.coalesce(extract_boxed(text), last_number(text))


def strip(text) -> Column:
    """Drop leading and trailing white space, Unicode included."""
    return F.regexp_replace(
        as_col(text), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""
    )


def normalise_answer(value, strict: bool = True) -> Column:
    """STR-5. Answer text without formatting noise.

    With ``strict`` commas go before ``\\,`` (so ``1\\,000`` becomes ``1\\000``);
    ``strict=False`` removes the thin space first and reads it as ``1000``.
    """
    noise = [",", "\\!", "\\,", "\\%"] if strict else ["\\!", "\\,", "\\%", ","]
    cleaned = F.btrim(strip(value), F.lit("$"))
    for part in [" ", *noise]:
        cleaned = F.replace(cleaned, F.lit(part), F.lit(""))
    cleaned = F.rtrim(cleaned, F.lit("."))
    return F.when(
        F.startswith(cleaned, F.lit("\\text{")) & F.endswith(cleaned, F.lit("}")),
        F.substr(cleaned, F.lit(7), F.char_length(cleaned) - 7),
    ).otherwise(cleaned)


def first_clipped_ratio(log_text) -> Column:
    """STR-13. First logged clipped ratio of a training log, NULL without one."""
    found = F.regexp_extract(as_col(log_text), CLIPPED_RATIO_PATTERN, 1)
    return found.try_cast("double")
