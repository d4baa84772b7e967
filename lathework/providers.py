"""External models behind an interface: a registry, a stub, enrichment with retries, a judge.

A provider is a callable from a list of (prompt, image path) to a list of replies; it may raise for a batch.
It is looked up and built once in each Python worker. Rows never fail a task: each has a value or an error.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .functions.normalize import is_judge_score, judge_score
from .functions.prompts import judge_prompt
from .functions.text import blank

Provider = Callable[[list[tuple[str, str | None]]], list[str]]
_makers: dict[str, Callable[[], Provider]] = {}


def register(name: str, make: Callable[[], Provider]) -> None:
    """make() builds the provider when a worker first needs it."""
    _makers[name.lower()] = make


def maker(name: str) -> Callable[[], Provider]:
    """By name without regard to case; ValueError for an unknown one."""
    try:
        return _makers[name.lower()]
    except KeyError:
        raise ValueError(f"no model named {name!r}; there are {sorted(_makers)}") from None


def stub() -> Provider:
    """Replies that only depend on the prompt: its MD5."""
    return lambda asked: [hashlib.md5(p.encode()).hexdigest() for p, _ in asked]


def stub_judge() -> Provider:
    """Scores from 0 to 10 that only depend on the prompt."""
    return lambda asked: [str(int(hashlib.md5(p.encode()).hexdigest()[:6], 16) % 11) for p, _ in asked]


def _refusing(replies: list[str]) -> list[str]:
    if any(x < "4" for x in replies):
        raise ValueError("refused")
    return replies


def stub_refusing() -> Provider:
    """The stub's replies, but a failure for each prompt whose MD5 starts with 0 to 3."""
    return lambda asked: _refusing(stub()(asked))


def stub_seeing() -> Provider:
    """Replies that depend on prompt and image: the MD5 of both."""
    return lambda asked: [hashlib.md5(f"{p}|{image or ''}".encode()).hexdigest() for p, image in asked]


def stub_seeing_refusing() -> Provider:
    """Those replies, but a failure for each whose MD5 starts with 0 to 3."""
    return lambda asked: _refusing(stub_seeing()(asked))


register("stub", stub)
register("stub-seeing", stub_seeing)
register("stub-seeing-refusing", stub_seeing_refusing)
register("stub-refusing", stub_refusing)
register("stub-judge", stub_judge)


#: Prompts that go to a provider in one call.
BATCH = 16


def _in_halves(model: Provider, asked: list[tuple[str, str | None]]) -> list[tuple[str | None, Exception | None]]:
    """A reply or a failure for each; a call that fails is made again for each half, so one bad prompt of n costs about
    2 log n calls and the others keep their replies."""
    try:
        replies = list(model(asked))
        if len(replies) == len(asked):
            return [(r, None) for r in replies]
        failure: Exception = ValueError(f"{len(replies)} replies to {len(asked)} prompts")
    except Exception as e:  # any model's failure is a row's error
        failure = e
    if len(asked) == 1:
        return [(None, failure)]
    half = len(asked) // 2
    return _in_halves(model, asked[:half]) + _in_halves(model, asked[half:])


def asked_all(model: Provider, asked: list[tuple[str | None, str | None]], attempts: int = 3, wait: float = 0.0, accept: Callable[[str], bool] | None = None, batch: int = BATCH) -> list[tuple[str | None, str | None]]:
    """(reply, error) of each (prompt, image), asked until a reply is accepted; both None for no prompt.

    Prompts of like lengths go together in calls of `batch`. Between attempts it waits only where a call failed, not where a
    reply couldn't be used.
    """
    out: list[tuple[str | None, str | None]] = [(None, None)] * len(asked)
    left = [i for i, (p, _) in enumerate(asked) if isinstance(p, str)]
    for k in range(attempts):
        left.sort(key=lambda i: len(asked[i][0]))
        again, broke = [], False
        for low in range(0, len(left), batch):
            part = left[low : low + batch]
            for i, (value, failure) in zip(part, _in_halves(model, [asked[i] for i in part]), strict=True):
                try:
                    good = failure is None and (accept is None or accept(value))
                except Exception as e:
                    good, failure = False, e
                if good:
                    out[i] = (value, None)
                    continue
                broke |= failure is not None
                out[i] = (None, "reply not accepted" if failure is None else f"{type(failure).__name__}: {failure}")
                again.append(i)
        left = again
        if not left:
            break
        if wait and broke and k + 1 < attempts:
            time.sleep(wait)
    return out


def answered(df: DataFrame, make: Callable[[], Provider], prompt: str, reply: str = "reply", image: str | None = None, attempts: int = 3, wait: float = 0.0, accept: Callable[[str], bool] | None = None) -> DataFrame:
    """df with `reply` and `reply_error`. A failed call, or a reply that isn't accepted, is tried again, alone where need be;
    a null prompt isn't sent. Filter rows before this; when() would not keep a row from the model."""
    schema = StructType([*df.schema.fields, StructField(reply, StringType()), StructField(f"{reply}_error", StringType())])

    def work(batches):
        model = make()
        for pdf in batches:
            images = pdf[image].tolist() if image else [None] * len(pdf)
            told = asked_all(model, list(zip(pdf[prompt].tolist(), images, strict=True)), attempts, wait, accept)
            yield pdf.assign(**{reply: pd.Series([x for x, _ in told], dtype="object", index=pdf.index), f"{reply}_error": pd.Series([e for _, e in told], dtype="object", index=pdf.index)})

    return df.mapInPandas(work, schema)


def answered_each(df: DataFrame, make: Callable[[], Provider], prompts: str, replies: str = "replies", image: str | None = None, attempts: int = 3, wait: float = 0.0) -> DataFrame:
    """df with `replies` and `<replies>_errors`, arrays beside the array of prompts: each prompt of a row is asked by itself,
    a null one not at all. A row's prompts are asked within its task; nothing is shuffled."""
    many = ArrayType(StringType())
    schema = StructType([*df.schema.fields, StructField(replies, many), StructField(f"{replies}_errors", many)])

    def work(batches):
        model = make()
        for pdf in batches:
            images = pdf[image].tolist() if image else [None] * len(pdf)
            rows = pdf[prompts].tolist()
            each = iter(asked_all(model, [(p, i) for row, i in zip(rows, images, strict=True) for p in row], attempts, wait))
            told = [[next(each) for _ in row] for row in rows]
            yield pdf.assign(**{replies: pd.Series([[x for x, _ in row] for row in told], dtype="object", index=pdf.index), f"{replies}_errors": pd.Series([[e for _, e in row] for row in told], dtype="object", index=pdf.index)})

    return df.mapInPandas(work, schema)


def prediction_text(df: DataFrame, reply: str = "reply", out: str = "prediction", error_as_text: bool = False) -> DataFrame:
    """The reply as a prediction; with error_as_text a failed row's prediction is its error in brackets, else null."""
    failed = F.concat(F.lit("[ERROR: "), F.col(f"{reply}_error"), F.lit("]")) if error_as_text else F.lit(None).cast("string")
    return df.withColumn(out, F.when(F.col(f"{reply}_error").isNull(), F.col(reply)).otherwise(failed))


def judged(long: DataFrame, make: Callable[[], Provider], attempts: int = 3, wait: float = 0.0) -> DataFrame:
    """long (question_type, question, reference, response) with score: 0 to 10, or null.

    Only rows with a response that isn't blank and a reference that isn't empty are sent. A reply without a
    number is asked for again, as a failed call is.
    """
    ask = ~blank(F.col("response")) & (F.coalesce(F.col("reference"), F.lit("")) != "")
    prompt = F.when(ask, judge_prompt(F.col("question_type"), F.coalesce("question", F.lit("")), F.col("reference"), F.col("response")))
    sent = answered(long.withColumn("_prompt", prompt), make, "_prompt", "_judge", attempts=attempts, wait=wait, accept=is_judge_score)
    return sent.withColumn("score", judge_score(F.col("_judge"))).drop("_prompt", "_judge", "_judge_error")


def translated(rows: DataFrame, fields: list[str], make: Callable[[], Provider], language: str, attempts: int = 3, wait: float = 0.0) -> DataFrame:
    """rows with their fields translated, each by itself; a blank field stays, a failed one keeps the original.

    failed_fields lists those that failed, errors `field - error` of each, for an error log. A row's fields go
    to the model within its task, a failed one again after `wait` seconds; nothing is shuffled.
    """
    many = ArrayType(StringType())
    schema = StructType([*rows.schema.fields, StructField("failed_fields", many), StructField("errors", many)])

    def work(batches):
        model = make()
        for pdf in batches:
            failed, errors = ([[] for _ in range(len(pdf))] for _ in range(2))
            values = {f: pdf[f].tolist() for f in fields}
            places = [(f, i) for f in fields for i, v in enumerate(values[f]) if isinstance(v, str) and v.strip()]
            told = asked_all(model, [(f"Translate to {language}: {values[f][i]}", None) for f, i in places], attempts, wait)
            for (f, i), (said, error) in zip(places, told, strict=True):
                if error is None:
                    values[f][i] = said.strip()
                else:  # the field keeps its text
                    failed[i].append(f)
                    errors[i].append(f"{f} - {error}")
            pdf = pdf.assign(**{f: pd.Series(v, dtype="object", index=pdf.index) for f, v in values.items()})
            yield pdf.assign(failed_fields=pd.Series(failed, index=pdf.index), errors=pd.Series(errors, index=pdf.index))

    return rows.mapInPandas(work, schema)


def sections(boxes: DataFrame, key: str, order: str, make: Callable[[], Provider], image: str = "image_path") -> DataFrame:
    """Text of each page from its boxes: each box's reply, those not blank a line each, <br> as a newline."""
    read = answered(boxes.withColumn("_p", F.lit("Read the text of this section.")), make, "_p", "_text", image)
    kept = read.filter(~blank(F.col("_text")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("_text").alias("text")))), lambda s: s["text"]), "\n")
    return kept.groupBy(key).agg(F.regexp_replace(listed, "(?i)<br */?>", "\n").alias("text"))
