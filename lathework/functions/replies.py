"""Models' replies as columns: lenient JSON, nested fields, lines with prefixes. Native."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, unfenced

_PAIR = "struct<question:string,answer:string>"
_SCHEMA = f"struct<short_questions:array<{_PAIR}>,multiple_choice_questions:array<struct<question:string,answer:string,options:string>>,true_false_question:{_PAIR},long_question:{_PAIR}>"
OPTIONS = 4
#: The columns that a reply gives.
REPLY_FIELDS = ("short_q1", "short_a1", "short_q2", "short_a2", "mc_q1", "mc_a1", *(f"mc_opt1_{i + 1}" for i in range(OPTIONS)), "true_false_q", "true_false_a", "long_q", "long_a")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parsed(reply: Column) -> Column:
    """The JSON of a reply, in a fence or not; null where it is none."""
    return _once(_once(reply, unfenced), lambda text: F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, _SCHEMA)))


def is_questions(reply: str) -> bool:
    """Whether a reply is a JSON object with something in it, in a fence or not; for a worker that may ask again."""
    text = reply.removeprefix("```json") if reply.startswith("```json") else reply.removeprefix("```")
    try:
        made = json.loads(text.removesuffix("```").strip())
    except ValueError:
        return False
    return isinstance(made, dict) and bool(made)


def is_pair(reply: str, question: str = "Adversarial Question:", answer: str = "Answer:") -> bool:
    """Whether line_fields() finds both lines in a reply."""
    lines = reply.strip().split("\n")
    return all(any(x.startswith(p) for x in lines) and [x for x in lines if x.startswith(p)][-1].replace(p, "").strip() for p in (question, answer))


def option_list(options: Column) -> Column:
    """Four options from a JSON list or object (values in their order), padded with '' or cut."""
    listed = F.coalesce(F.when(F.ltrim(options).startswith("{"), F.map_values(F.from_json(options, "map<string,string>"))).otherwise(F.from_json(options, "array<string>")), F.array().cast("array<string>"))
    return F.slice(F.concat(listed, F.array_repeat(F.lit(""), OPTIONS)), 1, OPTIONS)


def qa_fields(reply: Column) -> dict[str, Column]:
    """The question and answer columns of a reply; '' where a field is missing, null where the reply is no JSON.

    All are fields of one struct, made from a reply that is parsed once, so that Spark shares the work between them.
    """

    def fields(p: Column) -> Column:
        field = lambda c: F.when(p.isNotNull(), F.coalesce(c, F.lit("")))
        short, choice = p["short_questions"], F.get(p["multiple_choice_questions"], F.lit(0))
        options = option_list(choice["options"])
        out = {}
        for i in (1, 2):
            out[f"short_q{i}"], out[f"short_a{i}"] = (field(F.get(short, F.lit(i - 1))[k]) for k in ("question", "answer"))
        out["mc_q1"], out["mc_a1"] = field(choice["question"]), field(choice["answer"])
        for i in range(OPTIONS):
            out[f"mc_opt1_{i + 1}"] = field(F.get(options, F.lit(i)))
        for name, q, a in (("true_false_question", "true_false_q", "true_false_a"), ("long_question", "long_q", "long_a")):
            out[q], out[a] = field(p[name]["question"]), field(p[name]["answer"])
        return F.struct(*(c.alias(k) for k, c in out.items()))

    made = _once(parsed(reply), fields)
    return {k: made[k] for k in REPLY_FIELDS}


def line_fields(reply: Column, question: str = "Adversarial Question:", answer: str = "Answer:") -> Column:
    """Struct question, answer from the last line of each prefix; both null unless both are there."""
    lines = F.split(strip(reply), "\n", -1)

    def last(prefix: str) -> Column:
        return strip(F.replace(F.try_element_at(F.filter(lines, lambda x: x.startswith(prefix)), F.lit(-1)), F.lit(prefix), F.lit("")))

    q, a = last(question), last(answer)
    both = (F.coalesce(q, F.lit("")) != "") & (F.coalesce(a, F.lit("")) != "")
    return F.struct(F.when(both, q).alias("question"), F.when(both, a).alias("answer"))
