"""Secret scans with DataFrame functions: fixed patterns plus a character Markov model.

Two bigram models, one of random strings and one of ordinary identifiers, are
counted from labelled samples with groupBy; their log-likelihood ratio by pair of
characters (a table of fixed size) is a literal of the plan. Long tokens whose
ratio favours "random" are spans beside those of the patterns.

A match's place comes from the pieces between matches: split() and
regexp_extract_all() see the same matches, so running lengths give code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

#: The base patterns, in order, with the group that is measured and its least length.
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: Runs that the scans list: from where a run begins, as what is shorter has no match inside. The hex pattern's measured ones
#: lie in runs that the Markov models judge, so these are looked for first.
_HEX_LONG = r"(?<![0-9a-f])[0-9a-f]{32,}"
#: What a text with an assignment holds in lower case.
_KEYS = ("passw", "secret", "token", "api_key", "apikey")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: Tokens that the Markov models judge.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: Least sum of log-likelihood ratios, in nats, of a token that is taken for random.
LEAST_RATIO = 12.0
#: Documents that labelled samples are taken from, and rule-made random strings beside them.
SAMPLE_DOCS, SAMPLE_RANDOM = 300, 3000
#: Lengths that are added up together, so that places in a text of many matches don't cost their square.
RUN = 64


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once, not wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(values: Column, first: Column, count: Column) -> Column:
    """Of `count` values from place `first` (from 0)."""
    return F.aggregate(F.slice(values, first + 1, count), F.lit(0), lambda acc, x: acc + x)


def _spans(text: Column, pattern: str, found: Column, measured: Column, least: int) -> Column:
    """array<struct<start,end,value>> of the matches whose measured group has the least length; null where nothing is found.

    Steps from one match's end to the next one's are added up by runs of RUN and then within a run.
    """
    size = F.size(found)
    runs = F.sequence(F.lit(0), F.floor((size - 1) / RUN).cast("int"))

    def placed(gaps: Column, matches: Column, groups: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))

        def one(ends: Column, before: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                run = F.floor(i / RUN).cast("int")
                end = F.get(before, run) + _sum(ends, run * RUN, i - run * RUN + 1)
                return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("value"), F.length(F.get(groups, i)).alias("measure"))

            return F.transform(matches, span)

        return _let(steps, lambda s: _let(F.transform(runs, lambda k: _sum(s, k * RUN, F.lit(RUN))), lambda sums: _let(F.transform(runs, lambda k: _sum(sums, F.lit(0), k)), lambda before: one(s, before))))

    all_of = _let(F.split(text, pattern, -1), lambda gaps: _let(found, lambda matches: _let(measured, lambda groups: placed(gaps, matches, groups))))
    kept = F.transform(F.filter(all_of, lambda s: s["measure"] >= least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return F.when(size > 0, kept)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text ('' for null), for each pattern its spans, and `long`, those of CANDIDATE (null: none).

    Plain words are looked for before a pattern is, and a pattern's matches are listed once.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text, none = F.col("text"), F.array().cast("array<string>")
    low = F.lower(text)
    keyed = low.contains(_KEYS[0])
    for key in _KEYS[1:]:
        keyed |= low.contains(key)
    pattern, group, least = PATTERNS["assign"]
    rows = rows.withColumns({"long_found": _all(text, CANDIDATE), "assign_found": F.when(keyed, _all(text, pattern)).otherwise(none), "access_found": F.when(text.contains("AKIA"), _all(text, PATTERNS["access"][0])).otherwise(none)})
    rows = rows.withColumn("hex_found", F.when(F.size("long_found") > 0, _all(text, _HEX_LONG)).otherwise(none))
    spans = {"assign": _spans(text, pattern, F.col("assign_found"), _all(text, pattern, group), least), "long": _spans(text, CANDIDATE, F.col("long_found"), F.col("long_found"), 0)}
    for kind, scan in (("access", PATTERNS["access"][0]), ("hex", _HEX_LONG)):
        spans[kind] = _spans(text, scan, F.col(f"{kind}_found"), F.col(f"{kind}_found"), PATTERNS[kind][2])
    return rows.select("doc_id", "text", *(spans[k].alias(k) for k in (*PATTERNS, "long")))


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_random: int = SAMPLE_RANDOM) -> DataFrame:
    """token, random: values that the patterns name as secrets and rule-made strings are random; identifiers joined
    from a document's distinct pairs of neighbouring words are not. At most sample_docs documents are used,
    those of the least hash of doc_id."""
    spark = docs.sparkSession
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    # written, as filters on spans would else be made of all documents, before the join
    rows = written(docs.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select("doc_id", "text"), "secret-documents")
    found = base_spans(rows)
    secret = found.select(F.explode(F.concat(*(F.coalesce(F.transform(k, lambda s: s["value"]), F.array().cast("array<string>")) for k in ("access", "hex")), F.coalesce(F.transform("assign", lambda s: F.regexp_extract(s["value"], r"([A-Za-z0-9+/_.=-]+)$", 1)), F.array().cast("array<string>")))).alias("token"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = spark.range(sample_random).select(F.explode(F.array(F.substring(digest, 1, 40), F.translate(F.substring(F.base64(F.unhex(digest)), 1, 40), "=", ""), F.substring(F.upper(F.base64(F.unhex(digest))), 1, 24))).alias("token"))
    words = found.filter("assign IS NULL AND access IS NULL AND hex IS NULL").select(_all(F.col("text"), "[A-Za-z]{4,}").alias("w"))
    beside = F.zip_with(F.expr("slice(w, 1, greatest(size(w) - 1, 0))"), F.expr("slice(w, 2, size(w))"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = words.select(F.explode(F.array_distinct(beside)).alias("pair")).select("pair.a", "pair.b")
    plain = pairs.filter("a IS NOT NULL AND b IS NOT NULL").select(F.explode(F.array(F.concat("a", "b"), F.concat_ws("_", "a", "b"), F.concat("a", F.initcap("b")), F.concat_ws("-", "a", "b"), F.concat_ws("/", "a", "b"), F.upper(F.concat_ws("_", "a", "b")))).alias("token"))
    return secret.unionAll(made).withColumn("random", F.lit(True)).unionAll(plain.withColumn("random", F.lit(False)))


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def ratios(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each pair of characters, of (len(ALPHABET) + 1) squared.

    Without samples of either kind all ratios are 0, and nothing is taken for random.
    """
    n = len(ALPHABET) + 1
    pair = samples.select("random", _codes(F.col("token")).alias("c")).select("random", F.explode(F.zip_with(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), F.slice("c", 2, F.greatest(F.size("c"), F.lit(1))), lambda a, b: a * n + b)).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pair.filter("pair IS NOT NULL").groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}  # at most 2 n^2 rows
    first = {(kind, a): sum(counts.get((kind, a * n + b), 0) for b in range(n)) for kind in (True, False) for a in range(n)}
    if not all(any(k[0] == kind for k in counts) for kind in (True, False)):
        return [0.0] * (n * n)
    chance = lambda kind, a, b: (counts.get((kind, a * n + b), 0) + 0.1) / (first[kind, a] + 0.1 * n)
    return [math.log(chance(True, a, b) / chance(False, a, b)) for a in range(n) for b in range(n)]


def scan(docs: DataFrame, table: list[float], least_ratio: float = LEAST_RATIO) -> DataFrame:
    """doc_id and array columns assign, access, hex, markov of struct(start, end, value), per row of docs.

    Places are code points, ends exclusive. Null text counts as empty; an empty text has no span; no rows give no rows.
    A Markov span that overlaps a base span isn't given, as the base one covers it.
    """
    n = len(ALPHABET) + 1
    weights = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast(T.ArrayType(T.DoubleType()))
    rows = base_spans(docs)

    def ratio(token: Column) -> Column:
        zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
        return F.aggregate(_codes(token), zero, lambda acc, c: F.struct(c.alias("last"), F.when(acc["last"] < 0, acc["sum"]).otherwise(acc["sum"] + F.get(weights, acc["last"] * n + c)).alias("sum")), lambda acc: acc["sum"])

    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    rows = rows.withColumn("base", F.concat(*(F.coalesce(k, none) for k in PATTERNS)))
    markov = F.when(F.col("long").isNotNull(), F.filter(_free(F.col("base"), F.col("long")), lambda s: ratio(s["value"]) >= least_ratio))
    return rows.select("doc_id", *(F.coalesce(k, none).alias(k) for k in PATTERNS), F.coalesce(markov, none).alias("markov"))


def _free(base: Column, tokens: Column) -> Column:
    """The tokens (struct of start, end, value, in order, apart from each other) that no base span overlaps.

    Both stand in one list by start, base spans first. A token is overlapped by a span before it if the largest end so far
    lies beyond its start, and by one after it only if its next neighbour is one. Largest ends are taken by runs of
    RUN and within a run, so the cost isn't the square of the matches.
    """
    marked = lambda spans, late: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(late).alias("late"), s["end"].alias("end"), s["value"].alias("value")))
    largest = lambda values, first, count, of: F.aggregate(F.slice(values, first + 1, count), F.lit(0), lambda acc, x: F.greatest(acc, of(x)))
    end = lambda x: F.when(x["late"] == 0, x["end"]).otherwise(0)

    def kept(events: Column, before: Column) -> Column:
        def free(x: Column, i: Column) -> Column:
            run, after = F.floor(i / RUN).cast("int"), F.get(events, i + 1)
            earlier = F.greatest(F.get(before, run), largest(events, run * RUN, i - run * RUN, end))
            return (x["late"] == 1) & (earlier <= x["start"]) & ~F.coalesce((after["late"] == 0) & (after["start"] < x["end"]), F.lit(False))

        return F.transform(F.filter(events, free), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    def by_runs(events: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(events) - 1) / RUN).cast("int"))
        tops = F.transform(runs, lambda k: largest(events, k * RUN, F.lit(RUN), end))
        return _let(tops, lambda t: _let(F.transform(runs, lambda k: largest(t, F.lit(0), k, lambda x: x)), lambda before: kept(events, before)))

    both = _let(F.array_sort(F.concat(marked(base, 0), marked(tokens, 1))), by_runs)
    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(both)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts, SHA-256 of the base spans and all spans as kind:start:end, by start and then kind."""

    def listed(kinds: list[str]) -> Column:
        def said(i: int, kind: str) -> Column:
            return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("order"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("said")))

        each = [said(i, kind) for i, kind in enumerate(kinds)]
        return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda s: s["said"]), ",")

    kinds = list(PATTERNS)
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in kinds), F.sha2(listed(kinds).cast("binary"), 256).alias("base_sha256"), listed([*kinds, "markov"]).alias("spans"), F.size("markov").cast("long").alias("n_markov"))


def trained(docs: DataFrame) -> list[float]:
    """The table of ratios from the labelled samples of docs."""
    return ratios(written(labelled_samples(docs), "secret-samples"))
