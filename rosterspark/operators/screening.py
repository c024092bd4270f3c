"""Fuzzy name screening of many queries against all records: block, score, corroborate, rank, explain.

Scores of words are computed once per distinct pair of words, at the level of the two vocabularies;
record pairs then only join those scores. Names are exploded after candidates are known, so the best
alias of a record is always found.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.functions import namepairs, similarity, wordpairs
from rosterspark.functions.country import COUNTRY_MATCH, country_points, country_status
from rosterspark.functions.fields import exact_key, matches_birth
from rosterspark.functions.text import normalize_text, soundex_code, transliterate, words
from rosterspark.session import checkpointed

# Fixed values of a search.
THRESHOLD, LIMIT, MOST_LIMIT, BIRTH_POINTS, LEAST_ID = 65, 20, 100, 10, 4
PORTFOLIO_THRESHOLD = 70

#: How candidates are found: ``lossless`` (no match the scorer accepts is missed), ``reference`` (the nine key classes), ``exhaustive``.
MODES = ("lossless", "reference", "exhaustive")


@dataclass(frozen=True)
class Options:
    """Options of a search, as given; ``clean`` puts them in range."""

    source: str | None = None
    type: str | None = None
    limit: float | None = LIMIT
    threshold: float | None = THRESHOLD
    include_delisted: bool = False
    suppress_false_positives: bool = False
    mode: str = "lossless"

    def clean(self) -> Options:
        limit, threshold = self.limit, self.threshold
        bad = limit is None or limit != limit or limit < 0
        limit = LIMIT if bad else min(int(limit), MOST_LIMIT)
        threshold = THRESHOLD if threshold is None or threshold != threshold else min(max(threshold, 0), 100)
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        return Options(self.source, self.type, limit, threshold, self.include_delisted, self.suppress_false_positives, "exhaustive" if threshold == 0 else self.mode)


def name_groups(names: DataFrame, key: str, text: str = "name") -> DataFrame:
    """(key, ci, name, norm, gi, t): each word of each name with its forms (as written, and in Latin letters), and where it stands."""
    n = names.withColumn("norm", normalize_text(F.col(text)))
    latin = words(normalize_text(transliterate(F.col(text))))
    spread = n.select(key, "ci", F.col(text).alias("name"), "norm", F.posexplode(words(F.col("norm"))).alias("gi", "w"), latin.alias("l"))
    forms = F.array_distinct(F.array_compact(F.array("w", F.get("l", F.col("gi")))))
    return spread.select(key, "ci", "name", "norm", "gi", F.col("w").alias("first"), F.posexplode(forms).alias("fi", "t"))


def reference_keys(t: Column, query: bool) -> Column:
    """The nine key classes of a word; the single-letter class is asked only by one-letter queries."""
    n = F.length(t)
    grams = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.concat(F.lit(f"ng{k}:"), F.substring(t, i, F.lit(k))))
    none = F.array().cast("array<string>")
    key = lambda name, c, cond: F.when(cond, F.array(F.concat(F.lit(name + ":"), c))).otherwise(none)
    s = soundex_code(t)
    return F.array_distinct(F.concat(
        key("w", t, F.lit(True)), key("p2", F.substring(t, 1, 2), n >= 2), key("p3", F.substring(t, 1, 3), n >= 3),
        F.when(n >= 4, grams(3)).otherwise(none), F.when(n > 6, grams(2)).otherwise(none), key("sx", s, s != ""), key("sxd", F.substring(s, 2, 3), (s != "") & (n <= 3)),
        key("p1", F.substring(t, 1, 1), (n == 1) if query else F.lit(True)),
    ))


def word_scores(query_words: DataFrame, record_words: DataFrame, mode: str) -> DataFrame:
    """(qt, rt, s) with s > 0 of distinct words: (t) against (t). Every word meets every other in ``wordpairs``; ``reference`` keeps pairs that share a key."""

    def distinct(words: DataFrame) -> DataFrame:
        # written down, so that facts are worked out once a word
        return checkpointed(words.where("t is not null").select("t").distinct().select("t", *wordpairs.facts(F.col("t"))))

    q, r = distinct(query_words), distinct(record_words)
    scores = wordpairs.scored(q, r)
    return scores.where(F.arrays_overlap(reference_keys(F.col("qt"), True), reference_keys(F.col("rt"), False))) if mode == "reference" else scores


def forms_of(w: str, l: str, more: Callable[[Column], list[Column]] = lambda t: []) -> Column:
    """(i, t, bits, sound, more...) of the words in column ``w`` as written and, where they differ, as in ``l``, in Latin letters."""
    facts = lambda t: [t.alias("t"), *wordpairs.facts(t), *more(t)]
    return F.flatten(F.transform(w, lambda x, i: F.transform(F.array_distinct(F.array_compact(F.array(x, F.get(l, i)))), lambda t: F.struct(i.alias("i"), *facts(t)))))


def distinct_names(names: DataFrame, key: list[str], text: str = "name", keys: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(of: key..., text, id) and (words: id, norm, weights, forms): names of equal words are one.

    ``forms``: (i, t, bits, sound) of each word as written and, where it differs, in Latin letters, with hashed ``keys`` if asked for; ``weights`` of the words in order.
    """
    latin = normalize_text(transliterate(F.col(text)))
    # texts are normalised once: what follows asks for them many times
    of = checkpointed(names.select(*key, text, normalize_text(F.col(text)).alias("norm"), latin.alias("latin")).where("norm <> ''").withColumn("id", F.xxhash64("norm", "latin")))
    one = of.groupBy("id").agg(F.first("norm").alias("norm"), F.first("latin").alias("latin"))
    w = one.select("id", "norm", words(F.col("norm")).alias("w"), words(F.col("latin")).alias("l"))
    more = lambda t: [F.transform(keys(t), lambda x: F.xxhash64(x)).alias("keys")] if keys else []
    full = w.select("id", "norm", F.transform("w", similarity.word_weight).alias("weights"), forms_of("w", "l", more).alias("forms"))
    return of.select(*key, text, "id"), checkpointed(full)


def name_scores(queries: DataFrame, names: DataFrame, mode: str = "lossless", least: int = 1) -> DataFrame:
    """(q_id, record_id, score, matched_name, ci): the best name of each record for each query, with score of at least ``least``.

    ``queries``: q_id, name; ``names``: record_id, ci (place, 0 first), name. Ties go to the earlier name, then the name.
    Equal names are compared once, by ``namepairs``; every mode but ``reference`` finds all that score.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    of_key = {side: (lambda t, query=query: reference_keys(t, query)) if mode == "reference" else None for side, query in (("q", True), ("r", False))}
    of_q, q = distinct_names(queries, ["q_id"], keys=of_key["q"])
    of_r, r = distinct_names(names, ["record_id", "ci"], keys=of_key["r"])
    scored = namepairs.scored(q, r, max(least, 1))
    at = of_r.select("record_id", "ci", F.col("name").alias("matched_name"), F.col("id").alias("rid"))
    rows = scored.join(at, "rid").join(of_q.select("q_id", F.col("id").alias("qid")), "qid")
    best = rows.groupBy("q_id", "record_id").agg(F.max_by(F.struct("score", "matched_name", "ci"), F.struct("score", -F.col("ci"), "matched_name")).alias("b"))
    return best.select("q_id", "record_id", "b.score", "b.matched_name", "b.ci")


def keep_records(records: DataFrame, o: Options) -> DataFrame:
    """Records a search looks at: active unless delisted ones are asked for, of given sources (a list with commas) and type."""
    out = records if o.include_delisted else records.where(F.coalesce("status", F.lit("active")) != "delisted")
    if o.source:
        out = out.where(F.col("source").isin([s.strip().upper() for s in o.source.split(",") if s.strip()]))
    return out.where(F.col("type") == o.type.lower()) if o.type else out


def id_hits(queries: DataFrame, numbers: DataFrame) -> DataFrame:
    """(q_id, record_id) where the query is a number of the record; shorter ones than four are none. ``numbers``: record_id, number."""
    q = queries.select("q_id", exact_key(F.col("name")).alias("k")).where(F.length("k") >= LEAST_ID)
    return q.join(numbers.select("record_id", exact_key(F.col("number")).alias("k")).where(F.length("k") >= LEAST_ID), "k").select("q_id", "record_id").distinct()


def screen(queries: DataFrame, records: DataFrame, names: DataFrame, options: Options = Options(), numbers: DataFrame | None = None) -> DataFrame:
    """All hits of all queries: (q_id, record_id, score, name_score, matched_name, id_hit, country_status, birth_match).

    ``queries``: q_id, name, dob, country (code); ``records``: record_id, source, type, status, birth_dates, countries (codes);
    ``names``: record_id, ci, name. A number hit scores 100 whatever else. Blank queries have no hits.
    """
    o = options.clean()
    asked = queries.where(F.trim(F.coalesce("name", F.lit(""))) != "")
    kept = keep_records(records, o)
    # what birth and country add at most needs no better a name
    least = max(1, math.ceil(o.threshold - BIRTH_POINTS - COUNTRY_MATCH))
    scored = name_scores(asked.select("q_id", "name"), names.join(kept.select("record_id"), "record_id", "left_semi"), o.mode, least)
    if o.threshold == 0:
        # the stated search for everything: each query against each record, also with score 0
        every = asked.select("q_id").join(kept.select("record_id"), F.col("q_id").isNotNull() & F.col("record_id").isNotNull())
        scored = every.join(scored, ["q_id", "record_id"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    hits = id_hits(asked, numbers.join(kept.select("record_id"), "record_id", "left_semi")) if numbers is not None else None
    if hits is not None:
        scored = scored.join(hits, ["q_id", "record_id"], "left_anti")
    full = scored.join(asked.select("q_id", "dob", "country"), "q_id").join(kept.select("record_id", "birth_dates", "countries"), "record_id")
    status = country_status(F.col("country"), F.col("countries"))
    born = F.coalesce((F.coalesce("dob", F.lit("")) != "") & matches_birth(F.col("birth_dates"), F.col("dob")), F.lit(False))
    final = F.least(F.lit(100), F.greatest(F.lit(0), F.col("score") + F.when(born, BIRTH_POINTS).otherwise(0) + country_points(status)))
    out = full.select("q_id", "record_id", final.cast("int").alias("score"), F.col("score").alias("name_score"), "matched_name", F.lit(False).alias("id_hit"), status.alias("country_status"), born.alias("birth_match")).where(F.col("score") >= o.threshold)
    if hits is not None:
        sure = hits.select("q_id", "record_id", F.lit(100).alias("score"), F.lit(100).alias("name_score"), F.lit("Passport/ID match").alias("matched_name"), F.lit(True).alias("id_hit"), F.lit("no_query").alias("country_status"), F.lit(False).alias("birth_match"))
        out = out.unionByName(sure)
    return out


def ranked(hits: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` hits of each query with ``rank``, ``total_matches`` and ``truncated``; ties: number hits first, then the id."""
    w = Window.partitionBy("q_id")
    order = w.orderBy(F.desc("score"), F.desc("id_hit"), "record_id")
    return hits.withColumn("rank", F.row_number().over(order)).withColumn("total_matches", F.count("*").over(w).cast("int")).withColumn("truncated", F.col("total_matches") > limit).where(F.col("rank") <= limit)


def with_decisions(hits: DataFrame, decisions: DataFrame, suppress: bool = False) -> DataFrame:
    """``hits`` (with subject_id) with the subject's decision on the record; a valid false positive is cleared, and dropped if ``suppress``.

    ``decisions``: record_id, subject_id, verdict, validity.
    """
    d = decisions.select("record_id", "subject_id", "verdict", "validity")
    out = hits.join(d, ["record_id", "subject_id"], "left").withColumn("auto_cleared", F.coalesce(F.col("validity") == "valid", F.lit(False)))
    return out.where(~F.col("auto_cleared")) if suppress else out


def explain(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Per returned hit, its words: (q_id, record_id, query_word, record_word, word_score, particle); unmatched words of either side alone.

    Made for the few rows that are shown, after ranking.
    """
    shown = hits.where("not id_hit").select("q_id", "record_id", F.col("matched_name").alias("name"))

    def spelled(names: DataFrame, side: str) -> DataFrame:
        w = names.withColumns({side + "w": words(normalize_text(F.col("name"))), "l": words(normalize_text(transliterate(F.col("name"))))})
        return w.withColumn(side + "f", forms_of(side + "w", "l")).drop("name", "l")

    both = spelled(queries.select("q_id", "name"), "q").join(spelled(shown, "r"), "q_id").select("q_id", "record_id", "qw", "qf", "rw", "rf")
    kind = shown.select("q_id", "record_id").schema.add("query_word", "string").add("record_word", "string").add("word_score", "double")
    rows = both.mapInArrow(namepairs.explained, kind)
    return rows.select("q_id", "record_id", "query_word", "record_word", F.round("word_score", 6).alias("word_score"), (similarity.word_weight(F.coalesce("query_word", "record_word")) < 1).alias("particle"))
