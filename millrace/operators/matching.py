"""Matching operators: word-overlap ranking, match scores, rule banks, fragment search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.shared import saved

# The contract rule bank as (id, severity, pattern). \w is ASCII, as in the original rules, so it
# stands for no Cyrillic letter.
CONTRACT_RULES = [
    ("penalties", "Высокий", r"пен[яи]|штраф"),
    ("unlimited-liability", "Критический", r"неограниченн\w+\s+ответственност|в полном объ[её]ме убыт"),
    ("unilateral-scope", "Высокий", r"односторонн\w+.*измен.*объ[её]м|заказчик вправе измен"),
    ("acceptance", "Средний", r"по усмотрению заказчика|критери.*при[её]мк.*не определ"),
    ("payment-delay", "Высокий", r"(?:9[0-9]|[1-9][0-9]{2,})[\s ]*(?:(?:календарных|рабочих)[\s ]+)?дн(?:ей|я|ь)?"),
    ("free-extra-work", "Критический", r"дополнительн\w+ работ\w+ без.*оплат|без увеличения цен"),
    ("exclusive-rights", "Высокий", r"исключительн\w+ прав"),
    ("subcontract-ban", "Высокий", r"запрещ.*субподряд|без привлечения третьих лиц"),
    ("termination", "Высокий", r"односторонн\w+ отказ|возврат.*аванс"),
]


def rule_hits(df: DataFrame, id_col: str, text_col: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(id, rule, severity, match): the first match of every rule that matches. Texts that no rule matches, which are
    most, are read once for all rules."""
    df = df.where(F.col(text_col).rlike("(?iu)" + "|".join(f"(?:{p})" for _, _, p in rules)))
    found = [F.struct(F.lit(i).alias("rule"), F.lit(s).alias("severity"), F.regexp_extract(text_col, f"(?iu)(?:{p})", 0).alias("match")) for i, s, p in rules]
    hits = F.explode(F.filter(F.array(*found), lambda x: x["match"] != "")).alias("hit")
    return df.where(F.col(text_col).isNotNull()).select(id_col, hits).select(id_col, "hit.*")


def overlap_rank(needs: DataFrame, candidates: DataFrame, need_id: str, need_words: Column, candidate_id: str, candidate_words: Column, most: int) -> DataFrame:
    """The candidates with the most words in common with each need, ties by id.

    Not all pairs with a common word are made. A need's words are ordered from rare to frequent. The first `most`
    candidates of each of its words are scored in full; the most-th score s is a bound: who reaches s, and more than one
    word, has one of all but the s - 1 most frequent words, so only candidates of those rarer words are scored, too. Who
    has a single word and is on the list is among that word's first candidates.
    """
    left = needs.select(F.col(need_id).alias("need"), F.array_distinct(need_words).alias("words")).where("need IS NOT NULL")
    asked = saved(left.select("need", F.explode("words").alias("word")), "overlap-asked")
    right = candidates.select(F.col(candidate_id).alias("candidate"), F.explode(F.array_distinct(candidate_words)).alias("word"))
    # only words that are asked for
    postings = saved(right.join(asked.select("word").distinct(), "word", "left_semi"), "overlap-postings")
    held = saved(postings.groupBy("candidate").agg(F.collect_set("word").alias("held")), "overlap-held")

    frequency = postings.groupBy("word").agg(F.count("*").alias("frequency"))
    by_rarity = Window.partitionBy("need").orderBy("frequency", "word")
    ranked = saved(asked.join(frequency, "word").withColumn("place", F.row_number().over(by_rarity)).withColumn("words", F.count("*").over(Window.partitionBy("need"))), "overlap-ranked")

    firsts = postings.withColumn("turn", F.row_number().over(Window.partitionBy("word").orderBy("candidate"))).where(F.col("turn") <= most).select("word", "candidate")
    some = _scored(ranked.select("need", "word").join(firsts, "word").select("need", "candidate").distinct(), left, held)
    bound = _first(some, most).groupBy("need").agg(F.when(F.count("*") >= most, F.min("relevance")).otherwise(1).alias("bound"))
    rare = ranked.join(bound, "need").where(F.col("place") <= F.col("words") - F.greatest("bound", F.lit(2)) + 1).select("need", "word")
    others = rare.join(postings, "word").select("need", "candidate").distinct().join(some.select("need", "candidate"), ["need", "candidate"], "left_anti")
    return _first(some.unionByName(_scored(others, left, held)), most)


def _scored(pairs: DataFrame, needs: DataFrame, held: DataFrame) -> DataFrame:
    both = pairs.join(needs, "need").join(held, "candidate")
    return saved(both.select("need", "candidate", F.size(F.array_intersect("words", "held")).cast("long").alias("relevance")), "overlap-scored")


def _first(scores: DataFrame, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("need").orderBy(F.desc("relevance"), "candidate"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= most)


def contract_score(searchable: Column, keywords: Column, bonuses: list[tuple[Column, int]], required: list[Column]) -> Column:
    """12 a keyword up to 60, and bonuses; 0 where keywords are asked for and none is there, or a filter fails."""
    matched = F.size(text.contained(keywords, searchable))
    score = F.least(F.lit(60), matched * 12)
    for condition, points in bonuses:
        score = score + F.when(condition, points).otherwise(0)
    fails = (F.size(keywords) > 0) & (matched == 0)
    for condition in required:
        fails = fails | ~F.coalesce(condition, F.lit(False))
    return F.when(fails, 0).otherwise(F.least(F.lit(100), score))


def people_score(searchable: Column, keywords: Column, years: Column, bonuses: list[tuple[Column, int]], required: list[Column]) -> Column:
    """11 a keyword up to 55, years up to 15, and bonuses; filters first."""
    matched = F.size(text.contained(keywords, searchable))
    score = F.least(F.lit(55), matched * 11) + F.greatest(F.lit(0.0), F.least(F.lit(15.0), years))
    for condition, points in bonuses:
        score = score + F.when(condition, points).otherwise(0)
    fails = (F.size(keywords) > 0) & (matched == 0)
    for condition in required:
        fails = fails | ~F.coalesce(condition, F.lit(False))
    return F.when(fails, 0.0).otherwise(F.least(F.lit(100.0), score))


def fragment_search(df: DataFrame, fields: list[Column], needle: str, order: list[str], most: int = 200) -> DataFrame:
    """The first `most` fragments, in order, whose fields contain the needle in any case."""
    return df.where(F.lower(F.concat_ws(" ", *fields)).contains(needle.lower())).orderBy(*order).limit(most)
