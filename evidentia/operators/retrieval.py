"""Which components a question asks about, in three stages: aliases in it, names in it, and only where neither finds any, its words resolved like searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.operators.matching import phrases_in_texts
from evidentia.operators.resolution import resolve

#: Components of one question, letters of a name that tells anything, and what counts as a word of a question.
MOST_COMPONENTS, LEAST_LETTERS = 3, 2
QUESTION_WORD = r"[A-Za-z0-9][A-Za-z0-9\-]+|[一-鿿]{2,8}"


def question_components(questions: DataFrame, aliases: DataFrame, components: DataFrame, most: int = MOST_COMPONENTS) -> DataFrame:
    """question_id, ingredient_id, stage (1 alias, 2 name, 3 word) and rank of the components that each question asks about.

    questions: question_id, question; aliases: alias, ingredient_id, place (order of aliases and their components); components: ingredient_id, cn_name, inci_name. First come aliases,
    longer ones first, then those that stand earlier; then names, longer ones first, then smaller ids; then, only where there is neither, words in their order. Latin letters of any case are one.
    """
    texts = questions.select(F.col("question_id").alias("text_id"), F.upper("question").alias("text"))
    exact = questions.select(F.col("question_id").alias("text_id"), F.col("question").alias("text"))
    named = aliases.select(F.upper("alias").alias("phrase"), "ingredient_id", "place")
    held = lambda rows, phrases: phrases_in_texts(rows, phrases.select(F.col("phrase").alias("phrase_id"), "phrase").distinct()).withColumnRenamed("phrase_id", "phrase")
    order = lambda *values: F.array(*[x.cast("long") for x in values])

    first = held(texts, named).join(texts, "text_id").join(named, "phrase")
    first = first.select("text_id", "ingredient_id", F.lit(1).alias("stage"), order(-F.length("phrase"), F.instr("text", F.col("phrase")), F.col("place")).alias("order"))

    long = lambda name: F.length(name) >= LEAST_LETTERS
    chinese = components.where(long("cn_name")).select("ingredient_id", F.col("cn_name").alias("phrase"))
    latin = components.where(long("inci_name")).select("ingredient_id", F.upper("inci_name").alias("phrase"))
    found = held(exact, chinese).join(chinese, "phrase").unionByName(held(texts, latin).join(latin, "phrase"))
    longest = found.groupBy("text_id", "ingredient_id").agg(F.max(F.length("phrase")).alias("letters"))
    second = longest.select("text_id", "ingredient_id", F.lit(2).alias("stage"), order(-F.col("letters"), F.col("ingredient_id")).alias("order"))

    early = first.unionByName(second)
    left = exact.join(early.select("text_id").distinct(), "text_id", "left_anti")
    words = left.select("text_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"({QUESTION_WORD})"), 1)).alias("at", "query"))
    names = components.select("ingredient_id", F.explode(F.array("cn_name", "inci_name")).alias("name")).where("name is not null")
    known = aliases.groupBy(F.upper("alias").alias("alias")).agg(F.min_by("ingredient_id", "place").alias("ingredient_id"))
    told = resolve(words.select("query").distinct(), names, known, 1).where("ingredient_id is not null").select("query", "ingredient_id")
    third = words.join(told, "query").select("text_id", "ingredient_id", F.lit(3).alias("stage"), order(F.col("at")).alias("order"))

    best = early.unionByName(third).groupBy("text_id", "ingredient_id").agg(F.min(F.struct("stage", "order")).alias("best"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("text_id").orderBy("best", "ingredient_id"))).where(F.col("rank") <= most)
    return ranked.select(F.col("text_id").alias("question_id"), "ingredient_id", "best.stage", "rank")
