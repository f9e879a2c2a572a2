"""Looking up components by name, and creating those that aren't there yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.ordering import numbered


def find_or_create(names: DataFrame, register: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The register with a row for every name, and name, ingredient_id and via (chinese, name, new) of every different name.

    register: ingredient_id, inci_name, cn_name. A name is that of the component that has it as its Chinese name (the smallest id), else of the one whose own name it is, else of
    a new one, which bears it as both. New ids go on from the greatest without gaps, in the order of names; once they are in the register, another run creates none.
    Null and empty names are none.
    """
    asked = names.select("name").where("name is not null and name <> ''").distinct()
    known = lambda column, value: register.where(f"{column} is not null").groupBy(F.col(column).alias("name")).agg(F.min("ingredient_id").alias(value))
    looked = asked.join(known("cn_name", "by_chinese"), "name", "left").join(known("inci_name", "by_name"), "name", "left")
    greatest = register.agg(F.coalesce(F.max("ingredient_id"), F.lit(0))).first()[0]
    new = numbered(looked.where("by_chinese is null and by_name is null").select("name"), [F.asc("name")], "ingredient_id", greatest + 1)
    via = F.when(F.col("by_chinese").isNotNull(), "chinese").otherwise("name")
    found = looked.withColumn("ingredient_id", F.coalesce("by_chinese", "by_name")).where("ingredient_id is not null").select("name", "ingredient_id", via.alias("via"))
    created = new.select("name", "ingredient_id", F.lit("new").alias("via"))
    stubs = new.select("ingredient_id", F.col("name").alias("inci_name"), F.col("name").alias("cn_name"))
    return register.select("ingredient_id", "inci_name", "cn_name").unionByName(stubs), found.unionByName(created)
