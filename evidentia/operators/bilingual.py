"""Component names in two languages: ordered rules that bring each name to a register's key, then merging, filling and cleaning by them.

Names are made distinct and cleaned; each then asks the register for every form its rules may need (the whole name, parts at slashes and in
parentheses, numbers of colourants, shifted words), all in one exploded table that meets one index of the register in one join.
What is found comes back to the name as a short array, and one expression tries the rules in order: the first that holds gives the name and its tag. So a rule costs no
join of its own, and the work grows with distinct names, not with rows.

register: key (upper case), cn_name, place (order of entries; ties of equal forms go to the first) and corrupt (keys that no other writing may become).
aliases: alias, key. A name that no rule tells stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import collapse, has_cjk, no_empty, normalize_name, slash_in_parentheses

# Forms of names that the rules tell apart.
FORMULA_CODE = r"(?i)\s*\(((?:CODE )?F\.I\.L\.:? [^()]*)\)\s*$"
MISTYPED_NUMBER = r"^CL\s+(\d+.*)$"
NUMBER_AND_NAME = r"^(CI \d+)\s+(\S.*)$"
COLOUR_NUMBER = r"^CI \d+$"
LAST_PARENTHESES = r"^(.+?)\s*\(([^()]{2,})\)\s*$"
COMPOSED = r"[()\[\],;/·]"
BRACKETED = r"\s*(?:\([^()]*\)|\[[^\[\]]*\])"
TWO_LATIN_WORDS = r"^[A-Z][A-Z-]{2,17} [A-Z][A-Z-]{2,17}$"
POLYMER = r"\bP[PE]G-\d"
#: Words of form and of plant parts, and the classes of forms.
FORM_CLASS = {"OIL": "oil", "EXTRACT": "extract", "BUTTER": "butter", "WAX": "wax", "CERA": "wax", "WATER": "water", "AQUA": "water", "JUICE": "juice", "POWDER": "powder", "STARCH": "starch", "PROTEIN": "protein", "GUM": "gum", "SALT": "salt"}
FORM_WORDS = [*FORM_CLASS, "KERNEL", "SEED", "FRUIT", "LEAF", "ROOT", "FLOWER", "BRAN", "GERM", "PEEL", "BARK", "BUD", "RESIN"]
#: Words of processes in parentheses, and what stands before and after the name in the entry they ask for.
PROCESSES = {"HYDROLYZED": ("HYDROLYZED ", ""), "HYDROLYSED": ("HYDROLYZED ", ""), "FERMENTED": ("", " FERMENT")}

#: Tags of the rules, in the order in which they are tried; "fil" may stand before any of them.
RULES = [
    "usan-alias", "usan-alias-collapse", "cl-typo", "cl-typo+ci-dual", "ci-dual", "punct-collapse", "slash-one", "slash-same", "slash-same-cn", "slash-ambiguous",
    "paren-process", "paren-nano", "paren-ambiguous", "paren-main", "paren-inner", "paren-shift",
]

_HIT = "array<struct<role:string,kind:string,tier:int,form:string>>"


def register_index(register: DataFrame, aliases: DataFrame) -> DataFrame:
    """kind, form, key, cn: what each form of a name leads to. Derived and collapsed forms lead somewhere only if all entries that share them have one Chinese name."""
    entries = register.select(F.upper("key").alias("key"), "cn_name", "place", F.coalesce("corrupt", F.lit(False)).alias("corrupt"))
    exact = entries.groupBy("key").agg(F.min_by("cn_name", "place").alias("cn")).select(F.lit("exact").alias("kind"), F.col("key").alias("form"), "key", "cn")
    bare = F.btrim(F.regexp_replace("key", BRACKETED, ""))
    forms = F.array(
        F.when((bare != F.col("key")) & (bare != ""), F.struct(F.lit("derived").alias("kind"), bare.alias("form"))),
        F.when(~F.col("corrupt"), F.struct(F.lit("collapsed").alias("kind"), collapse(F.col("key")).alias("form"))),
    )
    other = entries.select(F.explode(F.array_compact(forms)).alias("f"), "key", "cn_name", "place").groupBy("f.kind", "f.form")
    one = other.agg(F.min_by("key", "place").alias("key"), F.min("cn_name").alias("cn"), F.max("cn_name").alias("last")).where("cn = last").drop("last")
    named = aliases.select(F.upper("alias").alias("alias"), F.upper("key").alias("key")).distinct()
    by_alias = named.groupBy("alias").agg(F.min("key").alias("key")).select(F.lit("alias").alias("kind"), F.col("alias").alias("form"), "key", F.col("alias").alias("cn"))
    folded = by_alias.groupBy(collapse(F.col("form")).alias("form")).agg(F.min("key").alias("key"), F.min("cn").alias("cn"), F.count("*").alias("n")).where("n = 1")
    return exact.unionByName(one).unionByName(by_alias).unionByName(folded.select(F.lit("alias_folded").alias("kind"), "form", "key", "cn"))


def _one(role: Column | str, kind: str, tier: int, form: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), F.lit(kind).alias("kind"), F.lit(tier).alias("tier"), form.alias("form"))


def _forms(role: Column | str, asked: Column) -> Column:
    """All forms under which the register may know a name, best first: as it is, with or without a dot at its end, without brackets, derived, collapsed."""
    name = F.btrim(F.regexp_replace(F.upper(asked), r"\s+", " "))
    bare = F.btrim(F.regexp_replace(name, BRACKETED, ""))
    dotted = F.when(F.endswith(name, F.lit(".")), _one(role, "exact", 3, F.substring(name, F.lit(1), F.length(name) - 1)))
    stripped = F.when(bare != name, _one(role, "exact", 4, bare))
    every = F.array(_one(role, "exact", 1, name), _one(role, "exact", 2, F.concat(name, F.lit("."))), dotted, stripped, _one(role, "derived", 5, bare), _one(role, "collapsed", 6, collapse(name)))
    return F.when(asked.isNotNull(), F.array_compact(every)).otherwise(F.array().cast(_HIT))


def _group(text: Column, pattern: str, number: int) -> Column:
    """A group of a pattern, null where it doesn't match."""
    return F.when(text.rlike(pattern), F.btrim(F.regexp_extract(text, pattern, number)))


def _read(names: DataFrame) -> DataFrame:
    """name with its clean form s, the formula code, and the parts that the rules ask about."""
    clean = normalize_name(F.col("name"))
    rows = names.select("name").distinct().withColumns({"whole": clean, "code": F.nullif(F.regexp_extract(clean, FORMULA_CODE, 1), F.lit(""))})
    rows = rows.withColumn("s", F.when(F.col("code").isNull(), F.col("whole")).otherwise(F.btrim(F.regexp_replace(F.regexp_replace("whole", FORMULA_CODE, ""), r"\s+", " "))))
    s = F.col("s")
    mistyped = F.when(s.rlike(MISTYPED_NUMBER), F.concat(F.lit("CI "), F.regexp_extract(s, MISTYPED_NUMBER, 1)))
    rows = rows.withColumns({"mistyped": mistyped, "twice": F.coalesce(mistyped, s), "at_slashes": s.contains("/") & ~slash_in_parentheses(s)})
    second = _group(F.col("twice"), NUMBER_AND_NAME, 2)
    parts = F.when(F.col("at_slashes"), no_empty(F.transform(F.split(s, "/"), lambda x: F.btrim(x))))
    main, inner = _group(s, LAST_PARENTHESES, 1), _group(s, LAST_PARENTHESES, 2)
    simple = ~F.col("at_slashes") & ~main.rlike(COMPOSED)
    rows = rows.withColumns({
        "number": F.when(~second.rlike(COMPOSED), _group(F.col("twice"), NUMBER_AND_NAME, 1)),
        "second": F.when(~second.rlike(COMPOSED), second),
        "parts": parts,
        "main": F.when(simple, main),
        "inner": F.when(simple, inner),
    })
    word = F.upper("inner")
    process = F.coalesce(*[F.when(word == key, F.concat(F.lit(before), F.col("main"), F.lit(after))) for key, (before, after) in PROCESSES.items()])
    words = F.split("inner", r"\s+")
    shifted = F.when(F.size(words) >= 2, F.concat(F.col("main"), F.lit(" ("), F.get(words, 0), F.lit(") "), F.array_join(F.slice(words, 2, 1000), " ")))
    return rows.withColumns({"process": process, "shifted": shifted})


def _requests() -> Column:
    s = F.col("s")
    none = F.array().cast(_HIT)
    when = lambda condition, forms: F.when(condition, forms).otherwise(none)
    single = F.array(_one("whole", "exact", 1, F.upper(s)), _one("alias", "alias", 1, F.upper(s)), _one("alias_folded", "alias_folded", 1, collapse(s)))
    parts = F.flatten(F.transform("parts", lambda part, i: _forms(F.concat(F.lit("part"), i.cast("string")), part)))
    return F.concat(
        single,
        when(F.endswith(s, F.lit(".")), _forms("dot", s)),
        _forms("mistyped", F.col("mistyped")),
        _forms("number", F.col("number")),
        _forms("second", F.col("second")),
        when(~s.rlike(r"[(\[]"), F.array(_one("folded", "collapsed", 6, collapse(s)))),
        F.coalesce(parts, none),
        *[_forms(role, F.col(role)) for role in ("main", "inner", "process", "shifted")],
    )


def _hits(read: DataFrame, index: DataFrame) -> DataFrame:
    """name and hits: for each role the best entry, as (role, tier, key, cn)."""
    asked = read.select("name", F.explode(_requests()).alias("r")).select("name", "r.*").where("form <> ''")
    found = asked.join(index, ["kind", "form"]).groupBy("name", "role").agg(F.min(F.struct("tier", "key", "cn")).alias("best"))
    return found.groupBy("name").agg(F.collect_list(F.struct("role", "best.tier", "best.key", "best.cn")).alias("hits"))


def substance_words(name: Column) -> Column:
    """Words of three letters or more that stand for a substance, not for a form or a part of a plant."""
    words = F.regexp_extract_all(F.upper(name), F.lit("([A-Z0-9][A-Z0-9-]*)"), 1)
    return F.filter(F.array_distinct(words), lambda w: (F.length(w) >= 3) & w.rlike("[A-Z]") & ~w.isin(FORM_WORDS))


def form_class(name: Column) -> Column:
    classes = F.create_map(*[F.lit(x) for pair in FORM_CLASS.items() for x in pair])
    return F.element_at(classes, F.element_at(F.split(F.btrim(F.upper(name)), r"\s+"), -1))


def one_substance(key: Column, other: Column) -> Column:
    """Whether a part that the register doesn't know may mean the entry of the other part: not its beginning, no Latin species, not two substance words in common, no other form."""
    name = F.btrim(F.upper(other))
    own, words = F.split(key, " "), F.split(name, r"\s+")
    beginning = (F.size(words) < F.size(own)) & (F.slice(own, 1, F.size(words)) == words)
    species = name.rlike(TWO_LATIN_WORDS) & ~F.element_at(words, -1).isin(FORM_WORDS)
    shared = F.size(F.array_intersect(substance_words(name), substance_words(key)))
    other_form = (shared == 0) & ~form_class(name).eqNullSafe(form_class(key))
    return ~(beginning | species | (shared >= 2) | other_form)


def _is_number(key: Column) -> Column:
    return key.rlike(COLOUR_NUMBER)


def _hit(role: Column | str) -> Column:
    return F.get(F.filter("hits", lambda x: x["role"] == role), 0)


def _with_parts(rows: DataFrame) -> DataFrame:
    """The known and unknown parts at slashes; firsts: each key once, chosen: the first that is no number, others: the rest, shared: whether one of them has a substance word of the chosen."""
    found = lambda i: _hit(F.concat(F.lit("part"), i.cast("string")))
    parts = F.transform("parts", lambda part, i: F.struct(part.alias("part"), found(i)["key"].alias("key"), found(i)["cn"].alias("cn")))
    rows = rows.withColumn("told_parts", parts)
    known, unknown = F.filter("told_parts", lambda p: p["key"].isNotNull()), F.filter("told_parts", lambda p: p["key"].isNull())
    rows = rows.withColumns({"known": known, "unknown": F.get(unknown, 0)["part"], "known_keys": F.transform(known, lambda p: p["key"])})
    rows = rows.withColumn("firsts", F.filter("known", lambda p, i: F.array_position("known_keys", p["key"]) == i + 1))
    rows = rows.withColumn("chosen", F.coalesce(F.get(F.filter("firsts", lambda p: ~_is_number(p["key"])), 0), F.get("firsts", 0)))
    rows = rows.withColumns({"others": F.filter("firsts", lambda p: p["key"] != F.col("chosen.key")), "own_words": substance_words(F.col("chosen.part"))})
    return rows.withColumn("shared", F.exists("others", lambda p: F.arrays_overlap("own_words", substance_words(p["part"]))))


def _decided() -> Column:
    """The first rule that holds, as (resolved, rule, detail)."""
    s = F.col("s")
    key = {role: _hit(role)["key"] for role in ("whole", "alias", "alias_folded", "dot", "mistyped", "number", "second", "folded", "main", "inner", "process", "shifted")}
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    out = lambda name, rule, detail=None: F.struct(name.alias("resolved"), text(rule).alias("rule"), text(detail).alias("detail"))
    stay = out(s, None)
    two_names = key["number"].isNotNull() & key["second"].isNotNull() & (key["number"] != key["second"])

    first, chosen = F.get("known", 0)["key"], F.col("chosen.key")
    one_known = (F.size("parts") == 2) & (F.size("known") == 1)
    slashes = (
        F.when(one_known & one_substance(first, F.col("unknown")), out(first, "slash-one", F.col("unknown")))
        .when(F.size("known") < 2, stay)
        .when(F.size("others") == 0, out(chosen, "slash-same"))
        .when(F.size(F.array_distinct(F.transform("firsts", lambda p: p["cn"]))) == 1, out(chosen, "slash-same-cn"))
        .when(_is_number(chosen) | ~F.col("shared"), out(chosen, "slash-ambiguous", F.array_join(F.transform("firsts", lambda p: p["key"]), "|")))
        .otherwise(stay)
    )
    main, inner = key["main"], key["inner"]
    both = main.isNotNull() & inner.isNotNull() & (main != inner)
    parentheses = (
        F.when(F.col("process").isNotNull(), F.when(key["process"].isNotNull(), out(key["process"], "paren-process", F.col("inner"))).otherwise(stay))
        .when((F.upper("inner") == "NANO") & main.isNotNull(), out(F.concat(main, F.lit(" [NANO]")), "paren-nano"))
        .when(both, out(F.when(_is_number(main) & ~_is_number(inner), inner).otherwise(main), "paren-ambiguous", F.concat_ws("|", "main", "inner")))
        .when(main.isNotNull(), out(main, "paren-main"))
        .when(inner.isNotNull() & ~_is_number(inner), out(inner, "paren-inner"))
        .when(key["shifted"].contains("("), out(key["shifted"], "paren-shift"))
        .otherwise(stay)
    )
    return (
        F.when(key["whole"].isNotNull(), stay)
        .when(key["alias"].isNotNull(), out(key["alias"], "usan-alias"))
        .when(key["alias_folded"].isNotNull(), out(key["alias_folded"], "usan-alias-collapse", _hit("alias_folded")["cn"]))
        .when(key["dot"].isNotNull(), out(key["dot"], None))
        .when(key["mistyped"].isNotNull(), out(key["mistyped"], "cl-typo"))
        .when(two_names, out(key["second"], F.when(F.col("mistyped").isNotNull(), "cl-typo+ci-dual").otherwise("ci-dual"), F.concat_ws("|", "number", "second")))
        .when(key["folded"].isNotNull(), out(key["folded"], "punct-collapse"))
        .when(F.col("at_slashes") & ((F.size("parts") < 2) | s.rlike(POLYMER)), stay)
        .when(F.col("at_slashes"), slashes)
        .when(F.col("main").isNotNull(), parentheses)
        .otherwise(stay)
    )


def resolve_bilingual(names: DataFrame, register: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, resolved, rule and detail of every distinct name; rule: tags joined by "+", null where the name stays or was only cleaned.

    A null name counts as an empty one and stays empty.
    """
    read = _read(names.select("name"))
    joined = read.join(_hits(read, register_index(register, aliases)), "name", "left")
    joined = joined.withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<role:string,tier:int,key:string,cn:string>>")))
    told = _with_parts(joined).withColumn("told", _decided())
    code = F.when(F.col("code").isNotNull(), F.lit("fil"))
    rule = F.nullif(F.concat_ws("+", code, F.col("told.rule")), F.lit(""))
    return told.select("name", F.col("told.resolved").alias("resolved"), rule.alias("rule"), F.coalesce(F.col("told.detail"), F.col("code")).alias("detail"))


def register_keys(names: DataFrame, register: DataFrame) -> DataFrame:
    """name, key and cn of every distinct name that the register knows in some form."""
    none = register.sparkSession.createDataFrame([], "alias string, key string")
    read = names.select("name").distinct()
    asked = read.select("name", F.explode(_forms("name", normalize_name(F.col("name")))).alias("r")).select("name", "r.*").where("form <> ''")
    best = asked.join(register_index(register, none), ["kind", "form"]).groupBy("name").agg(F.min(F.struct("tier", "key", "cn")).alias("best"))
    return best.select("name", "best.key", "best.cn")


# ---- merging, filling, cleaning ----


def merge_names(components: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components that stay, and ingredient_id with keeper_id of every component.

    components: ingredient_id, inci_name, cn_name. Of components that resolve to one name (in any case) the one that bears it already stays, else the smallest id; it
    takes the resolved name of the smallest id, and if it has no Chinese name, that of the first that has one. n_merged: how many went into it.
    """
    named = components.join(resolved.select(F.col("name").alias("inci_name"), "resolved"), "inci_name")
    named = named.withColumns({"key": F.upper("resolved"), "own": F.upper("inci_name") == F.upper("resolved")})
    order = F.struct(~F.col("own"), F.col("ingredient_id"))
    groups = named.groupBy("key").agg(
        F.min_by("ingredient_id", order).alias("keeper_id"),
        F.min_by("resolved", "ingredient_id").alias("inci_name"),
        F.min_by("cn_name", order).alias("keeper_cn"),
        F.min_by(F.when(has_cjk(F.col("cn_name")), F.col("cn_name")), F.when(has_cjk(F.col("cn_name")), F.col("ingredient_id"))).alias("chinese"),
        (F.count("*") - 1).alias("n_merged"),
    )
    cn = F.when(has_cjk(F.col("keeper_cn")) | F.col("chinese").isNull(), F.col("keeper_cn")).otherwise(F.col("chinese"))
    keepers = groups.select("key", F.col("keeper_id").alias("ingredient_id"), "inci_name", cn.alias("cn_name"), "n_merged")
    moves = named.select("ingredient_id", "key").join(groups.select("key", "keeper_id"), "key").select("ingredient_id", "keeper_id")
    return keepers.drop("key"), moves


def repoint_links(links: DataFrame, moves: DataFrame) -> DataFrame:
    """Links of merged components, now of their keepers; of several of one product with one keeper, the keeper's own link stays, else that of the smallest id."""
    kept = [x for x in links.columns if x not in ("product_id", "ingredient_id")]
    moved = links.join(moves, "ingredient_id")
    order = F.struct(F.col("ingredient_id") != F.col("keeper_id"), F.col("ingredient_id"), *[F.col(x) for x in kept])
    best = moved.groupBy("product_id", "keeper_id").agg(F.min(order).alias("best"))
    return best.select("product_id", F.col("keeper_id").alias("ingredient_id"), *[F.col(f"best.{x}").alias(x) for x in kept])


def fill_names(components: DataFrame, register: DataFrame) -> DataFrame:
    """components with Chinese names from the register where they have none, and without what stands at names' ends; filled: whether the register gave the name."""
    found = register_keys(components.select(F.col("inci_name").alias("name")), register)
    joined = components.join(found.select(F.col("name").alias("inci_name"), "key", "cn"), "inci_name", "left")
    own = has_cjk(F.col("cn_name"))
    filled = ~own & F.col("cn").isNotNull()
    cn = F.when(filled, F.col("cn")).otherwise(F.coalesce("cn_name", F.lit("")))
    clean = F.btrim(F.regexp_replace(F.regexp_replace(cn, r"\s*\[\s*\]\s*$", ""), r"[\s*^]*[*^]+$", ""))
    # a register's name without Chinese (a number) stays; other names without Chinese only stand in for the name
    final = F.when(has_cjk(cn), clean).when(cn.eqNullSafe(F.col("cn")), cn).otherwise(F.col("inci_name"))
    given = filled & ~F.col("cn").eqNullSafe(F.col("cn_name"))
    return joined.select(*[F.col(x) if x != "cn_name" else final.alias("cn_name") for x in components.columns], given.alias("filled"), F.col("key").alias("register_key"))


def coverage(components: DataFrame, links: DataFrame) -> DataFrame:
    """One row: components and links, and how many of each have a Chinese name or an entry in the register; components: as fill_names() gives them."""
    covered = (has_cjk(F.col("cn_name")) | F.col("register_key").isNotNull()).cast("long")
    own = components.select("ingredient_id", covered.alias("covered"))
    linked = links.groupBy("ingredient_id").agg(F.count("*").alias("n_links"))
    joined = own.join(linked, "ingredient_id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return joined.agg(F.count("*").alias("components"), F.coalesce(F.sum("covered"), F.lit(0)).alias("with_cn"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("n_links") * F.col("covered")), F.lit(0)).alias("links_cn"))
