"""Ordered keyword rules as column expressions: effect families, evidence levels and their strengths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Effect families with their keywords; the first family with a keyword in the text wins.
FAMILIES = [
    ("美白", ["美白", "提亮", "淡斑", "黄褐斑", "黑素", "酪氨酸酶"]),
    ("控油祛痘", ["控油", "祛痘", "痤疮", "粉刺", "痘"]),
    ("抗皱", ["抗皱", "抗老", "细纹", "皱纹", "胶原", "紧致", "光老化"]),
    ("抗氧化", ["抗氧化", "光防护", "自由基", "抗氧"]),
    ("保湿", ["保湿", "水合", "锁水"]),
    ("修护", ["修护", "屏障", "修复"]),
    ("舒缓", ["舒缓", "抗敏", "镇静", "抗炎", "消炎", "泛红"]),
    ("焕肤", ["焕肤", "去角质", "剥脱", "换肤"]),
    ("防腐", ["防腐"]),
]
OTHER, PRESERVATIVE = "其他", "防腐"
#: Families that rankings are made for.
RANKED_FAMILIES = ["美白", "抗皱", "保湿", "舒缓", "控油祛痘", "修护", "抗氧化", "焕肤"]
#: Evidence levels and their strengths.
STRENGTHS = {"human_rct": 1.0, "human_ct": 0.8, "human_open": 0.55, "in_vitro": 0.5, "animal": 0.4, "oral": 0.3, "review": 0.35, "regulation": 0.9, "unknown": 0.2}
HUMAN_LEVELS = ["human_rct", "human_ct", "human_open"]
#: Words in a note or an excerpt that tell a study's kind. (?<!...) keeps external use apart from in-vitro work.
WEAK_WORDS = [("oral", "口服"), ("review", "综述"), ("animal", "动物|豚鼠|小鼠|大鼠"), ("in_vitro", "(?<!人)体外")]
CONSUMER_WORDS, STRONG_NOTE_WORDS, STRONG_EXCERPT_WORDS = "消费者", "双盲|RCT|随机", "双盲|RCT|随机对照|随机分组"
HUMAN_WORDS, OPEN_WORDS, OBSERVED_WORD = "人体|临床", "开放|无对照|病例系列", "观察性"
#: Kinds of product that are rinsed off.
RINSE_WORDS = "洗|洁面|洗发|沐浴|卸妆|发膜"


def first_of(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first true condition, else null."""
    (condition, value), *rest = cases
    return reduce(lambda chain, case: chain.when(*case), rest, F.when(condition, value))


def canonical_family(effect: Column) -> Column:
    """The family of a free-text effect; OTHER for null, empty and unknown texts."""
    return F.coalesce(first_of([(effect.rlike("|".join(words)), F.lit(name)) for name, words in FAMILIES]), F.lit(OTHER))


def family_or_canonical(family: Column, effect: Column) -> Column:
    """A stored family, or that of the effect where none is stored."""
    return F.coalesce(F.nullif(family, F.lit("")), canonical_family(effect))


def _weak(text: Column) -> Column:
    return first_of([(text.rlike(words), F.lit(level)) for level, words in WEAK_WORDS])


def evidence_level(note: Column, kind: Column, excerpt: Column) -> Column:
    """The level of an assertion from its note, the kind of its evidence and, for papers, the excerpt; never guessed."""
    seen = lambda text: F.coalesce(~text.contains(OBSERVED_WORD), F.lit(False))
    note_level = first_of(
        [
            (note.rlike(CONSUMER_WORDS), F.lit("human_ct")),
            (note.rlike(STRONG_NOTE_WORDS) & ~note.rlike(OPEN_WORDS), F.lit("human_rct")),
            (note.rlike(f"{STRONG_NOTE_WORDS}|{HUMAN_WORDS}"), F.lit("human_open")),
        ]
    )
    excerpt_level = first_of([(excerpt.rlike(CONSUMER_WORDS), F.lit("human_ct")), (excerpt.rlike(STRONG_EXCERPT_WORDS), F.lit("human_rct"))])
    of_paper = F.coalesce(_weak(excerpt), F.when(seen(excerpt), excerpt_level))
    return F.coalesce(
        _weak(note),
        F.when(kind == "regulation", F.lit("regulation")),
        F.when(seen(note), note_level),
        F.when(kind == "paper", of_paper),
        F.lit("unknown"),
    )


def strength_of(level: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in STRENGTHS.items() for x in pair]), level)


def is_leave_on(category: Column) -> Column:
    """Whether a product stays on the skin; true where nothing says otherwise."""
    return F.coalesce(~category.rlike(RINSE_WORDS), F.lit(True))
