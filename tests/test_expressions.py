"""Rules, doses and texts on hand-checked rows."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import dose, rules
from evidentia.functions import text as t


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, column, text):
    return values(spark, [(text,)], "x string", column(F.col("x")).alias("y"))[0][0]


@pytest.mark.parametrize(
    "text, family",
    [("祛痘（抗菌抗炎）", "控油祛痘"), ("抗氧化/美白提亮", "美白"), ("抗糖化", "其他"), ("", "其他"), (None, "其他"), ("淡化黄褐斑", "美白"), ("防腐", "防腐"), ("皮肤屏障", "修护"), ("抗炎", "舒缓"), ("去角质", "焕肤"), ("光老化", "抗皱"), ("自由基", "抗氧化"), ("锁水", "保湿")],
)
def test_families(spark, text, family):
    assert one(spark, rules.canonical_family, text) == family


LEVELS = [
    ("人体外用试验（n=73）", "paper", None, "human_open"),
    ("综述，豚鼠模型", "paper", None, "review"),
    ("动物 + 口服", "paper", None, "oral"),
    ("随机分组开放标签人体试验", "paper", None, "human_open"),
    ("观察性人体研究", "paper", None, "unknown"),
    (None, "paper", "人体皮肤外植体", "unknown"),
    (None, "paper", "随机对照", "human_rct"),
    (None, "patent", "随机对照", "unknown"),
    ("双盲", "paper", None, "human_rct"),
    ("消费者测试", "patent", None, "human_ct"),
    ("体外", "paper", None, "in_vitro"),
    ("双盲", "regulation", None, "regulation"),
    ("小鼠", "regulation", None, "animal"),
    (None, None, None, "unknown"),
]


def test_evidence_levels(spark):
    found = values(spark, [r[:3] for r in LEVELS], "note string, kind string, excerpt string", rules.evidence_level(F.col("note"), F.col("kind"), F.col("excerpt")).alias("level"))
    assert [x[0] for x in found] == [r[3] for r in LEVELS]
    assert values(spark, [("human_rct",), ("unknown",)], "x string", rules.strength_of(F.col("x"))) == [(1.0,), (0.2,)]


def test_leave_on(spark):
    assert [one(spark, rules.is_leave_on, x) for x in ("洁面乳", "面霜", None)] == [False, True, True]


FACTORS = [
    (1.0, 3.0, 2.0, False, 1.0), (0.5, 1.5, 2.0, False, 0.5), (0.2, 0.8, 4.0, False, 0.125), (2.0, 6.0, 2.0, False, 1.5), (None, None, 2.0, False, 0.5),
    (None, None, 0.05, True, 1.0), (0.001, 0.01, 0.0003, True, 1.0), (None, None, 0.1, True, 0.5), (1.0, 3.0, None, False, 1.0), (1.0, 3.0, 0.0, False, 1.0),
]
INTERVAL = ["low", "high", "effective", "is_trace"]


def test_dose_factors(spark):
    rows = values(spark, [r[:4] for r in FACTORS], "low double, high double, effective double, is_trace boolean", dose.dose_factor(*map(F.col, INTERVAL)).alias("f"))
    assert [r[0] for r in rows] == pytest.approx([r[4] for r in FACTORS])


VERDICTS = [
    (0.001, 0.01, 0.0003, True, "trace_level"), (0.01, 0.09, 0.05, True, "trace_level"), (1.0, 2.0, None, False, "unknown"), (0.001, 0.01, 0.1, True, "insufficient"),
    (0.05, 0.5, 0.2, True, "uncertain"), (0.5, 1.0, 0.05, False, "effective"), (0.5, None, 0.6, False, None), (0.5, 1.0, 0.0, False, "effective"),
]


def test_verdicts(spark):
    rows = values(spark, [r[:4] for r in VERDICTS], "low double, high double, effective double, is_trace boolean", dose.verdict(*map(F.col, INTERVAL)).alias("v"))
    assert [r[0] for r in rows] == [r[4] for r in VERDICTS]


def test_costs(spark):
    cost = dose.cost_per_dose(F.col("p"), F.col("v"), F.col("d"), F.col("e"))
    rows = values(spark, [(59.0, 30.0, 10.0, 2.0), (59.0, 30.0, 0.0, 2.0), (None, 30.0, 1.0, 2.0)], "p double, v double, d double, e double", F.round(cost, 4).alias("c"))
    assert rows == [(0.3933,), (None,), (None,)]
    assert [one(spark, dose.parse_volume, x) for x in ("30ml", "50克", "230毫升", " 1.5 G ", "30ml*2", "1.5oz", "ml", None)] == [30.0, 50.0, 230.0, 1.5, None, None, None, None]


CLASSES = [(600.0, 2.0, "hard"), (600.1, 2.0, "not_applicable"), (500.0, 2.0, "easy"), (500.1, 2.0, "hard"), *[(300.0, x, "medium") for x in (0.0, 0.999, 3.5, 4.0)], (300.0, -0.1, "hard"), (300.0, 4.1, "hard"), (None, 2.0, "not_applicable"), (300.0, None, "not_applicable")]


def test_skin_penetration(spark):
    rows = values(spark, [r[:2] for r in CLASSES], "w double, l double", dose.penetration_class(F.col("w"), F.col("l"), F.lit(False)).alias("c"))
    assert [r[0] for r in rows] == [r[2] for r in CLASSES]
    kp = values(spark, [(122.12, -0.4), (138.12, 2.3)], "w double, l double", dose.log_permeability(F.col("w"), F.col("l")))
    assert [r[0] for r in kp] == pytest.approx([-3.728932, -1.909532])
    assert [one(spark, dose.ionic_rule, x) for x in ("ZINC PCA", "DIPOTASSIUM X", "SODIUM Y", "ASCORBYL PALMITATE", "WATER")] == ["pca", "potassium", "sodium", "ate", None]


def test_anchors(spark):
    rows = values(spark, [(1.0, 2.0, 0.8), (1.0, 2.0, 2.4), (1.0, 2.0, 0.79), (1.0, 2.0, 2.41)], "a double, b double, d double", dose.anchor_hit(F.col("a"), F.col("b"), F.col("d")))
    assert [r[0] for r in rows] == [True, True, False, False]


NAMES = [
    ("TITANÏUM DIOXIDE®", "TITANIUM DIOXIDE"), ("NIACINAMIDE*", "NIACINAMIDE"), ("*VITAMIN C", "VITAMIN C"), ("WATER\\AQUA\\EAU", "WATER"), ("YEAST EXTRACT FAEX EXTRAIT DE LEVURE", "YEAST EXTRACT FAEX"),
    ("X [ ]", "X"), ("X < 0.1%", "X"), ("X -> y", "X"), (" a \xad b​ ", "a b"), ("MAY‐B’E", "MAY-B'E"), ("ALOE / EXTRAIT D'ALOE", "ALOE"), (None, ""), ("水", "水"),
]


def test_names(spark):
    assert [one(spark, t.normalize_name, a) for a, _ in NAMES] == [b for _, b in NAMES]
    assert [one(spark, t.canonical_water, x) for x in ("Aqua/Water/Eau", "WATER", "ROSE WATER", "")] == ["WATER", "WATER", "ROSE WATER", ""]
    assert one(spark, t.collapse, "Trideceth-3 水") == "TRIDECETH3水" and one(spark, t.fold, "Ab - C") == "abc"
    assert [one(spark, t.brand_group, x) for x in ("理肤泉 La Roche", "SK-II", None, "OLAY 玉兰油")] == ["理肤泉", "SK-II", "", "玉兰油"]
    assert [one(spark, t.brand_head, x) for x in ("理肤泉 La Roche-Posay", "OLAY 玉兰油", " SK-II ", None)] == ["理肤泉", "玉兰油", "SK-II", ""]


SAME = [
    ("Cicaplast Baume (la-roche-posay-cicaplast-2)", "CICAPLAST baume", True), ("Effaclar Effaclar Gel", "Effaclar Gel", True), ("Effaclar Duo", "Effaclear Duo", True), ("Mosturising Cream", "Moisturizing Cream", True),
    ("Lip Rose Gold", "Lip Pure Gold", False), ("Cream Normal Skin", "Cream Dry Skin", False), ("Cream (Europe)", "Cream", False), ("Mist Intense", "Mist Fresh", False),
]


def test_same_names(spark):
    rows = values(spark, [r[:2] for r in SAME], "a string, b string", t.same_name(F.col("a"), F.col("b")))
    assert [r[0] for r in rows] == [r[2] for r in SAME]


def test_parsing(spark):
    assert [one(spark, t.percent_range, x) for x in ("0.5-1.0", "3", "=A1*2", "none", None)] == [(0.5, 1.0), (3.0, 3.0), None, None, None]
    assert one(spark, t.effect_phrases, "抗氧化、抗老化，抗氧化；a long prose") == ["抗氧化", "抗老化"]
    assert one(spark, t.list_tokens, " Water, Glycerin ,, NIACINAMIDE") == ["water", "glycerin", "niacinamide"]
    assert one(spark, t.list_words, "1,2-Hexanediol, Aqua、AQUA；Glyc-erin\nglycerin") == ["1,2-Hexanediol", "Aqua", "Glyc-erin"]
    assert one(spark, t.stem, "美白（抑制）") == "美白"
    assert one(spark, t.claims, "烟酰胺能美白[1]。这是一个过渡句。泛醇能保湿[2]。") == ["烟酰胺能美白[1]", "泛醇能保湿[2]"]
    assert [one(spark, t.needs_hedge, x) for x in ("起效浓度为 2%", "文献值 2%", "no number")] == [True, False, False]
    assert one(spark, t.citations, "b[2] a[1][02] x[1234]") == [1, 2]
    assert one(spark, t.paper_id, "https://pubmed.ncbi.nlm.nih.gov/123/") == "123" and one(spark, t.paper_id, "x") is None


def test_set_jaccard(spark):
    rows = values(spark, [([1, 2], [2, 3]), ([], [])], "a array<int>, b array<int>", t.set_jaccard(F.col("a"), F.col("b")))
    assert [r[0] for r in rows] == pytest.approx([1 / 3, 0.0])


def test_small_texts(spark):
    assert one(spark, t.page_name, ' niacin&amp;amide "x" (2.5%) ') == 'NIACIN&AMIDE X'
    assert [one(spark, t.slash_in_parentheses, x) for x in ("(A/B) C", "A/B (C)", "A (B (C) /D)", "")] == [True, False, True, False]
    assert [r[0] for r in values(spark, [(0.5,), (10.0,), (1e-7,), (0.0,)], "x double", t.plain_number(F.col("x")))] == ["0.5", "10", "0.0000001", "0"]
    assert [one(spark, t.mixture_part, x) for x in ("Rose Oil", "Collagen", "Foil", "Niacinamide")] == [True, True, False, False]
    assert [one(spark, t.mixture_word, x) for x in ("rose oil", "Foil", "Soy Protein")] == [True, False, True]
    assert [one(spark, t.evaluation_tier, x) for x in ("消费者使用测试", "文献资料", "x", None)] == ["真人实测", "仅文献资料", "研究数据", "研究数据"]
    text = "It is safe at 1%.\nOPINION\nX is safe at 2 %. Nothing here. The risk cannot be told!\nEnd."
    assert one(spark, t.opinion_sentences, text) == ["X is safe at 2 %.", "The risk cannot be told!"]
    note = t.snapshot_note(F.lit("u"), F.lit("T"), F.lit(True), F.lit(False), F.lit(3), F.lit(None).cast("int"))
    assert spark.range(1).select(note).first()[0] == "页面 u；标题「T」；日期仅月日，年份按采集日推断（估计）"


def test_list_words_splits_and_folds_once(spark):
    rows = spark.createDataFrame([("a、A、b，c、，C、1,2-D",), (None,), ("",)], "text string").select(t.list_words(F.col("text")).alias("words"))
    assert [r.words for r in rows.collect()] == [["a", "b", "c", "1,2-D"], None, []]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
