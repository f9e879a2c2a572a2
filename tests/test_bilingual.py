import pytest

from evidentia.operators import bilingual

REGISTER = {
    "PARFUM": "香精", "FRAGRANCE": "（日用）香精", "TITANIUM DIOXIDE": "二氧化钛", "CI 77891": "CI 77891", "CERA ALBA": "白蜂蜡", "BEESWAX": "蜂蜡", "YEAST EXTRACT": "酵母提取物", "WATER": "水",
    "CAPRYLIC/CAPRIC TRIGLYCERIDE": "辛酸/癸酸甘油三酯", "BUTYROSPERMUM PARKII (SHEA) BUTTER": "牛油果树果脂", "GALACTOMYCES FERMENT FILTRATE": "半乳糖酵母样菌发酵产物滤液", "ROYAL JELLY": "蜂王浆", "ROYAL JELLY EXTRACT": "蜂王浆提取物",
    "ACACIA SENEGAL GUM": "阿拉伯胶树（ACACIA SENEGAL）胶", "UNDARIA PINNATIFIDA EXTRACT": "裙带菜提取物", "MEL": "蜂蜜", "HONEY": "蜂（Apis mellifera）蜜", "ALCOHOL DENAT.": "变性乙醇", "TRIDECETH-3": "十三烷醇聚醚-3", "TRIDECETH-12": "十三烷醇聚醚-12",
    "1,2-HEXANEDIOL": "1,2-己二醇", "HYDROGENATED POLY(C6-14 OLEFIN)": "氢化聚（C6-14 烯烃）", "HYDROGENATED POLY(C6-20 OLEFIN)": "氢化聚（C6-20 烯烃）", "CI 42090": "CI 42090", "BLUE 1": "蓝 1", "BLUE 1 LAKE": "蓝 1 色淀", "CERAMIDE AP": "神经酰胺 AP",
    "HYDROLYZED SILK": "水解蚕丝", "SILK": "蚕丝", "GLYCERIN": "甘油", "BUTYLENE GLYCOL": "丁二醇", "STEARETH 2 X": "甲", "STEARETH-2-X": "乙", "EDTA": "乙二胺四乙酸", "TRIETHANOLAMINE": "三乙醇胺",
}
CORRUPT = {"BEH ENETH-25": "山嵛醇聚醚-25"}
ALIASES = {"AVOBENZONE": "BUTYL METHOXYDIBENZOYLMETHANE", "CERAMIDE 6 II": "CERAMIDE AP"}
CASES = [
    ("BUTYROSPERMUM PARKII BUTTER/SHEA BUTTER", "BUTYROSPERMUM PARKII (SHEA) BUTTER", "slash-one"),
    ("FAEX EXTRACT/YEAST EXTRACT", "YEAST EXTRACT", "slash-one"),
    ("CI 77891/TITANIUM DIOXIDE", "TITANIUM DIOXIDE", "slash-ambiguous"),
    ("TITANIUM DIOXIDE/CI 77891", "TITANIUM DIOXIDE", "slash-ambiguous"),
    ("PARFUM/FRAGRANCE", "PARFUM", "slash-ambiguous"),
    ("CERA ALBA / BEESWAX", "CERA ALBA", "slash-ambiguous"),
    ("TITANIUM DIOXIDE (NANO)/TITANIUM DIOXIDE", "TITANIUM DIOXIDE", "slash-same"),
    ("CERA ALBA / BEESWAX / CIRE DABEILLE", "CERA ALBA", "slash-ambiguous"),
    ("MEL/HONEY/MIEL", "MEL", "slash-ambiguous"),
    ("FRAGRANCE (PARFUM)", "FRAGRANCE", "paren-ambiguous"),
    ("TITANIUM DIOXIDE (CI 77891)", "TITANIUM DIOXIDE", "paren-ambiguous"),
    ("CI 77891 (TITANIUM DIOXIDE)", "TITANIUM DIOXIDE", "paren-ambiguous"),
    ("TITANIUM DIOXIDE (NANO)", "TITANIUM DIOXIDE [NANO]", "paren-nano"),
    ("PITERA (GALACTOMYCES FERMENT FILTRATE)", "GALACTOMYCES FERMENT FILTRATE", "paren-inner"),
    ("BUTYROSPERMUM PARKII (SHEA BUTTER)", "BUTYROSPERMUM PARKII (SHEA) BUTTER", "paren-shift"),
    ("WATER (LA ROCHE-POSAY PREBIOTIC THERMAL WATER)", "WATER", "paren-main"),
    ("SILK (HYDROLYZED)", "HYDROLYZED SILK", "paren-process"),
    ("CAPRYLIC/CAPRIC TRIGLYCERIDE", "CAPRYLIC/CAPRIC TRIGLYCERIDE", None),
    ("EUCHEUMA SERRA/SACCHARINA ANGUSTATA/UNDARIA PINNATIFIDA EXTRACT", "EUCHEUMA SERRA/SACCHARINA ANGUSTATA/UNDARIA PINNATIFIDA EXTRACT", None),
    ("CAPRYLIC/CAPRIC/MYRISTIC/STEARIC TRIGLYCERIDE", "CAPRYLIC/CAPRIC/MYRISTIC/STEARIC TRIGLYCERIDE", None),
    ("SACCHARINA ANGUSTATA/UNDARIA PINNATIFIDA EXTRACT", "SACCHARINA ANGUSTATA/UNDARIA PINNATIFIDA EXTRACT", None),
    ("ACACIA SENEGAL/ACACIA SENEGAL GUM", "ACACIA SENEGAL/ACACIA SENEGAL GUM", None),
    ("ROYAL JELLY / ROYAL JELLY EXTRACT", "ROYAL JELLY / ROYAL JELLY EXTRACT", None),
    ("PPG-7/PEG-30 PHYTOSTEROL", "PPG-7/PEG-30 PHYTOSTEROL", None),
    ("IRON OXIDES (CI 77491),IRON OXIDES (CI 77492)", "IRON OXIDES (CI 77491),IRON OXIDES (CI 77492)", None),
    ("ANTHEMIS NOBILIS (CHAMOMILE)", "ANTHEMIS NOBILIS (CHAMOMILE)", None),
    ("SILK (FERMENTED)", "SILK (FERMENTED)", None),
    ("ORANGE 5 LAKE (CI 77891)", "ORANGE 5 LAKE (CI 77891)", None),
    ("(PALMITIC ACID/GLYCERIN) DEXTRIN", "(PALMITIC ACID/GLYCERIN) DEXTRIN", None),
    ("TRIDECETH 3", "TRIDECETH-3", "punct-collapse"),
    ("1.2-HEXANEDIOL", "1,2-HEXANEDIOL", "punct-collapse"),
    ("TRIDECETH 99", "TRIDECETH 99", None),
    ("STEARETH 2-X", "STEARETH 2-X", None),
    ("BEHENETH-25", "BEHENETH-25", None),
    ("EDTA 二钠", "EDTA 二钠", None),
    ("CL 42090 BLUE 1", "BLUE 1", "cl-typo+ci-dual"),
    ("CI 42090 BLUE 1 LAKE", "BLUE 1 LAKE", "ci-dual"),
    ("CL 42090", "CI 42090", "cl-typo"),
    ("CL 99999 FOO", "CL 99999 FOO", None),
    ("CI 42090 MYSTERY", "CI 42090 MYSTERY", None),
    ("avobenzone", "BUTYL METHOXYDIBENZOYLMETHANE", "usan-alias"),
    ("CERAMIDE 6-II", "CERAMIDE AP", "usan-alias-collapse"),
    ("TRIETHANOLAMINE.", "TRIETHANOLAMINE", None),
    ("GLYCERIN (F.I.L. D12345/1)", "GLYCERIN", "fil"),
    ("TITANÏUM DIOXIDE (NANO) (CODE F.I.L.: X/2)", "TITANIUM DIOXIDE [NANO]", "fil+paren-nano"),
    ("⚫GLYCERIN*", "GLYCERIN", None),
    ("WATER\\AQUA\\EAU", "WATER", None),
    (None, "", None),
    ("", "", None),
]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(k, v, i, k in CORRUPT) for i, (k, v) in enumerate({**REGISTER, **CORRUPT}.items())]
    return spark.createDataFrame(rows, "key string, cn_name string, place int, corrupt boolean"), spark.createDataFrame(list(ALIASES.items()), "alias string, key string")


def test_rules_and_guards(spark, tables):
    names = spark.createDataFrame([(name,) for name, _, _ in CASES], "name string")
    found = {r["name"]: (r["resolved"], r["rule"]) for r in bilingual.resolve_bilingual(names, *tables).collect()}
    assert {name: found[name] for name, _, _ in CASES} == {name: (resolved, rule) for name, resolved, rule in CASES}
    tags = {part for _, _, rule in CASES if rule for part in [rule]}
    assert set(bilingual.RULES) - tags == {"slash-same-cn"}


def test_same_chinese_name_at_slashes(spark, tables):
    register = spark.createDataFrame([("SODIUM CHLORIDE", "氯化钠", 0, None), ("SEA SALT", "氯化钠", 1, None)], "key string, cn_name string, place int, corrupt boolean")
    found = bilingual.resolve_bilingual(spark.createDataFrame([("SEA SALT/SODIUM CHLORIDE",)], "name string"), register, tables[1]).first()
    assert (found["resolved"], found["rule"]) == ("SEA SALT", "slash-same-cn")


def test_forms_of_the_register(spark, tables):
    asked = ["ALCOHOL DENAT", "ALCOHOL DENAT.", "XY-UNKNOWN", "HYDROGENATED POLY", "HYDROGENATED POLY(C6-20 OLEFIN)", "butyrospermum  parkii butter", "1-2-HEXANEDIOL", "TITANIUM DIOXIDE [NANO]"]
    found = {r["name"]: r["key"] for r in bilingual.register_keys(spark.createDataFrame([(x,) for x in asked], "name string"), tables[0]).collect()}
    assert found == {
        "ALCOHOL DENAT": "ALCOHOL DENAT.", "ALCOHOL DENAT.": "ALCOHOL DENAT.", "HYDROGENATED POLY(C6-20 OLEFIN)": "HYDROGENATED POLY(C6-20 OLEFIN)", "butyrospermum  parkii butter": "BUTYROSPERMUM PARKII (SHEA) BUTTER",
        "1-2-HEXANEDIOL": "1,2-HEXANEDIOL", "TITANIUM DIOXIDE [NANO]": "TITANIUM DIOXIDE",
    }


def cleaned(spark, tables, rows):
    """Components after merging, filling and cleaning, by name; and the moves."""
    components = spark.createDataFrame(rows, "ingredient_id long, inci_name string, cn_name string")
    keepers, moves = bilingual.merge_names(components, bilingual.resolve_bilingual(components.selectExpr("inci_name AS name"), *tables))
    return bilingual.fill_names(keepers, tables[0]), moves


def test_merging_filling_and_cleaning(spark, tables):
    rows = [
        (1, "PARFUM/FRAGRANCE", "PARFUM/FRAGRANCE"), (2, "PARFUM", "PARFUM"), (3, "FRAGRANCE (PARFUM) X", None), (4, "glycerin*", "丙三醇（手工）"), (5, "GLYCERIN", None), (6, "XY-NEW ->", "XY-NEW ->"),
        (7, "CI 77891 [NANO]", "x"), (8, "BUTYLENE GLYCOL", "丁二醇^ []"), (9, "CAPRYLIC/CAPRIC TRIGLYCERIDE", None),
    ]
    found, moves = cleaned(spark, tables, rows)
    got = {r["ingredient_id"]: (r["inci_name"], r["cn_name"], r["n_merged"]) for r in found.collect()}
    assert got == {
        2: ("PARFUM", "香精", 1), 3: ("FRAGRANCE (PARFUM) X", "FRAGRANCE (PARFUM) X", 0), 5: ("glycerin", "丙三醇（手工）", 1), 6: ("XY-NEW", "XY-NEW", 0),
        7: ("CI 77891 [NANO]", "CI 77891", 0), 8: ("BUTYLENE GLYCOL", "丁二醇", 0), 9: ("CAPRYLIC/CAPRIC TRIGLYCERIDE", "辛酸/癸酸甘油三酯", 0),
    }
    assert {r["ingredient_id"]: r["keeper_id"] for r in moves.collect() if r["ingredient_id"] != r["keeper_id"]} == {1: 2, 4: 5}
    # once more: nothing changes
    again, _ = cleaned(spark, tables, [(k, name, cn) for k, (name, cn, _) in got.items()])
    assert {r["ingredient_id"]: (r["inci_name"], r["cn_name"]) for r in again.collect()} == {k: v[:2] for k, v in got.items()}
    assert not any(r["filled"] for r in again.collect())


def test_links_follow_and_count_once(spark, tables):
    links = spark.createDataFrame([(10, 1, 3), (10, 2, 5), (11, 1, 1), (12, 4, 2), (12, 9, 1)], "product_id long, ingredient_id long, position int")
    found, moves = cleaned(spark, tables, [(1, "PARFUM/FRAGRANCE", None), (2, "PARFUM", None), (4, "GLYCERIN", None), (9, "MYSTERY", None)])
    moved = bilingual.repoint_links(links, moves)
    assert sorted(map(tuple, moved.collect())) == [(10, 2, 5), (11, 2, 1), (12, 4, 2), (12, 9, 1)]
    assert tuple(bilingual.coverage(found, moved).first()) == (3, 2, 4, 3)
    assert tuple(bilingual.coverage(found.where("ingredient_id < 0"), moved).first()) == (0, 0, 0, 0)
