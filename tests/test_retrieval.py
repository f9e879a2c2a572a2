from evidentia.operators.retrieval import question_components

COMPONENTS = [(1, "烟酰胺", "NIACINAMIDE"), (2, "抗坏血酸", "ASCORBIC ACID"), (3, "生育酚（维生素E）", "TOCOPHEROL"), (4, "透明质酸", "HYALURONIC ACID"), (5, "透明质酸钠", "SODIUM HYALURONATE"), (6, "水", "WATER"), (7, None, "RETINOL"), (8, "视黄醇棕榈酸酯", "RETINYL PALMITATE")]
ALIASES = [("VC", 2, 0), ("维生素C", 2, 1), ("玻尿酸", 4, 2), ("玻尿酸", 5, 3), ("377", 8, 4)]


def found(spark, questions, most=3):
    rows = question_components(
        spark.createDataFrame(questions, "question_id long, question string"),
        spark.createDataFrame(ALIASES, "alias string, ingredient_id long, place int"),
        spark.createDataFrame(COMPONENTS, "ingredient_id long, cn_name string, inci_name string"),
        most,
    ).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.question_id, r["rank"])):
        out.setdefault(r.question_id, []).append((r.ingredient_id, r.stage))
    return out


def test_stages(spark):
    got = found(spark, [
        (1, "维生素C有用吗"), (2, "vc和烟酰胺能一起用吗"), (3, "玻尿酸好吗"), (4, "niacinamide or retinol?"), (5, "透明质酸钠"),
        (6, "tocoph"), (7, "棕榈酸"), (8, "nothing known"), (9, ""), (10, None), (11, "水"), (12, "377 and NIACINAMIDE and retinol and water"),
    ])
    assert got == {
        1: [(2, 1)], 2: [(2, 1), (1, 2)], 3: [(4, 1), (5, 1)], 4: [(1, 2), (7, 2)], 5: [(5, 2), (4, 2)],
        6: [(3, 3)], 7: [(8, 3)], 12: [(8, 1), (1, 2), (7, 2)],
    }


def test_no_rows(spark):
    assert found(spark, []) == {}
