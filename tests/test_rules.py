import pytest
from pyspark.sql import functions as F

from corpusloom.operators import rules


@pytest.fixture(scope="module")
def one(spark):
    return lambda c: spark.range(1).select(c).first()[0]


def test_only(spark):
    df = spark.createDataFrame([("a",), ("b",)], "name string")
    assert [r.name for r in rules.only(df, "name", ["b"], {"a", "b"}).collect()] == ["b"]
    assert rules.only(df, "name", [], {"a"}).count() == 2
    with pytest.raises(ValueError, match="unknown: x"):
        rules.only(df, "name", ["x"], {"a", "b"})
    with pytest.raises(ValueError, match="nothing"):
        rules.only(df, "name", ["c"], {"c"})


def test_filters(spark):
    lines = spark.createDataFrame([(" a ", 0.5), (" ", 0.9), ("b", 0.49), (None, 1.0)], "text string, confidence double")
    assert [r.text for r in rules.confident_lines(lines).collect()] == ["a"]
    comps = spark.createDataFrame([(1, 2, 12, 0.6, 3.0), (1, 1, 20, 0.9, 4.0), (1, 0, 11, 0.9, 4.0), (1, 3, 20, 0.5, 4.0), (1, 4, 20, 0.9, 2.0)], "map_id int, seed int, size int, score double, side double")
    assert sorted(r.seed for r in rules.sound_components(comps).collect()) == [1, 2]
    assert [r.seed for r in rules.sound_components(comps, most=1).collect()] == [1]
    pages = spark.range(1, 8).withColumnRenamed("id", "page_no")
    assert [r[0] for r in rules.page_range(pages, -1, 2).collect()] == [1, 2] and rules.page_range(pages, 6, 0).count() == 2


def test_scalars(one):
    lit = F.lit
    assert one(rules.note_for(lit(False), lit(True), lit(True))) == "pivoted" and one(rules.note_for(lit(True), lit(False), lit(True))) is None
    assert one(rules.fallback(lit("  "), lit("s"))) == "s" and one(rules.fallback(lit(None).cast("string"), lit("s"))) == "s"
    assert one(rules.translatable(lit(" "), lit("en"), lit("zh"))) == "" and one(rules.translatable(lit("x"), lit("en"), lit("zh"))) is None
    assert one(rules.without_special(F.array(lit("a"), lit("<s>"), lit(""), lit("<b")))) == ["a", "<b"]
    assert one(rules.detected(lit("ja"), lit("en"), lit("x"), ["en", "ja"])) == "ja" and one(rules.detected(lit("ko"), lit("en"), lit("x"), ["en", "ja"])) == "en"
    assert one(rules.looked_up(lit("q"), {"a": "b"}, "d")) == "d"
    assert one(rules.encoded(F.array(lit("a"), lit("z")), {"a": 4}, 1, 0)) == [4, 1, 0]
    assert [one(rules.round_to_32(lit(x))) for x in (1.0, 47.9, 48.0, 80.0)] == [32, 32, 64, 96]
    assert one(rules.clamped(lit(99999), 320, 2048)) == 2048 and one(rules.decode_limit(lit(10), lit(512))) == 38
    assert [one(rules.sample_size(lit(x), 2400)) for x in (100, 4799, 4800, 9700)] == [1, 1, 2, 4]
    assert one(rules.luminance(lit(0x00FFFFFF))) == 255
    assert one(rules.ordered_corners(F.array(*map(lit, [4.0, 2.0, 0.0, 0.0, 4.0, 0.0, 0.0, 2.0])))) == [0, 0, 4, 0, 4, 2, 0, 2]


def test_tables(spark, tmp_path):
    pix = spark.createDataFrame([(1, 0x000000), (1, 0xFFFFFF), (1, 0xFDFDFD)], "image_id int, argb int")
    assert rules.two_colours(pix).first().asDict() == {"image_id": 1, "ink": [0, 0, 0], "ground": [254, 254, 254]}
    paths = spark.createDataFrame([(f"f{i:02}",) for i in range(14)], "path string")
    assert rules.missing_summary(paths).first()[0].endswith("f11\n… and 2 more")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.bin").write_bytes(b"12345")
    assert tuple(rules.tree_size(spark, f"file://{tmp_path}").first()) == (1, 5)
    make = lambda: [tuple(r) for r in rules.mock_pairs(spark, [("{n} {item}s", "{item} {n}"), ("no {item}", "-")], [("cat", "chat")], 20, 3).collect()]
    assert make() == make() and len(set(make())) == 20
    scores = spark.createDataFrame([("b", 1.5, None), ("a", 2.0, 3.0)], "key string, m double, n double")
    text = rules.report(scores, spark.createDataFrame([("x|y", "z")], "source string, reference string"), ["m", "n"])
    assert text.splitlines()[2:4] == ["| a | 2.0 | 3.0 |", "| b | 1.5 | - |"] and "x\\|y" in text
    assert rules.roles(spark.createDataFrame([("e", "k")], "en string, ko string"), "ko", "en", True).first() == ("k", "e", True)
