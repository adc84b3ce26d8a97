from pyspark.sql import functions as F

from runloom.functions import coerce, names


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_number_text(spark):
    texts = [" 3 ", "1e2", ".5", "5.", "+4", "-0.25", "inf", "1_0", "1d", "2f", "nan", "1,5", "0x10", "", None, "abc"]
    want = [3.0, 100.0, 0.5, 5.0, 4.0, -0.25, float("inf")] + [None] * 9
    assert column(spark, texts, coerce.number) == want


def test_score_reads_a_decimal_comma_and_rounds_half_even(spark):
    texts = ["1,5", "2,5", "0.5", " 4 ", "None", "<NA>", "x"]
    assert column(spark, texts, coerce.score) == [1.5, 2.5, 0.5, 4.0, None, None, None]
    assert column(spark, texts[:3], lambda c: F.bround(coerce.score(c)).cast("int")) == [2, 2, 0]


def test_yes_no_lists_differ(spark):
    texts = ["Да", "истина", "y", "нет", "ложь", "1", "0", "0.5", "-1", "1,5", "", None]
    assert column(spark, texts, coerce.is_positive) == [True, True, True, False, False, True, False, True, False, False, False, False]
    assert column(spark, texts, coerce.indicator_flag) == [1, 0, 0, 0, 0, 1, 0, 1, 0, 0, 0, 0]
    assert column(spark, texts, coerce.cell_flag) == [1, 1, 0, 0, 0, 1, 0, 1, 1, 0, 0, 0]


def test_episode_ids(spark):
    texts = ["1", "A12", "12б", "ep_1", "ep_a", " 7 ", "", None, "A1B2"]
    assert column(spark, texts, coerce.is_episode_id) == [True, True, True, False, False, True, False, False, False]
    assert column(spark, texts, coerce.episode_number) == [1.0, 12.0, 12.0, 1.0, None, 7.0, None, None, 1.0]


def test_safe_text_and_defaults(spark):
    texts = [" a ", "nan", "None", "<NA>", "NaN", None, " x "]
    assert column(spark, texts, coerce.safe_text) == ["a", "", "", "", "NaN", "", "x"]
    assert column(spark, ["", None, "nan", " q "], coerce.sequence_or_default) == ["sequence_0"] * 3 + ["q"]


def test_lists(spark):
    assert column(spark, ['["b","a"]', "no", "", None, "3"], coerce.parse_list) == [["b", "a"], [], [], [], []]


def test_surrogate_id_shape(spark):
    found = column(spark, ["Иванов"], lambda c: coerce.surrogate_athlete_id(c, F.lit("48")))[0]
    assert found.startswith("ath_") and len(found) == 16


def test_headers():
    assert names.normal_columns([" A  b ", "a B", "", None, "x||y"]) == ["a b", "a b_2", "unknown_column", "unknown_column_2", "x|y"]


def test_dictionary_blocks_and_names():
    d = names.HeaderDictionary()
    assert len(d.entries) == 70
    assert d.find("Баллы") == ("outcomes__score", "outcomes")
    assert d.block_of("стойка и маневрирование (основные в эпизоде)") == "maneuvering"
    assert d.block_of("note") == "other"
    mapping = d.mapping(["фио борца", "баллы", "заметка", "стойка x"])
    assert [m[1] for m in mapping] == ["metadata__athlete_name", "outcomes__score", "other__f01", "maneuvering__f01"]


def test_two_id_headers_do_not_loop():
    found = [m[1] for m in names.HeaderDictionary().mapping(["номер эпизода a", "номер эпизода b"])]
    assert len(set(found)) == 2 and found[0] == "metadata__episode_id"


def test_resolver_prefers_earlier_candidates():
    assert names.resolve(["x_score", "Score"], ["score"]) == ("Score", "exact")
    assert names.resolve(["metadata__event_date"], ["metadata__event"]) == ("metadata__event_date", "substring")
    assert names.resolve(["a"], ["b"]) == (None, "missing")


def test_attribute_neighbours():
    cols = ["metadata__episode_attr_03", "metadata__episode_attr_01", "metadata__episode_attr_02"]
    assert names.neighbour_attribute(cols, "metadata__episode_attr_01", 2) == "metadata__episode_attr_03"
    assert names.neighbour_attribute(cols, "metadata__episode_attr_03", 1) is None


def test_braces_in_headers_are_text():
    d = names.HeaderDictionary()
    heads = ["kfv__{a}", "metadata__x{}", "metadata__{:02d}", "kfv__{block}", "{0} баллы {", "kfv__{a}"]
    found = [m[1] for m in d.mapping(heads)]
    assert found[:4] == heads[:4] and len(set(found)) == len(heads)
    assert [d.canonical(h, d.classify(h), 2) for h in heads[:4]] == heads[:4]


def test_repeated_headers_keep_apart():
    d = names.HeaderDictionary()
    found = [m[1] for m in d.mapping(["kfv__a", "kfv__a", "kfv__a", "номер эпизода a", "номер эпизода b", "номер эпизода c"])]
    assert found == ["kfv__a", "kfv__a_03", "kfv__a_04", "metadata__episode_id", "metadata__episode_id_03", "metadata__episode_id_04"]
    pinned = [m[1] for m in d.mapping(["x{}", "x{}"], {"x{}": "kfv"})]
    assert pinned == ["kfv__x{}", "kfv__x{}_03"]
