"""Text functions and rule labelling."""

from casework import lexicon
from casework.functions import text as T
from casework.operators import features as FE
from casework.operators import labels as L

from .conftest import rows


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "t string").select(col.alias("x")).first()["x"]


def test_contractions_straight_vs_curly(spark):
    assert one(spark, T.clean_text("t"), "I can't log in, it's broken") == "i cannot log in, it is broken"
    # a curly apostrophe is not in the map: it becomes a space
    assert one(spark, T.clean_text("t"), "I can’t log in") == "i can t log in"


def test_clean_keeps_allowed_punctuation(spark):
    assert one(spark, T.clean_text("t"), "  Héllo,\tWORLD!! (x) a-b?  ") == "h llo, world!! x a-b?"


def test_clean_tokens_equal_tokens_of_cleaned_text(spark):
    texts = ["I can't log in, it's BROKEN_now x9 a", "\u212aelvin \u0130stanbul caf\u00e9 na\u00efve",
             "  Don't  WON'T\tshe'll  ", "", None, "a b c", "12 345 x_y_z 'quoted' wasn't-it"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows(df, T.tokens(T.clean_text("t")).alias("a"), T.clean_tokens("t").alias("b"))
    assert all(a == b for a, b in got)
    assert got[1][1] == ["elvin", "stanbul", "caf", "na", "ve"]


def test_tokens_and_stop_words_and_bigrams(spark):
    df = spark.createDataFrame([("The ATM and the card of mine: a b cd",)], "t string")
    toks = T.tokens("t")
    r = df.select(toks.alias("a"), T.drop_words(toks, ["the", "and", "of"]).alias("b"),
                  T.bigrams(T.drop_words(toks, ["the", "and", "of"])).alias("c")).first()
    assert r["a"] == ["the", "atm", "and", "the", "card", "of", "mine", "cd"]
    assert r["b"] == ["atm", "card", "mine", "cd"]
    assert r["c"] == ["atm card", "card mine", "mine cd"]


def test_bigrams_short_inputs(spark):
    df = spark.createDataFrame([([],), (["x"],), (["x", "y"],)], "a array<string>")
    assert [r[0] for r in df.select(T.bigrams("a")).collect()] == [[], [], ["x y"]]


def test_spark_stop_words_loaded_without_jvm():
    sw = FE.stop_words()
    assert "the" in sw and len(sw) > 100


def test_severity_flags_then_keywords(spark):
    data = [("Yes", "No", "x"), ("yes", "Yes", "x"), ("No", "no", "x"), ("No", "Yes", "my card was stolen"),
            ("", "", "they never answered"), (None, None, "all fine")]
    df = spark.createDataFrame(data, "d string, t string, x string")
    out = rows(df.select(L.derive_severity("x", "d", "t")))
    assert [r[0] for r in out] == ["critical", "high", "medium", "critical", "medium", "low"]


def test_emotion_tiers_in_order(spark):
    df = spark.createDataFrame([("a SCAM and terrible",), ("terrible service",), ("I am confused",),
                                ("please help",), ("nothing",)], "x string")
    assert [r[0] for r in df.select(L.derive_emotion("x")).collect()] == [
        "angry", "frustrated", "confused", "anxious", "frustrated"]


def test_map_category_drops_unmapped(spark):
    df = spark.createDataFrame([("Mortgage",), ("Credit card",), ("Unknown thing",), (None,)], "p string")
    out = sorted(rows(L.map_category(df, "p"), "p", "category"))
    assert out == [("Credit card", "FRAUD_DETECTION"), ("Mortgage", "UX_ISSUES")]
    assert len(lexicon.CATEGORY_MAP) == 23


def test_fill_labels_supplied_win_blank_predicted_else_default(spark):
    df = spark.createDataFrame([("ATM_FAILURE", " ", None, "high", "angry"),
                                ("", "", "", None, None)],
                               "category string, severity string, emotion string, ps string, pe string")
    out = rows(L.fill_labels(df, {"severity": "ps", "emotion": "pe"}), "category", "severity", "emotion")
    assert out == [("ATM_FAILURE", "high", "angry"), ("UNKNOWN", "medium", "neutral")]


def test_separators_count_as_white_space(spark):
    from casework.functions import text as T
    df = spark.createDataFrame([("a\x1cb",), ("\x1f a b \x1d",)], "t string")
    got = [tuple(r) for r in df.select(T.word_count("t"), T.py_strip("t")).collect()]
    assert got == [(len(t.split()), t.strip()) for t in ("a\x1cb", "\x1f a b \x1d")]
