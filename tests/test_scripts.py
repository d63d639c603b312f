"""Transliteration against a plain loop."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curata.functions import scripts

TABLE = {"sch": "ш", "ch": "х", "c": "ц", "h": "г", "s": "с", "ä": "", "😀": "(:", "a.": "!", "$1": "dollar", "\\": "/"}


def _same(spark, texts, table):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", scripts.transliterate(F.col("t"), table).alias("t")).collect()
    assert {r.i: r.t for r in rows} == {i: scripts.plain_transliterate(t, table) for i, t in enumerate(texts)}


def test_longest_entry_first(spark):
    _same(spark, [None, "", "schsch", "scsh", "äa.a", "😀😀x", "$1$", "a\\b", "\x01e\x01s\x01", "sch" * 50_000, "\n\r x"], TABLE)
    _same(spark, [None, "", "schä"], {})
    _same(spark, ["abcab"], {"a": "", "b": "y"})
    _same(spark, ["a\x02\x01\x02b\x03\x01"], {"\x02": "two", "a\x02": "x", "b": "\x01"})


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("schaä.😀$1\\e\x01 ", max_size=40), max_size=20))
def test_any_text(spark, texts):
    _same(spark, texts, TABLE)


def test_indic_scripts(spark):
    # "jal" (water) and "bhaat" with a nukta and a candra o, by the letters' names
    row = spark.createDataFrame([("जल", "भाॉ़त गर")], "a string, b string")
    got = row.select(*[scripts.spoken(F.col(c), lang).alias(f"{c}_{lang}") for c in "ab" for lang in ("hi", "te", "ta", "as", "bn", "gu")]).first()
    assert got.a_hi == "जल" and got.a_te == "జల్" and got.a_gu == "જલ" and got.a_bn == "জল"
    assert got.b_ta == "பாோத் கர்" and got.b_as == "ভাোত গৰ" and got.b_bn == "ভাোত গর"
    for script in set(scripts.SCRIPTS.values()):
        assert len(scripts.script_table(script)) >= 50
