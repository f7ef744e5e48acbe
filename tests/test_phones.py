from pyspark.sql import functions as F
from weftline.functions import normalize, phones


def test_numbers_against_the_plan(spark):
    given = {
        "+91 98765-43210": "+919876543210", "00919876543210": "+919876543210", "(987)6543210": None, "9876543210": None, "+1 (555) 111-2222": "+15551112222", "+1 555 111 222": None, "+1 555 111 22223": None,
        "+49 30 123456": "+4930123456", "+44 20 7946 0958": "+442079460958", "+353 1 234 5678": "+35312345678", "+0 123 456 789": None, "+999 1234567": None, "+283 1234567": None, "+65 6123 4567": "+6561234567", "+65 612 345": None, "+679 123 4567": "+6791234567", "+1": None, "": None, None: None,
    }
    d = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string").orderBy("i")
    assert [r[0] for r in d.select(normalize.phone_e164(F.col("x"))).collect()] == list(given.values())


def test_each_beginning_finds_the_longest_code():
    table = phones.plan()
    assert len(table) == 1000 and table[:100] == [0] * 100
    for n in range(100, 1000):
        of = [c for c in phones.LENGTHS if f"{n:03d}".startswith(str(c))]
        assert len(of) <= 1 and (not of or table[n] == 10000 * len(str(of[0])) + 100 * phones.LENGTHS[of[0]][0] + phones.LENGTHS[of[0]][1])


def test_values_are_cleaned_once(spark):
    """Lambda functions compute an expression as often as it is written."""
    from pyspark.sql import functions as F
    from weftline.functions import normalize

    written = {f.__name__: str(f(F.col("x"))).count("regexp_replace(x,") for f in (normalize.date_ym, normalize.phone_e164, normalize.url)}
    assert written == {"date_ym": 1, "phone_e164": 1, "url": 1}
