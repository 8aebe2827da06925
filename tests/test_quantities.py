import random

import pytest

from spanloom.operators.quantities import VOWELS, Aliases, common_units, read_quantity, weighted_distance


CASES = [
    ("910 mg", None, "en", ("mass", 910_000)), ("3.956 kg", None, "de", ("mass", 3_956_000_000_000)), ("3.956 kg", None, "en", ("mass", 3_956_000_000)), ("8 824,6 mm", None, "fr", ("length", 8_824_600)), ("1,862", '{"value": 1.862, "unit": "gramas"}', "PT", ("mass", 1_862_000)),
    ("34,7°C", None, "pt", ("temperature", 3470)), ("101.3 °F", None, "en", ("temperature", 3850)), ("287 K", None, "en", ("temperature", 1385)), ("3 kg 400 g", None, "en", ("mass", 3_400_000_000)), ("5'11\"", None, "en", ("length", 1_803_400)),
    ("2 h 31 min", None, "en", ("duration", 9_060_000)), ("2h07m", None, "en", ("duration", 7_620_000)), ("one hundred and twenty gallons", None, "en", ("volume", 454_249_414)), ("½ L", None, "en", ("volume", 500_000)), ("1 1/2 miles", None, "en", ("length", 2_414_016_000)),
    ("7.0k kg", None, "en", ("mass", 7_000_000_000_000)), ("2.5 MiB", None, "en", ("data", 2_621_440)), ("44.１小时", None, "zh", ("duration", 158_760_000)), ("824", "824inches", "en", ("length", 20_929_600)), ("k﻿g", "5", "en", ("mass", 5_000_000_000)),
    ("2.2046226218 kg", None, "en", ("mass", 2_204_622_622)), ("0.123456789 g", None, "en", ("mass", 123_457)), (None, '{"value": 0.30000000000000004, "unit": "kg"}', "en", ("mass", 300_000_000)), ("0.1234567891 kg 5 g", None, "en", ("mass", 128_456_789)),
    ("0.0000005 g", None, "en", ("mass", 1)), ("-0.5 °C", None, "en", ("temperature", -50)), ("0.00000049999999999999999999 g", None, "en", ("mass", 0)), ("12345678901234567890123 t", None, "en", None), (None, '{"value": "1e999999", "unit": "kg"}', "en", None), ("3 lbbs", None, "en", ("mass", 1_360_777_110)), ("5 tins", None, "en", None),
    ("9.721 litros", "9721", None, ("volume", 9_721_000_000)), ("5 kilograams", None, "en", ("mass", 5_000_000_000)), ("a few kilos", "3 kg", "en", None), ("60 %", "60 kg", "en", None), ("12 boxes", "12 kg", "en", None), ("37", "37", "hi", None), (None, None, None, None), ("", "n/a", "en", None), ("5 kg", "{bad", "en", ("mass", 5_000_000_000)), ("much less", None, "en", None),
]


def test_amounts(spark):
    df = spark.createDataFrame([(k, *case[:3]) for k, case in enumerate(CASES)], "extraction_id int, extraction_text string, normalized string, lang string")
    got = {r.id: (r.dimension, r.amount) for r in common_units(df).collect()}
    assert [(case, got.get(k)) for k, case in enumerate(CASES) if got.get(k) != case[3]] == []


def test_aliases_and_distance():
    a = Aliases()
    assert a.look_up("K") != a.look_up("kg") and a.look_up("Liters") == a.look_up("l") and a.look_up("tablets") is None and a.look_up("xyzzy") is None
    assert weighted_distance("kilograams", "kilograms", 1) == 0.5 and weighted_distance("abcdef", "uvwxyz", 1) == float("inf")


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "5 kg", None, None, "clash"), (2, "5 kg", None, "en", "x"), (2, "5 kg", None, "en", "x"), (3, "9" * 5000 + " kg", "x" * 9000, "en", None)], "extraction_id long, extraction_text string, normalized string, lang string, amount string")
    got = common_units(df)
    assert [tuple(r) for r in got.collect()] == [(2, "mass", 5_000_000_000)]
    assert common_units(df.limit(0)).count() == 0
    assert read_quantity("5 kg and 3", None, "en") == []


def test_the_index_loses_no_near_name():
    rng = random.Random(2)
    a = Aliases()
    names = [n for n in a.lower if len(n) >= 3]
    for _ in range(200):
        s = rng.choice(names)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(max(1, len(s) - 1))
            s = rng.choice([s[:i] + s[i] + s[i:], s[:i] + s[i + 1 : i + 2] + s[i] + s[i + 2 :], s[:i] + rng.choice("aeiou") + s[i + 1 :], s[:i] + s[i + 1 :]])
        if len(s) < 3:
            continue
        most = 0.5 if len(s) < 5 else 1.0 if len(s) < 8 else 2.0
        want = {(d, n) for n in names if (d := weighted_distance(s, n, 99, VOWELS if len(s) >= 5 else "")) <= most}
        assert set(a.near(s)) == want, s
