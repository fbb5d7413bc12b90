"""Golden rows computed by hand from the literal formulas (FIXTURES.md section 3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from floodspark.functions import device as DV
from floodspark.functions import parsing as PA
from floodspark.functions import physics as PH
from floodspark.functions import rules as R
from floodspark.operators import metrics as M
from floodspark.operators import joins as J
from floodspark.operators import labels as LB


def one(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_risk_score_and_level(spark):
    d = one(spark, [(120.0, 2.5, 0.15)], "precip_48h double, nivel_metros double, taxa_subida_m_h double")
    r = d.select(R.risk_score().alias("s"), R.alert_level(R.risk_score()).alias("lvl")).first()
    assert r["s"] == pytest.approx(0.49 / 1.51, abs=1e-9)
    assert r["lvl"] == 0


def test_flood_rule(spark):
    d = one(spark, [(120.0, 2.5, 0.15), (151.0, 0.0, 0.0), (0.0, 0.0, 0.0)],
            "precip_48h double, nivel_metros double, taxa_subida_m_h double")
    got = [r[0] for r in d.select(R.flood_rule()).collect()]
    assert got == [1, 1, 0]
    g = d.select(R.gated_rule_score()).first()[0]
    assert g == pytest.approx(0.32 + 0.21875 + 0.125)


def test_validation(spark):
    d = one(spark, [(744.0, 2.3, 0.15), (120.0, 2.5, 0.15)], "precip_48h double, nivel_metros double, taxa_subida_m_h double")
    assert [r[0] for r in d.select(R.valid_features()).collect()] == [False, True]


def test_mode_decision(spark):
    d = one(spark, [(0.60,), (0.99,)], "p double")
    rows = d.select(*[R.mode_level("p", F.lit(t)).alias(n) for n, t in
                      [("e", 0.05), ("u", 0.5), ("c", 0.8)]], R.confidence("p").alias("conf")).collect()
    assert (rows[0]["e"], rows[0]["u"], rows[0]["c"]) == (3, 2, 0)
    assert rows[0]["conf"] == pytest.approx(0.2)
    assert rows[1]["c"] == 2                     # 1.5 x 0.8 = 1.2 is unreachable


def test_soil_moisture(spark):
    d = one(spark, [(80.0, 25.0), (100.0, 100.0), (None, 10.0)], "humidity_pct double, precip_24h double")
    got = [r[0] for r in d.select(PH.soil_moisture()).collect()]
    assert got[0] == pytest.approx(68.0) and got[1] == pytest.approx(95.0) and got[2] is None


def test_hour_parse_rollover(spark):
    d = one(spark, [("2024/05/01", "2400 UTC"), ("2024/05/01", "100 UTC"), ("bad", "0100 UTC"), ("2024/05/01", "xx UTC")],
            "d string, h string")
    got = [r[0] for r in d.select(PA.parse_datetime("d", "h")).collect()]
    assert got[0] == dt.datetime(2024, 5, 2, 0, 0)
    assert got[1] == dt.datetime(2024, 5, 1, 1, 0)
    assert got[2] is None and got[3] is None


def test_decimal_comma(spark):
    d = one(spark, [("1,5",), ("n/a",), ("NaN",), ("",)], "t string")
    assert [r[0] for r in d.select(PA.decimal_comma("t")).collect()] == [1.5, None, None, None]


def test_interval_label(spark):
    readings = one(spark, [("Porto_Alegre", dt.datetime(2024, 5, 1, 0), 1), ("Porto_Alegre", dt.datetime(2024, 5, 2, 0), 2),
                           ("Porto_Alegre", dt.datetime(2024, 5, 3, 0), 3), ("Porto_Alegre", dt.datetime(2024, 5, 7, 0), 4),
                           ("Porto_Alegre", dt.datetime(2024, 4, 30, 23), 5), ("Porto_Alegre", dt.datetime(2024, 5, 7, 1), 6)],
                   "location string, datetime timestamp_ntz, seq long")
    events = one(spark, [(1, "Enchente PORTO_ALEGRE", dt.datetime(2024, 5, 4), 3)],
                 "event_no long, location_text string, date timestamp_ntz, duration_days int")
    got = {r["seq"]: (r["teve_enchente"], r["nivel_alerta"], r["tempo_ate_enchente"])
           for r in LB.flood_label(readings, events).collect()}
    assert got[1] == (1, 1, 72.0)
    assert got[2][:2] == (1, 2) and got[3][:2] == (1, 3) and got[4][:2] == (1, 3)
    assert got[5][:2] == (0, 0) and got[6][:2] == (0, 0)


def test_last_event_wins(spark):
    readings = one(spark, [("Pelotas", dt.datetime(2024, 5, 3, 0), 1)], "location string, datetime timestamp_ntz, seq long")
    events = one(spark, [(1, "pelotas", dt.datetime(2024, 5, 4), 3), (2, "Pelotas", dt.datetime(2024, 5, 5), 3)],
                 "event_no long, location_text string, date timestamp_ntz, duration_days int")
    r = LB.flood_label(readings, events).first()
    assert r["tempo_ate_enchente"] == 48.0 and r["nivel_alerta"] == 2


def test_event_detection(spark):
    base = dt.datetime(2024, 5, 1)
    rows24 = [("Porto_Alegre", base + dt.timedelta(hours=i), 3.5) for i in range(24)]
    rows25 = [("Santa_Maria", base + dt.timedelta(hours=i), 5.0) for i in range(25)]
    d = one(spark, rows24 + rows25, "location string, datetime timestamp_ntz, nivel_metros double")
    ev = LB.flood_events(d).collect()
    assert len(ev) == 1 and ev[0]["location"] == "Santa_Maria" and ev[0]["duration_days"] == 2
    assert ev[0]["severity"] == "medium" and ev[0]["date"] == "2024-05-01"


def test_power_mode(spark):
    d = one(spark, [(3.7, 0.0), (3.7, 5.1), (3.2, 0.0), (4.0, 0.0)], "battery_voltage double, solar_voltage double")
    assert [r[0] for r in d.select(DV.power_mode()).collect()] == ["ECONOMY", "NORMAL", "EMERGENCY", "NORMAL"]


def test_low_power_rule(spark):
    d = one(spark, [(4.5, 0.0)], "nivel_metros double, precipitation_mm double")
    r = d.select(R.emergency_alert().alias("a"), R.emergency_score().alias("s")).first()
    assert r["a"] == 3 and r["s"] == pytest.approx(0.6)


@pytest.mark.parametrize("tn,fp,fn,tp,prec,rec,f1,spec", [
    (850, 420, 2, 98, 0.1892, 0.98, 0.3172, 0.6693),
    (1150, 120, 8, 92, 0.4340, 0.92, 0.5897, 0.9055),
    (1230, 40, 15, 85, 0.6800, 0.85, 0.7556, 0.9685),
])
def test_binary_metrics_from_published_counts(spark, tn, fp, fn, tp, prec, rec, f1, spec):
    c = one(spark, [(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long")
    r = M.with_rates(c).first()
    assert round(r["precision"], 4) == prec and round(r["recall"], 4) == rec
    assert round(r["f1"], 4) == f1 and round(r["specificity"], 4) == spec


def test_step_lookup(spark):
    d = one(spark, [(p,) for p in (0, 49, 50, 74, 75, 90)], "p int")
    got = [r[0] for r in J.step_asof(d, "p").orderBy("p").select("intensidade").collect()]
    assert got == ["leve", "leve", "moderada", "moderada", "severa", "extrema"]


def test_name_match_picks_smallest(spark):
    texts = one(spark, [(1, "Cheia em S40 - RS"), (2, "nada aqui")], "id long, t string")
    names = one(spark, [("S4",), ("S40",), ("S5",)], "location string")
    got = {r["id"]: r["location"] for r in J.name_match(texts, names, "t", "id").collect()}
    assert got == {1: "S4"}
