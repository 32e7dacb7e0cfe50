"""The decision rules against their truth tables, over every combination."""

from itertools import product

from pyspark.sql import functions as F

from lanewise.operators import decisions

NONE3 = ("None", "None", "None")
OK3 = ("ok", "ok", "ok")


def expected_final(active, current, last, reasons):
    """The two tables of the survey, row by row."""
    today, today_reasons = current
    all_ok = reasons == OK3
    if (active, last) in ((0, "activate"), (1, "deactivate")):
        other = {"activate": "deactivate", "deactivate": "activate"}
        last, reasons = (other[last] if all_ok else "None"), NONE3
    if last == "deactivate" and reasons[0] == "deactivate":
        return ("None", *NONE3)
    if today in ("activate", "deactivate"):
        return (today, *today_reasons)
    if last in ("activate", "deactivate") and reasons == OK3:
        return ("None", *NONE3)
    if today == "ok" and last == "activate":
        return ("deactivate", *OK3)
    if today == "ok" and last == "deactivate":
        return ("activate", *OK3)
    return ("None", *NONE3)


def test_final_decision_table(spark):
    currents = [
        ("activate", ("None", "None", "activate")),
        ("deactivate", ("deactivate", "None", "None")),
        ("ok", ("ok", "None", "None")),
        ("None", NONE3),
    ]
    lasts = ["activate", "deactivate", "None"]
    reasons = [OK3, ("deactivate", "None", "None"), ("None", "None", "deactivate"), NONE3]
    cases = list(product((0, 1), currents, lasts, reasons))
    df = spark.createDataFrame(
        [
            (i, active, cur, *cr, last, *lr)
            for i, (active, (cur, cr), last, lr) in enumerate(cases)
        ],
        ["i", "active", "current_recommendation"]
        + [f"current_reason_{k}" for k in decisions.KINDS]
        + ["last_recommendation"]
        + [f"last_reason_{k}" for k in decisions.KINDS],
    )
    columns = ["final_recommendation", *(f"final_reason_{k}" for k in decisions.KINDS)]
    found = {
        r["i"]: tuple(r[c] for c in columns)
        for r in decisions.add_final_decision(df).collect()
    }
    for i, case in enumerate(cases):
        assert found[i] == expected_final(*case), case


def expected_current(dea, shutdown, backlog):
    switches = ("activate", "deactivate")
    for kind, reason in (("shutdown", shutdown), ("dea", dea), ("backlog", backlog)):
        if reason in switches:
            return reason, kind
    for kind, reason in (("dea", dea), ("shutdown", shutdown), ("backlog", backlog)):
        if reason == "ok":
            return "ok", kind
    return "None", None


def test_current_decision_table(spark):
    values = ("activate", "deactivate", "ok", None)
    cases = list(product(values, values, values))
    df = spark.createDataFrame(
        [(i, *case) for i, case in enumerate(cases)],
        "i int, reason_code_dea string, reason_code_shutdown string, "
        "reason_code_backlog string",
    )
    for r in decisions.add_current_decision(df).collect():
        decision, kind = expected_current(*cases[r["i"]])
        assert r["current_recommendation"] == decision
        for k in decisions.KINDS:
            wanted = decision if k == kind else "None"
            assert r[f"current_reason_{k}"] == wanted


def test_missing_reason_column_counts_as_none(spark):
    df = spark.range(1).withColumn("reason_code_dea", F.lit("ok"))
    row = decisions.add_current_decision(df).first()
    assert row["current_recommendation"] == "ok"
    assert row["current_reason_shutdown"] == "None"
