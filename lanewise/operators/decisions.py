"""Reasons to decisions: what the signals say today, and what becomes of it given
the last decision.  All rules are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise import params as P

KINDS = ("dea", "shutdown", "backlog")
SWITCHES = ("activate", "deactivate")


def _decision(recommendation, dea=P.NONE, shutdown=P.NONE, backlog=P.NONE) -> Column:
    """A recommendation with its three reasons."""
    named = {
        "recommendation": recommendation,
        "dea": dea,
        "shutdown": shutdown,
        "backlog": backlog,
    }
    return F.struct(
        *(
            (v if isinstance(v, Column) else F.lit(v)).alias(name)
            for name, v in named.items()
        )
    )


def current_decision(dea: Column, shutdown: Column, backlog: Column) -> Column:
    """Decision of the signals, with only the deciding reason kept.

    A switch is taken from shutdown, then service, then backlog; an 'ok' from
    service, then shutdown, then backlog.
    """
    reasons = {"shutdown": shutdown, "dea": dea, "backlog": backlog}
    chain = F
    for kind in ("shutdown", "dea", "backlog"):
        reason = reasons[kind]
        chain = chain.when(
            reason.isin(*SWITCHES), _decision(reason, **{kind: reason})
        )
    for kind in ("dea", "shutdown", "backlog"):
        chain = chain.when(reasons[kind] == "ok", _decision("ok", **{kind: "ok"}))
    return chain.otherwise(_decision(P.NONE))


def last_in_effect(active: Column, last: Column, reasons: dict) -> Column:
    """The last decision as far as the network shows that it was carried out.

    A decision the current status contradicts never happened: it counts as
    none, or, if it was itself a return to normal, as the decision before it.
    """
    returned = F.lit(True)
    for kind in KINDS:
        returned = returned & F.coalesce(reasons[kind] == "ok", F.lit(False))
    undone_on = (active == 0) & (last == "activate")
    undone_off = (active == 1) & (last == "deactivate")
    return (
        F.when(undone_on & returned, _decision("deactivate"))
        .when(undone_off & returned, _decision("activate"))
        .when(undone_on | undone_off, _decision(P.NONE))
        .otherwise(_decision(last, **reasons))
    )


def final_decision(current: Column, last: Column) -> Column:
    """Decision to carry out, from today's and the last one in effect."""
    previous, today = last["recommendation"], current["recommendation"]
    returned = (
        (last["dea"] == "ok") & (last["shutdown"] == "ok") & (last["backlog"] == "ok")
    )
    back = {"dea": "ok", "shutdown": "ok", "backlog": "ok"}
    return (
        F.when(
            (previous == "deactivate") & (last["dea"] == "deactivate"),
            _decision(P.NONE),
        )
        .when(today.isin(*SWITCHES), current)
        .when(previous.isin(*SWITCHES) & returned, _decision(P.NONE))
        .when((today == "ok") & (previous == "activate"), _decision("deactivate", **back))
        .when((today == "ok") & (previous == "deactivate"), _decision("activate", **back))
        .otherwise(_decision(P.NONE))
    )


def _spread(df: DataFrame, decision: str, prefix: str) -> DataFrame:
    return df.withColumns(
        {
            f"{prefix}_recommendation": F.col(f"{decision}.recommendation"),
            **{f"{prefix}_reason_{k}": F.col(f"{decision}.{k}") for k in KINDS},
        }
    ).drop(decision)


def add_current_decision(df: DataFrame) -> DataFrame:
    """Add the current recommendation; a reason column that is missing means none."""
    reasons = (
        F.col(f"reason_code_{k}") if f"reason_code_{k}" in df.columns else F.lit(P.NONE)
        for k in KINDS
    )
    return _spread(df.withColumn("_current", current_decision(*reasons)), "_current", "current")


def add_final_decision(df: DataFrame) -> DataFrame:
    """Add the final recommendation from the current and last columns."""
    last = last_in_effect(
        F.col("active"),
        F.col("last_recommendation"),
        {k: F.col(f"last_reason_{k}") for k in KINDS},
    )
    current = _decision(
        F.col("current_recommendation"),
        **{k: F.col(f"current_reason_{k}") for k in KINDS},
    )
    decided = df.withColumn("_last", last).withColumn("_today", current)
    decided = decided.withColumn(
        "_final", final_decision(F.col("_today"), F.col("_last"))
    )
    return _spread(decided, "_final", "final").drop("_last", "_today")
