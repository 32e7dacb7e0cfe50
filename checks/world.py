"""Inputs of the checks and the stage results derived from them.

Ship maps, routing results and the decision master are stage outputs that later
stages read, so each is written once to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.inputs import GIVEN, Inputs, given, key_of
from lanewise import params as P
from lanewise.operators import lanes, signals, whatif, zips
from lanewise.operators.rates import CARDS, RateCards
from lanewise.operators.scoring import expansion_score, remediation_score
from lanewise.operators.skew import shuffles_for
from lanewise.operators.shipmap import ship_map_for
from lanewise.operators.stock import fulfillable_fcs
from lanewise.plans import execution
from lanewise.sources.shared import saved_once

START, END = "2025-11-01", "2025-11-14"
RUN_DATE = "2025-11-15"
BACKLOG_START, BACKLOG_END = "2024-01-01", "2024-01-31"

# Thresholds under which every outcome occurs in the test data.
EXECUTION = P.ExecutionParams(
    service_threshold=0.5,
    backlog_threshold=0.25,
    zip_volume_floor=1,
    fc_switch_threshold=0.9,
    switch_for_inactive=True,
)

LANE_STAGES: dict[tuple, lanes.LaneStage] = {}
ROWS: dict[tuple, int] = {}


class World(Inputs):
    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in ROWS:
            ROWS[key] = max(given(spark, sf_dir, name).count() for name in GIVEN)
        shuffles_for(spark, ROWS[key])

    def saved(self, name: str, build) -> DataFrame:
        return saved_once(self.spark, key_of(self.sf_dir, f"stage/{name}"), build)

    @property
    def cards(self) -> RateCards:
        return RateCards(
            base_rates=self.base_rates,
            resi=self.resi,
            das=self.das,
            weight_bands=self.weight_bands,
            longest_bands=self.longest_bands,
            second_bands=self.second_bands,
            girth_bands=self.girth_bands,
            peak=self.peak,
            fuel=self.fuel,
            small=frozenset(CARDS),  # as RateCards.checked() finds them
        )

    def build_smap(self, scenario: str) -> DataFrame:
        return ship_map_for(
            scenario,
            self.ship_map_raw,
            START,
            END,
            eligible=self.eligible_lanes,
            removal=self.removal_zips,
        )

    def smap(self, scenario: str = "baseline") -> DataFrame:
        return self.saved(f"smap_{scenario}", lambda: self.build_smap(scenario))

    def build_candidates(self) -> DataFrame:
        return fulfillable_fcs(
            self.shipments,
            self.order_lines,
            self.inventory,
            START,
            END,
            candidate_fcs=P.FCS,
        )

    @property
    def candidates(self) -> DataFrame:
        return self.saved("candidates", self.build_candidates)

    def stage(self, name: str, build) -> lanes.LaneStage:
        """A package stage, written once for a session and its tables."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in LANE_STAGES:
            LANE_STAGES[key] = build()
        return LANE_STAGES[key]

    @property
    def lane_stage(self) -> lanes.LaneStage:
        """The stage of the candidate packages."""

        def build():
            packages = lanes.candidate_packages(self.candidates, self.shipments)
            return lanes.lane_stage(packages, self.shipments, self.cards)

        return self.stage("lanes", build)

    def build_routing_stage(self, shipments=None, cards=None) -> lanes.LaneStage:
        return lanes.routing_stage(
            self.shipments if shipments is None else shipments,
            self.order_lines,
            self.inventory,
            cards or self.cards,
            START,
            END,
        )

    def build_routing(self, scenario: str = "baseline") -> DataFrame:
        """One of the scenarios, which share their package stage."""
        stage = self.stage("routing", self.build_routing_stage)
        return lanes.routing_result(stage, self.smap(scenario), self.fc_zip_distance)

    def routing(self, scenario: str = "baseline") -> DataFrame:
        return self.saved(f"routing_{scenario}", lambda: self.build_routing(scenario))

    @property
    def base(self) -> DataFrame:
        return whatif.as_base(self.routing())

    @property
    def service(self) -> DataFrame:
        return signals.service_rate(self.service_failures, "2025-11-01", "2025-11-30")

    @property
    def backlog(self) -> DataFrame:
        return signals.zip_backlog(
            self.station_backlog,
            self.station_zip_a,
            self.station_zip_b,
            BACKLOG_START,
            BACKLOG_END,
        )

    @property
    def remediation_history(self) -> DataFrame:
        return self.recommendation_history.where(F.col("source") == "remediation")

    @property
    def expansion_history(self) -> DataFrame:
        return self.recommendation_history.where(F.col("source") == "expansion")

    @property
    def last(self) -> DataFrame:
        return signals.last_recommendation(
            self.remediation_history, self.expansion_history, RUN_DATE
        )

    @property
    def status(self) -> DataFrame:
        return zips.zip_status(self.smap(), self.smap("expansion"), END)

    def build_master(self) -> DataFrame:
        return execution.decision_master(
            self.status,
            self.base,
            self.routing("remediation"),
            self.service,
            self.backlog,
            self.last,
            EXECUTION,
            self.routing("expansion"),
        )

    @property
    def master(self) -> DataFrame:
        return self.saved("master", self.build_master)

    @property
    def runs(self) -> DataFrame:
        """Master of the latest run and of an earlier one without the ok zips."""
        run = F.lit(RUN_DATE).cast("date")
        earlier = self.master.where(F.col("current_recommendation") != "ok")
        return self.master.withColumn("run_date", run).unionByName(
            earlier.withColumn("run_date", F.date_sub(run, 1))
        )

    @property
    def remediation_scores(self) -> DataFrame:
        return self.saved("remediation_scores", lambda: remediation_score(self.base))

    @property
    def expansion_scores(self) -> DataFrame:
        return self.saved(
            "expansion_scores",
            lambda: expansion_score(
                self.base,
                self.routing("expansion"),
                self.smap(),
                self.smap("expansion"),
                0.9,
            ),
        )

    @property
    def chosen(self) -> DataFrame:
        """Zips of an outside list, every third one, to switch off."""
        return self.removal_list.where(F.col("zip_no") % 3 == 0).select("zip5")

    @property
    def removal_list(self) -> DataFrame:
        return self.smap().select(
            "zip5", F.col("zip5").cast("int").alias("zip_no")
        ).distinct()

    @property
    def spliced(self) -> DataFrame:
        return whatif.splice_scenario(
            self.base, [(self.routing("remediation"), self.chosen)]
        )
