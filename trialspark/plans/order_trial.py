"""Trial domains derived from order-processing tables.

Customers are subjects, nations are sites, orders are doses, returned line items are adverse
events, page views are measurements, and the last order decides the disposition. The mapping
lets every operator run on star-schema tables of any size.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trialspark import schema as S
from trialspark.functions import (
    arm_text, band, bmi, indicator, iso_text, padded, recode, shift_days, visit_text, yn_flag,
)
from trialspark.operators.adam import build_adae, build_adsl
from trialspark.operators.numbering import numbered, sequence_within
from trialspark.operators.prep import model_frame
from trialspark.operators.rows import population, with_constants
from trialspark.operators.scoring import score_by_rule
from trialspark.operators.skew import LargeGroups, large_groups

STUDY, DRUG = "TRIAL-01", "DRUG"
FEMALE_SEGMENTS = ["BUILDING", "FURNITURE", "HOUSEHOLD"]
RACE_BY_SEGMENT = {
    "AUTOMOBILE": "WHITE",
    "BUILDING": "BLACK OR AFRICAN AMERICAN",
    "FURNITURE": "ASIAN",
    "HOUSEHOLD": "AMERICAN INDIAN OR ALASKA NATIVE",
}
REGION_CODE = {"EUROPE": 1, "ASIA": 2}
ALT_TERMS = ["ECONOMY"]
NEURO_GI_TERMS = ["SMALL", "MEDIUM"]
REMOTE_SITES = ("7", "8")
HORIZON = 2000
# Schemas of the tables read here; declaring them saves a job per table.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}
STATUS_TERM = {"F": "COMPLETED", "O": "WITHDRAWAL BY SUBJECT", "P": "LOST TO FOLLOW-UP"}


def _day(column: str) -> Column:
    return F.col(column).cast("date")


class OrderTrial:
    """Lazily built domains of the tables in one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            reader = self.spark.read.schema(TABLES[name])
            self._tables[name] = reader.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def subjects(self) -> DataFrame:
        """Customers with site, country and region, before randomisation."""
        place = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return self.table("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))

    @cached_property
    def dm(self) -> DataFrame:
        spans = self.table("orders").groupBy(F.col("o_custkey").alias("USUBJID")).agg(
            iso_text(F.min(_day("o_orderdate"))).alias("RFSTDTC"),
            iso_text(F.max(_day("o_orderdate"))).alias("RFENDTC"),
        )
        key, balance, segment = F.col("c_custkey"), F.col("c_acctbal"), F.col("c_mktsegment")
        share = (balance + 1000) / 11000
        placed = numbered(self.subjects, ["c_nationkey"], ["c_custkey"], "__n")
        people = placed.select(
            key.alias("USUBJID"),
            padded(F.col("__n")).alias("SUBJID"),
            F.col("c_nationkey").cast("string").alias("SITEID"),
            F.col("n_name").alias("COUNTRY"),
            F.col("r_name").alias("REGION"),
            F.floor(share * 46 + 25).cast("int").alias("AGE"),
            F.when(segment.isin(*FEMALE_SEGMENTS), "F").otherwise("M").alias("SEX"),
            recode(segment, RACE_BY_SEGMENT, "UNKNOWN").alias("RACE"),
            F.when(F.col("c_nationkey") % 5 == 0, "HISPANIC OR LATINO")
            .otherwise("NOT HISPANIC OR LATINO").alias("ETHNIC"),
            (key % 38 + 148).cast("double").alias("HEIGHTBL"),
            (key * 7 % 69 + 44).cast("double").alias("WEIGHTBL"),
            F.when(balance >= -500, F.floor((share * 6.5 + 2) * 10) / 10).alias("DASCR"),
            ((F.col("__n") - 1) % 3).cast("int").alias("TRT01PN"),
            yn_flag(balance > -900).alias("ITTFL"),
            yn_flag(key % 20 != 0).alias("PPROTFL"),
        )
        out = with_constants(people, STUDYID=STUDY, DOMAIN="DM").withColumns(
            {
                "AGEGR1": band(F.col("AGE"), *S.AGE_BANDS),
                "BMIBL": F.when(
                    F.col("USUBJID") % 37 != 0, bmi(F.col("WEIGHTBL"), F.col("HEIGHTBL"))
                ),
                "DASGRP": band(F.col("DASCR"), *S.DAS28_BANDS),
                "TRT01P": arm_text(F.col("TRT01PN"), DRUG),
            }
        ).withColumns({"ARM": F.col("TRT01P"), "ACTARM": F.col("TRT01P")})
        out = out.join(spans, "USUBJID", "left").withColumn(
            "SAFFL", yn_flag(F.col("RFSTDTC").isNotNull())
        )
        return out.select(*[c for c in S.DM.fieldNames() if c != "DMSEQ"])

    @cached_property
    def owned(self) -> DataFrame:
        """Returned line items with the subject and the start date."""
        items = self.table("lineitem").filter(F.col("l_returnflag") == "R")
        owner = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("USUBJID"))
        return items.join(owner, F.col("l_orderkey") == F.col("o_orderkey")).withColumn(
            "AESTDTC", iso_text(_day("l_shipdate"))
        )

    @cached_property
    def returns(self) -> DataFrame:
        """Returned line items as events, before event numbering."""
        part = self.table("part").select("p_partkey", "p_brand", "p_type")
        severity = (
            F.when(F.col("l_quantity") >= 45, "SEVERE")
            .when(F.col("l_quantity") >= 30, "MODERATE")
            .otherwise("MILD")
        )
        started = _day("l_shipdate")
        joined = self.owned.join(part, F.col("l_partkey") == F.col("p_partkey"))
        return with_constants(joined, STUDYID=STUDY, DOMAIN="AE").withColumns(
            {
                "AEDECOD": F.col("p_type"),
                "AEBODSYS": F.col("p_brand"),
                "AESEV": severity,
                "AESER": yn_flag((F.col("l_quantity") >= 45) & (F.col("l_linestatus") == "O")),
                "AEREL": F.when(F.col("l_discount") >= 0.05, "RELATED").otherwise("NOT RELATED"),
                "AEOUT": F.when(
                    (F.col("l_quantity") >= 45) & (F.col("l_tax") >= 0.07),
                    "NOT RECOVERED/NOT RESOLVED",
                ).otherwise("RECOVERED/RESOLVED"),
                "AEENDTC": iso_text(shift_days(started, F.col("l_linenumber"))),
                "VISITNUM": F.col("l_linenumber"),
                "VISIT": visit_text(F.col("l_linenumber")),
            }
        )

    @cached_property
    def ae(self) -> DataFrame:
        """Adverse events without sequence numbers (see ``ae_sequenced``)."""
        return self.returns.select(*[c for c in S.AE.fieldNames() if c != "AESEQ"])

    @cached_property
    def ae_sequenced(self) -> DataFrame:
        order = [
            "AESTDTC", "AEDECOD", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus",
        ]
        return sequence_within(
            self.returns, "USUBJID", order, "AESEQ", large=self.busy_subjects, checked=True
        ).select(*S.AE.fieldNames())

    @cached_property
    def busy_subjects(self) -> LargeGroups | None:
        """Subjects with so many events that the numbering window splits their rows over tasks.

        Counted before the join with part, which can only remove rows; only the numbering needs it.
        """
        return large_groups(self.owned, ["USUBJID"])

    @cached_property
    def ex(self) -> DataFrame:
        """Doses without sequence numbers (see ``ex_sequenced``)."""
        given = _day("o_orderdate")
        return with_constants(self.table("orders"), STUDYID=STUDY, DOMAIN="EX").select(
            "STUDYID", "DOMAIN", F.col("o_custkey").alias("USUBJID"),
            F.when(F.col("o_orderstatus") == "P", "N").otherwise("Y").alias("EXOCCUR"),
            iso_text(given).alias("EXSTDTC"),
            iso_text(shift_days(given, 27)).alias("EXENDTC"),
            F.col("o_orderkey").alias("EXREFID"),
        )

    @cached_property
    def ex_sequenced(self) -> DataFrame:
        return sequence_within(self.ex, "USUBJID", ["EXSTDTC", "EXREFID"], "EXSEQ")

    @cached_property
    def vs(self) -> DataFrame:
        views = self.table("events").filter(F.col("event_type") == "view")
        day = F.datediff(_day("ts"), F.lit("2024-01-01").cast("date"))
        return with_constants(views, STUDYID=STUDY, DOMAIN="VS", VSTESTCD="DAS28").select(
            "STUDYID", "DOMAIN", F.col("user_id").alias("USUBJID"), "VSTESTCD",
            F.col("value").alias("VSSTRESN"),
            F.floor(day / 5).cast("int").alias("VISITNUM"),
            iso_text(_day("ts")).alias("VSDTC"),
            F.col("event_id").alias("VSREFID"),
        )

    @cached_property
    def ds(self) -> DataFrame:
        last = F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))
        final = self.table("orders").groupBy(F.col("o_custkey").alias("USUBJID")).agg(
            last["o_orderstatus"].alias("__status"),
            iso_text(last["o_orderdate"].cast("date")).alias("DSSTDTC"),
        )
        done = F.col("__status") == "F"
        return with_constants(final, STUDYID=STUDY, DOMAIN="DS").select(
            "STUDYID", "DOMAIN", "USUBJID",
            recode(F.col("__status"), STATUS_TERM).alias("DSDECOD"),
            "DSSTDTC",
            F.when(done, "COMPLETED").otherwise("DISCONTINUED").alias("EOSSTT"),
            yn_flag(~done).alias("DPTFL"),
        )

    @cached_property
    def adsl(self) -> DataFrame:
        return build_adsl(
            self.dm, self.ds, self.ae, self.ex, self.vs, ALT_TERMS, NEURO_GI_TERMS, REGION_CODE
        )

    @cached_property
    def adae(self) -> DataFrame:
        return build_adae(self.ae_sequenced, self.adsl)

    @cached_property
    def adae_unsequenced(self) -> DataFrame:
        """Event dataset for tables that do not list single events."""
        events = self.ae.withColumn("AESEQ", F.lit(None).cast("int"))
        return build_adae(events, self.adsl)

    @cached_property
    def itt(self) -> DataFrame:
        return population(self.adsl, "ITT")

    @cached_property
    def frame(self) -> DataFrame:
        return model_frame(self.adsl)

    @cached_property
    def scored(self) -> DataFrame:
        return score_by_rule(self.adsl, REMOTE_SITES)

    @cached_property
    def outcome(self) -> DataFrame:
        """Score and 0/1 outcome of the ITT subjects."""
        return population(self.scored, "ITT").select("USUBJID", "DPTN", "DROPOUT_PROB")

    @property
    def dropout_event(self) -> Column:
        return indicator(F.col("DPTFL") == "Y")
