"""Audit lines: classification by a catalogue, login sessions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import logs as fl
from tidemark.functions.series import MICROS, micros


@dataclass(frozen=True)
class AuditRule:
    priority: str
    service: str
    event: str
    pattern: str


# The published catalogue of audit events that reach the logs.
CATALOGUE = (
    AuditRule("High", "Oauth2 Proxy", "Login", r"\[AuthSuccess\] Authenticated via OAuth2"),
    AuditRule("High", "Oauth2 Proxy", "create session", r"\[AuthSuccess\] Authenticated via OAuth2"),
    AuditRule(
        "Low",
        "Spark History Server",
        "start/stop server-application",
        r"HistoryServer: Bound HistoryServer to ",
    ),
    AuditRule(
        "Low",
        "Spark History Server",
        "start/stop server-application",
        r"Utils: Successfully started service 'HistoryServerUI' on port ",
    ),
)


def audit_events(lines: DataFrame, catalogue: tuple[AuditRule, ...] = CATALOGUE) -> DataFrame:
    """One row per line and catalogue event it stands for, with address, session, user and groups.

    The catalogue is a short fixed list, so its patterns become one expression per line (a join on a
    pattern would compare every line with every rule). Lines of no rule are dropped.
    """
    value = F.col("value")
    rules = F.array(
        *[
            F.when(
                value.rlike(rule.pattern),
                F.struct(
                    F.lit(rule.priority).alias("priority"),
                    F.lit(rule.service).alias("service"),
                    F.lit(rule.event).alias("event"),
                ),
            )
            for rule in catalogue
        ]
    )
    logged = F.coalesce(
        F.try_to_timestamp(fl.part(value, fl.LOGIN_LINE, 4), F.lit("yyyy/MM/dd HH:mm:ss")),
        fl.log_time(fl.part(value, fl.LOG_LINE, 1)),
    )
    return (
        lines.withColumn("rule", F.explode(F.filter(rules, lambda r: r.isNotNull())))
        .select(
            "rule.*",
            logged.alias("ts"),
            fl.part(value, fl.LOGIN_LINE, 1).alias("ip"),
            fl.part(value, fl.LOGIN_LINE, 2).alias("session"),
            fl.part(value, fl.LOGIN_LINE, 3).alias("user"),
            fl.session_time(value, "created").alias("created"),
            fl.session_time(value, "expires").alias("expires"),
            fl.session_groups(value).alias("groups"),
        )
    )


def audit_sessions(events: DataFrame, event: str = "Login") -> DataFrame:
    """Login sessions per user: number, mean and longest length in seconds."""
    length = (micros(F.col("expires")) - micros(F.col("created"))) / MICROS
    sessions = (
        events.filter(F.col("event") == event)
        .groupBy("user", "session")
        .agg(F.min("created").alias("created"), F.max("expires").alias("expires"))
    )
    return (
        sessions.withColumn("length_s", length)
        .groupBy("user")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.avg("length_s").alias("mean_s"),
            F.max("length_s").alias("longest_s"),
        )
    )
