"""Read functions for agents and tools; each returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import classify as C
from tidewatch.operators import ledger, windows
from tidewatch.plans import detect


def list_sessions(events: DataFrame) -> DataFrame:
    return detect.session_list(events).orderBy("started_us")


def get_events(events: DataFrame, session: str, after: int | None = None, limit: int = 200) -> DataFrame:
    return detect.event_page(windows.numbered(events), session, after, limit)


def get_alerts(alerts: DataFrame, session: str) -> DataFrame:
    return alerts.where((F.col("session") == session) & C.is_alert(F.col("type"))).orderBy(F.desc("alert_idx"))


def verify(events: DataFrame, segments: DataFrame, points: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    return ledger.verdict(ledger.verify(events, segments, points, heads), segments)


def incident_report(events: DataFrame, alerts: DataFrame, session: str, markers: DataFrame | None = None) -> DataFrame:
    clusters = None if markers is None else detect.causality_clusters(markers)
    return detect.incident_text(detect.timeline(events, alerts), detect.incident_headers(events, alerts), session, clusters)
