"""Time-series preparation and forecast evaluation as Spark DataFrame operators."""

from tidegrid.session import get_session, pin_utc, table

__all__ = ["get_session", "pin_utc", "table"]
