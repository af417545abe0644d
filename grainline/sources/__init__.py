"""Readers, writers and the reservation fixture built from the test tables."""

from grainline.sources.bookings import (
    BOOKING_SCHEMA,
    DATE_COLS,
    ID_COL,
    MEMBER_COL,
    RAW_COLUMNS,
    TARGET_COL,
    read_bookings,
)
from grainline.sources.sinks import write_importance, write_predictions
from grainline.sources.tables import bookings_from_tables, bookings_pair, load_table, tagged_bookings

__all__ = [
    "BOOKING_SCHEMA", "DATE_COLS", "ID_COL", "MEMBER_COL", "RAW_COLUMNS", "TARGET_COL",
    "read_bookings", "write_importance", "write_predictions",
    "bookings_from_tables", "bookings_pair", "load_table", "tagged_bookings",
]
