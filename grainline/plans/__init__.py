"""Presets built from the operators: the bookings feature job."""

from grainline.plans.bookings import (
    BookingsConfig, build_features, clean, feature_columns, group_features, prepare,
    row_features, sequences)

__all__ = ["BookingsConfig", "build_features", "clean", "feature_columns", "group_features",
           "prepare", "row_features", "sequences"]
