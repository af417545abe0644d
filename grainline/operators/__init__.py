"""DataFrame -> DataFrame operators."""

from grainline.operators.cleaning import (
    SOURCE_COL, impute, reset_rows, round_columns, split_source, tag_source)
from grainline.operators.coding import first_seen_index, position_key
from grainline.operators.explore import (
    describe_by, frequency_compare, key_overlap, profile_nulls, profile_schema,
    visits_per_entity)
from grainline.operators.folds import (
    FOLD_COL, average_predictions, cv_report, fold_members, fold_of, fold_split,
    group_kfold, mean_of_columns, percent_of_total, rmse, top_k)
from grainline.operators.group_back import (
    CountBy, StatsBy, group_back, group_back_plan_only, output_names, plan_key_sets)
from grainline.operators.ranking import exact_quantiles, global_rank, running_count
from grainline.operators.sequence import (
    Order, gap_name, hot_groups, sequence_shift, shift_name, visit_gaps)

__all__ = [
    "SOURCE_COL", "impute", "reset_rows", "round_columns", "split_source", "tag_source",
    "first_seen_index", "position_key",
    "describe_by", "frequency_compare", "key_overlap", "profile_nulls", "profile_schema",
    "visits_per_entity",
    "FOLD_COL", "average_predictions", "cv_report", "fold_members", "fold_of", "fold_split",
    "group_kfold", "mean_of_columns", "percent_of_total", "rmse", "top_k",
    "CountBy", "StatsBy", "group_back", "group_back_plan_only", "output_names", "plan_key_sets",
    "exact_quantiles", "global_rank", "running_count",
    "Order", "gap_name", "hot_groups", "sequence_shift", "shift_name", "visit_gaps",
]
