"""grainline — detail-preserving group features, sequence features,
group-wise cross validation and tabular boosting on Spark DataFrames.

Sub-packages:

* ``functions``  – scalar column expressions (dates, rounding, ratios)
* ``sources``    – readers, writers and the test-table fixture
* ``operators``  – DataFrame -> DataFrame operators (group-back, sequences,
  label coding, folds, metrics, exploration, boosting)
* ``plans``      – the bookings preset: full feature manifest and the staged
  job that materialises it
"""

from grainline.session import clear_stages, ensure_checkpoint_dir, get_session, materialize, release

__all__ = ["clear_stages", "get_session", "ensure_checkpoint_dir", "materialize", "release"]
