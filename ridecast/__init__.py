"""Trip-duration analytics on Spark: prepare, profile, train, select and score.

Every public function takes and returns Spark DataFrames (or Spark ML stages),
so a caller composes one lazy plan from the scan to the sink.
"""
