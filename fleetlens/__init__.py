"""fleetlens: estate-wide analytics over data-orchestration jobs, as Spark DataFrames."""
