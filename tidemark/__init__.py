"""tidemark: feature preparation, dataset versioning, drift, evaluation and
request-telemetry operators written against Spark DataFrames.

Every operator takes and returns DataFrames plus column names; nothing
is specific to one dataset.  Sub-packages:

* ``sources``   -- table access, CSV/JSON/Parquet sources and sinks, split catalog
* ``functions`` -- Column-expression helpers (no UDFs except one p-value helper)
* ``operators`` -- fit/apply transforms, splits, profiles, drift, metrics, registry
* ``plans``     -- composed jobs and the registered driver queries
* ``streaming`` -- Structured Streaming versions of the telemetry and scoring jobs
"""

__version__ = "0.1.0"
