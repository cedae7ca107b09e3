"""Page-table analytics on Spark: URLs, HTML fields, quality gates, drift, pacing."""

from webgrain.session import clean_up, configure, spread, work_folder

__all__ = ["clean_up", "configure", "spread", "work_folder"]
