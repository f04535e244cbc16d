"""fleetstats: database-fleet statistics reports, trends, registries and audits on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from DataFrame/SQL
built-ins only. Reports run for every database of a fleet at once (grouped by
``datname``); passing ``datname=`` gives the one-database form.
"""

from fleetstats.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
