"""aftershock: shock-recovery analytics as plain Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` (or a few
DataFrames in, one out).  Nothing is collected to the driver except small,
size-checked lists (pivot value lists, shock calendars) and model metadata.
"""

from aftershock.session import checkpoint_dir, get_session, materialize

__all__ = ["get_session", "checkpoint_dir", "materialize"]
