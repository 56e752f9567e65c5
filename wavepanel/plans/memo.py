"""Per-session memo of lazy plan objects built by the presets' builders.

Only DataFrame plan objects are kept (no data), keyed by session, source
(data folder or a hashable sources description) and builder name, so shared
sub-plans are built and analysed once per session; identical sub-plans inside
one query are then the same object, which lets Spark reuse their exchanges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PLANS: dict[tuple, DataFrame] = {}


def _session(spark: SparkSession) -> tuple:
    """Identity of a session (classic or Connect, where there is no SparkContext)."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # Spark Connect
        app = spark.conf.get("spark.app.id", None)
    return (id(spark), app)


def shared(fn):
    """Decorator: reuse the DataFrame a builder returns for the same session and source."""

    def wrapper(spark: SparkSession, sf_dir: str, *args, **kw):
        key = (*_session(spark), sf_dir, fn.__name__, args, tuple(sorted(kw.items())))
        if not args and not kw:
            key = _key(spark, sf_dir, fn.__name__)
        if key not in _PLANS:
            _PLANS[key] = fn(spark, sf_dir, *args, **kw)
        return _PLANS[key]

    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    wrapper.__wrapped__ = fn
    return wrapper


def _key(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    return (*_session(spark), sf_dir, name, (), ())


def clear_plans() -> None:
    _PLANS.clear()


def override(spark: SparkSession, sf_dir: str, name: str, df: DataFrame, **kw) -> None:
    """Make builder ``name``, called with the same keywords, return ``df`` (e.g. a
    materialized copy) for this session and folder; builders created afterwards read it."""
    _PLANS[(*_session(spark), sf_dir, name, (), tuple(sorted(kw.items())))] = df
