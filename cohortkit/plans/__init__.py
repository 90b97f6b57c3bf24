"""Plans: end-to-end jobs (cohort build, evaluation, training) and the
registered queries used by ``__spark_entry__``."""


def load_all():
    """Import every plan module so its queries register themselves."""
    from cohortkit.plans import cohort, evaluation, features, history, reports, roundtrip, splits, sweep, training, upkeep  # noqa: F401
    from cohortkit.plans.registry import REGISTRY
    return REGISTRY
