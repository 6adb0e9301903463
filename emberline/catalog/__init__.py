def load():
    """(queries, oracles) with every catalog module registered."""
    from emberline.catalog import decisions, episodes, evaluation, joins, models, preparation, profiles, reports, rows, tables  # noqa: F401
    from emberline.catalog.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
