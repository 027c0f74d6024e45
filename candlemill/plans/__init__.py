"""Registered queries; load() imports every module that registers some."""


def load() -> tuple[dict, dict]:
    """(name -> callable, name -> SQL)."""
    from candlemill.plans import accounts, algebra, batch, catalogue, facts, journal, learned, online, patterns, trades  # noqa: F401

    return catalogue.QUERIES, catalogue.ORACLES
