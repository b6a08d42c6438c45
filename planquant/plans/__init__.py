from planquant.plans import queries as _queries  # noqa: F401  registers the queries
