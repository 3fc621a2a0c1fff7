from tessera.plans import catalogue, mechanisms, scenarios  # noqa: F401  registers the queries
