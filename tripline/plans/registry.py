"""All registered queries of the library and their SQL."""

from tripline.plans import journeys, models, places, rules, tables, visits  # noqa: F401  (they register themselves)

QUERIES, SQL = visits.QUERIES, visits.SQL
