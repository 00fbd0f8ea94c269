"""Registered queries and their reference SQL, by area."""

from starloom.plans import census, coverage, operators, quality, relational

AREAS = (relational, census, operators, coverage, quality)
QUERIES = {name: query for area in AREAS for name, query in area.QUERIES.items()}
SQL = {name: text for area in AREAS for name, text in area.SQL.items()}
flagship = relational.literacy_rate
