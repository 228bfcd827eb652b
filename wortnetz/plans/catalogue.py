"""All queries by name."""

from . import forms, numeric, survey, wording

QUERIES = survey.QUERIES | wording.QUERIES | numeric.QUERIES | forms.QUERIES
SQL = survey.SQL | wording.SQL | numeric.SQL | forms.SQL
