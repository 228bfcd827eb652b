"""The jobs as queries: each runs twice into one new folder below the shared one, and returns its output after the second run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import association_norms, word_frequencies
from wortnetz.plans import survey
from wortnetz.plans.fixtures import sql
from wortnetz.session import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_word_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table is a file or a folder; a stream takes either by a pattern."""
    at = _folder(spark, "job1")
    for _ in range(2):
        out = word_frequencies.run(spark, f"{sf_dir}/documents.parquet*", f"{at}/output", f"{at}/checkpoint")
    return out


#: As in the queries on participants, the test tables' scores lie elsewhere than a survey's.
CRITERIA = {k: v for k, v in survey.CRITERIA.items() if k != "score_spelling"}


def job2_association_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job2")
    for _ in range(2):
        out = association_norms.run(spark, sf_dir, f"{at}/output", criteria=CRITERIA)
    return out


QUERIES = {f.__name__: f for f in (job1_word_frequencies, job2_association_norms)}
SQL = {
    "job1_word_frequencies": sql(
        "words",
        """SELECT word, n, n_docs, round(n / tokens * 1e6, 6) AS per_million, round(log10((n + 1) / (tokens / 1e6 + types / 1e6)) + 3, 6) AS zipf, round(n_docs / docs, 6) AS document_share, w.lang AS lang
FROM w JOIN t ON w.lang IS NOT DISTINCT FROM t.lang JOIN d ON w.lang IS NOT DISTINCT FROM d.lang""",
        more="""w AS (SELECT nullif(lang, '') AS lang, word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM words GROUP BY 1, 2),
t AS (SELECT lang, sum(n) AS tokens, count(*) AS types FROM w GROUP BY 1), d AS (SELECT nullif(lang, '') AS lang, count(*) AS docs FROM documents GROUP BY 1)""",
    ),
    "job2_association_norms": sql(
        "trials participants",
        """SELECT cue, response, n, round(n / sum(n) OVER (PARTITION BY section, cue), 6) AS strength, CAST(row_number() OVER (PARTITION BY section, cue ORDER BY n DESC, response) AS INTEGER) AS rank, section FROM g""",
        more="""l AS (SELECT trial_id, participant_id, response FROM trials CROSS JOIN LATERAL (VALUES (response_1), (response_2), (response_3)) v(response)),
p AS (SELECT participant_id FROM l JOIN participants ON id_p = participant_id GROUP BY 1 HAVING count(DISTINCT response) / nullif(count(response), 0) > 0.85
  AND sum(CASE WHEN response LIKE '% %' THEN 1 ELSE 0 END) / nullif(count(response), 0) < 2.0),
k AS (SELECT * FROM trials WHERE participant_id IN (SELECT participant_id FROM p)),
c AS (SELECT cue, count(*) AS n FROM k GROUP BY cue),
best AS (SELECT i FROM range(1, 71) r(i) JOIN c ON n >= i GROUP BY i ORDER BY i * count(*) DESC, i LIMIT 1),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cue ORDER BY md5('1984:' || trial_id), trial_id) AS r FROM k WHERE cue IN (SELECT cue FROM c WHERE n >= (SELECT i FROM best))) x WHERE r <= (SELECT i FROM best)),
g AS (SELECT section, cue, response, count(*) AS n FROM s CROSS JOIN LATERAL (VALUES (response_1), (response_2), (response_3)) v(response) WHERE response IS NOT NULL AND cue IS NOT NULL GROUP BY 1, 2, 3)""",
    ),
}
