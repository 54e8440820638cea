"""The jobs as queries over the given tables, and their SQL twins.

Each runs its job twice into one new folder of the shared storage and returns
the whole output as it stands after the second run.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from jobs import screen_feed, stability_study
from jobs.common import settings_of
from verdigris.config import EXPERIMENTS
from verdigris.plans import oracles as sql
from verdigris.plans.queries import rounded
from verdigris.sources.storage import shared_folder

#: Thresholds at which texts that carry no mark show on either side.
Z, HOT = 1.0, 2.5


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_screen_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings, own = settings_of(screen_feed.CONFIG, "feed")
    settings = replace(settings, watermark=replace(settings.watermark, z_threshold=Z))
    feed = screen_feed.Feed(**own | {"hot_window_z": HOT})
    folder = _folder(spark, "job1")
    for _ in range(2):
        screen_feed.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint", settings, feed)
    return rounded(screen_feed.read_back(spark, f"{folder}/out"))


def job2_stability_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job2")
    for _ in range(2):
        stability_study.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", folder)
    return rounded(stability_study.read_back(spark, folder))


QUERIES = {f.__name__: f for f in (job1_screen_feed, job2_stability_study)}

P_VALUE = f"(SELECT CASE WHEN z >= 0 THEN {sql.TAIL} ELSE 1 - {sql.TAIL} END FROM (SELECT {sql.X} AS x, 1 / (1 + 0.5::DOUBLE * {sql.X}) AS t))"
_SCREENED = f"""
marked AS (SELECT doc_id, lang, source, {sql.bits_of('words')} AS b FROM (SELECT doc_id, lang, source, coalesce({sql.words('text')}, []) AS words FROM documents)),
whole AS (SELECT *, array_to_string(b, '') AS bits, len(b) AS t, coalesce(list_sum(b), 0)::BIGINT AS k FROM marked),
{sql.windowed('whole', 'doc_id', W=50, STEP=10)},
best AS (
  SELECT doc_id, count(*) AS n_windows, sum((z > {HOT})::BIGINT)::BIGINT AS hot_windows,
    first({{'z': z, 'a': win_start, 'b': win_end}} ORDER BY z DESC, win_idx) AS peak FROM wins GROUP BY doc_id),
zs AS (SELECT whole.*, {sql.z('k', 'whole.t')} AS z, CASE WHEN whole.t > 0 THEN k::DOUBLE / whole.t ELSE 0 END AS share FROM whole),
scores AS (
  SELECT doc_id, lang, source, zs.t AS num_tokens_scored, k AS num_green_tokens, share AS green_fraction, zs.z AS z_score,
    {P_VALUE.replace('z >=', 'zs.z >=').replace(sql.X, sql.X.replace('abs(z)', 'abs(zs.z)'))} AS p_value, zs.z > {Z} AS prediction,
    coalesce(n_windows, 0) AS n_windows, coalesce(hot_windows, 0) AS hot_windows, peak.z AS peak_z, peak.a AS peak_start, peak.b AS peak_end
  FROM zs LEFT JOIN best USING (doc_id)),
report AS (
  SELECT lang, source, count(*) AS n, sum((num_tokens_scored > 0)::BIGINT)::BIGINT AS n_scored, sum(prediction::BIGINT)::BIGINT AS n_flagged,
    sum((hot_windows > 0)::BIGINT)::BIGINT AS n_hot, avg(z_score) AS mean_z, avg(green_fraction) AS mean_green_fraction FROM scores GROUP BY lang, source)"""

_CUTS = sql.CUTS.replace("FROM documents)", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1))", 1)


def _rounded(*columns: str) -> str:
    return ", ".join(f"{sql.r(c)} AS {c}" for c in columns)


_RATES = f"lang, n_pos, n_neg, {_rounded('auc', 'threshold', 'tpr', 'fpr')}"
ORACLES = {
    "job1_screen_feed": f"""WITH {_SCREENED}
SELECT 'score' AS part, doc_id, lang, source, num_tokens_scored, num_green_tokens, n_windows, hot_windows, peak_start, peak_end, prediction, {_rounded('green_fraction', 'z_score', 'p_value', 'peak_z')} FROM scores
UNION ALL BY NAME SELECT 'report' AS part, lang, source, n, n_scored, n_flagged, n_hot, {_rounded('mean_z', 'mean_green_fraction')} FROM report""",
    "job2_stability_study": f"""WITH {sql.COMBINED.replace(sql.CUTS, _CUTS)}, {sql.windowed('combined', 'depth, id, label')}, {sql.members()}, {sql.PSS},
langs AS (SELECT doc_id, lang FROM documents),
scores AS (SELECT c.*, lang FROM combined c JOIN langs USING (doc_id)),
texts AS (
  SELECT experiment, doc_id, text_type, label, lang, count(*) AS n_windows, {sql.r('avg(pss)')} AS mean_pss, {sql.r('max(pss)')} AS max_pss
  FROM pss JOIN ids USING (id) JOIN langs USING (doc_id) GROUP BY experiment, doc_id, text_type, label, lang),
{sql.curve('scores', 'z_score', 'depth, lang', 'depths')},
{sql.curve('texts', 'mean_pss', 'experiment, lang', 'experiments')}
SELECT 'scores' AS part, doc_id, text_type, label, lang, bits, t AS num_tokens_scored, k AS num_green_tokens, {sql.r('CASE WHEN t > 0 THEN k::DOUBLE / t ELSE 0 END')} AS green_fraction, {sql.r('z_score')} AS z_score, depth FROM scores
UNION ALL BY NAME SELECT 'texts' AS part, * FROM texts
UNION ALL BY NAME SELECT 'depths' AS part, depth, {_RATES} FROM depths
UNION ALL BY NAME SELECT 'experiments' AS part, experiment, {_RATES} FROM experiments""",
}
