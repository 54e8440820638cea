"""DuckDB SQL for the queries: written apart from the operators, over the same tables."""

from __future__ import annotations

from verdigris.config import EXPERIMENTS, SMALL, WINDOW_PRESETS
from verdigris.functions.scores import ERFC
from verdigris.operators.windows import STATIC

K, M = SMALL.corpus.skip_lines, SMALL.corpus.words_per_sample
KEY, GAMMA, DELTA = SMALL.watermark.hash_key, SMALL.watermark.gamma, SMALL.watermark.delta
ROUNDS, RATE, TOL = SMALL.paraphrase.iterations, SMALL.paraphrase.rate, SMALL.paraphrase.tolerance
W, STEP = SMALL.windows.size, SMALL.windows.stride


def words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda x: x <> '')"


def u(*parts: str) -> str:
    joined = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(('0x' || substr(md5({joined}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def z(k: str, t: str) -> str:
    return f"CASE WHEN {t} > 0 THEN ({k} - {GAMMA}::DOUBLE * {t}) / sqrt({t} * {GAMMA * (1 - GAMMA)}::DOUBLE) ELSE 0.0::DOUBLE END"


def r(value: str) -> str:
    return f"round(round(({value})::DOUBLE, 9), 6) + 0.0::DOUBLE"


def green(before: str, token: str) -> str:
    return f"({u(f"'{KEY}'", before, token)} < {GAMMA})"


def bits_of(w: str) -> str:
    return f"list_transform(range(2, len({w}) + 1), lambda i: CASE WHEN {green(f'{w}[i - 1]', f'{w}[i]')} THEN 1 ELSE 0 END)"


CUTS = f"""
raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lined AS (SELECT doc_id, text, CASE WHEN parts[-1] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS lines FROM raw),
bodies AS (SELECT doc_id, coalesce(len(lines), 0) AS n_lines, {words(f"array_to_string(lines[{K + 1}:], chr(10))")} AS body FROM lined),
cut AS (SELECT doc_id, CASE WHEN n_lines >= {K} THEN body[1:{M}] ELSE [] END AS words FROM bodies),
samples AS (SELECT * FROM cut WHERE len(words) >= {M}),
halves AS (
  SELECT doc_id, 'human' AS text_type, 0 AS label, words[1:{M // 2}] AS words FROM samples
  UNION ALL SELECT doc_id, 'ai', 1, words[{M // 2 + 1}:] FROM samples)"""

SCORED = f"""{CUTS},
marked AS (SELECT *, {bits_of('words')} AS bits FROM halves),
scored AS (SELECT *, len(bits) AS t, coalesce(list_sum(bits), 0)::BIGINT AS k FROM marked)"""

PAIRS = f"""{CUTS},
places AS (SELECT doc_id, text_type, words, unnest(range(1, len(words))) AS i FROM halves),
bigrams AS (SELECT doc_id, text_type, words[i] AS prev, words[i + 1] AS token, count(*) AS n FROM places GROUP BY ALL),
pairs AS (SELECT prev, token, sum(n)::BIGINT AS n FROM bigrams GROUP BY ALL)"""

DEEP = f"""{CUTS},
places AS (SELECT doc_id, text_type, label, words, unnest(range(0, len(words))) AS pos FROM halves),
swaps AS (SELECT *, list_filter(range(1, {ROUNDS + 1}), lambda k: {u("'p'", 'doc_id', 'text_type', 'pos', 'k')} < {RATE}) AS hits FROM places),
deep_words AS (
  SELECT doc_id, text_type, label, d AS depth, pos, list_max(list_filter(hits, lambda k: k <= d)) AS latest, words[pos + 1] AS word
  FROM swaps, range(0, {ROUNDS + 1}) t(d)),
deep AS (
  SELECT doc_id, text_type, label, depth::INTEGER AS depth,
    list(CASE WHEN latest IS NULL THEN word ELSE 'w' || substr(md5('r:' || doc_id || ':' || text_type || ':' || pos || ':' || latest), 1, 4) END ORDER BY pos) AS words
  FROM deep_words GROUP BY ALL)"""

DETECTED = f"""{DEEP},
marked AS (SELECT doc_id, text_type, label, depth, {bits_of('words')} AS b FROM deep),
detected AS (
  SELECT doc_id, text_type, label, depth, array_to_string(b, '') AS bits, len(b) AS t, coalesce(list_sum(b), 0)::BIGINT AS k,
    {z('coalesce(list_sum(b), 0)', 'len(b)')} AS z_score FROM marked)"""

IDS = "ids AS (SELECT doc_id, text_type, label, row_number() OVER (ORDER BY label DESC, doc_id, text_type) AS id FROM halves)"

COMBINED = f"{DETECTED}, {IDS}, combined AS (SELECT d.*, id FROM detected d JOIN ids USING (doc_id, text_type))"


def windowed(source: str, keys: str, bits: str = "bits", W: int = W, STEP: int = STEP) -> str:
    """CTEs that end in ``wins``: (keys, win_idx, win_start, win_end, win, z, run, freq)."""
    return f"""
sized AS (SELECT {keys}, {bits} AS s, length({bits}) AS n FROM {source} WHERE length({bits}) > 0),
started AS (
  SELECT *, unnest(range(0, least(ceil(n / {STEP}::DOUBLE), 1 + ceil(greatest(n - {W}, 0) / {STEP}::DOUBLE))::BIGINT)) AS win_idx FROM sized),
edges AS (SELECT *, win_idx * {STEP} AS a, least(win_idx * {STEP} + {W}, n) AS b FROM started),
grown AS (
  SELECT *, greatest(length(rtrim(substr(s, 1, a + 1), '1')) - 1, 0) AS win_start,
    least(b + length(substr(s, b)) - length(ltrim(substr(s, b), '1')), n) AS win_end FROM edges),
cutout AS (SELECT *, substr(s, win_start + 1, win_end - win_start) AS win FROM grown),
counted AS (
  SELECT *, length(win) AS t, length(win) - length(replace(win, '1', '')) AS k,
    list_transform(list_filter(string_split(win, '0'), lambda x: x <> ''), lambda x: length(x)) AS runs FROM cutout),
wins AS (
  SELECT {keys}, win_idx, win_start, win_end, win, {z('k', 't')} AS z, coalesce(list_max(runs), 0) AS run,
    coalesce(len(list_filter(runs, lambda x: x = list_max(runs))), 0) AS freq FROM counted)"""


WINS = f"{COMBINED}, {windowed('combined', 'depth, id, label')}"


def moments(p: str) -> list[str]:
    c = f"{p}::DOUBLE"
    mean, n = f"avg({c})", "count(*)"
    m2 = f"(var_pop({c}))"
    m3 = f"avg(power({c}, 3)) - 3 * {mean} * avg(power({c}, 2)) + 2 * power({mean}, 3)"
    return [
        f"{mean} AS {p}_mean", f"{m2} AS {p}_var", f"min({c}) AS {p}_min", f"max({c}) AS {p}_max",
        f"CASE WHEN {n} > 2 AND max({c}) > min({c}) THEN ({m3}) / power({m2}, 1.5) ELSE 0.0 END AS {p}_skew",
        f"CASE WHEN {n} > 3 AND max({c}) > min({c}) THEN coalesce(kurtosis_pop({c}), 0.0) ELSE 0.0 END AS {p}_kurtosis",
    ]


def statistics(source: str, keys: str = "depth, id") -> str:
    """CTEs that end in ``stats``: (keys, the twenty figures)."""
    return f"""
centred AS (SELECT *, z - avg(z) OVER (PARTITION BY {keys}) AS c FROM {source}),
lagged AS (SELECT *, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2 FROM centred WINDOW w AS (PARTITION BY {keys} ORDER BY win_idx)),
stats AS (
  SELECT {keys}, {', '.join(x for p in ('z', 'run', 'freq') for x in moments(p))},
    CASE WHEN count(*) > 1 AND sum(c * c) > 1e-18 THEN coalesce(sum(c * c1), 0) / sum(c * c) ELSE 0.0 END AS z_autocorr_lag1,
    CASE WHEN count(*) > 2 AND sum(c * c) > 1e-18 THEN coalesce(sum(c * c2), 0) / sum(c * c) ELSE 0.0 END AS z_autocorr_lag2
  FROM lagged GROUP BY {keys})"""


def members(names: tuple[str, ...] | None = None) -> str:
    rows = ", ".join(f"('{n}', {d}, {len(ds)}, {k})" for k, (n, ds) in enumerate(EXPERIMENTS) if names is None or n in names for d in ds)
    return f"members AS (SELECT * FROM (VALUES {rows}) t(experiment, depth, n_depths, position))"


ALL_DEPTHS = max(EXPERIMENTS, key=lambda e: len(e[1]))[0]
PSS = """
pss AS (
  SELECT experiment, position, id, win_idx, CASE WHEN count(z) = n_depths THEN stddev_pop(z) ELSE 0.0 END AS pss
  FROM wins JOIN members USING (depth) GROUP BY experiment, position, id, win_idx, n_depths)"""

LENGTHS = (200, 100, 50)


def trimmed(n: str) -> str:
    w = words("text")
    return f"CASE WHEN text IS NULL THEN '' WHEN len({w}) <= {n} THEN text ELSE array_to_string({w}[1:{n}], ' ') END AS text_cleaned, CASE WHEN text IS NULL THEN 0 ELSE least(len({w}), {n}) END::BIGINT AS new_word_count"


COUNT = f"coalesce(len({words('text')}), 0)::BIGINT"
JUDGED = f"judged AS (SELECT quality AS label, toxic, ({COUNT} >= 50)::INTEGER AS prediction FROM labels JOIN documents USING (doc_id))"
CELLS = "sum((label = 0 AND prediction = 0)::BIGINT)::BIGINT AS tn, sum((label = 0 AND prediction = 1)::BIGINT)::BIGINT AS fp, sum((label = 1 AND prediction = 0)::BIGINT)::BIGINT AS fn, sum((label = 1 AND prediction = 1)::BIGINT)::BIGINT AS tp"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END"


RATES = {"accuracy": ratio("(tp + tn)", "(tp + tn + fp + fn)"), "precision": ratio("tp", "(tp + fp)"), "recall": ratio("tp", "(tp + fn)"), "f1": ratio("(2 * tp)", "(2 * tp + fp + fn)")}
BITS = "array_to_string(bits, '')"
SCORES = f"t AS num_tokens_scored, k AS num_green_tokens, {r('CASE WHEN t > 0 THEN k::DOUBLE / t ELSE 0 END')} AS green_fraction, {r(z('k', 't'))} AS z_score"
STATS = ", ".join(f"{r(c)} AS {c}" for c in STATIC)
WIDE = ", ".join(f"{r(f'max(CASE WHEN win_idx = {i} THEN z END)')} AS z_score_{i + 1}, max(CASE WHEN win_idx = {i} THEN run END)::INTEGER AS run_{i + 1}, max(CASE WHEN win_idx = {i} THEN freq END)::INTEGER AS freq_{i + 1}" for i in range(9))
TABLES = {"documents": 5, "labels": 3, "benchmark": 2, "conversations": 4}

ORACLES = {
    "scan_pruned": "SELECT doc_id, n_chars FROM documents",
    "validate_tables": " UNION ALL ".join(f"SELECT '{t}' AS name, true AS present, count(*) AS n_rows, {n} AS n_columns, count(*) > 0 AS valid FROM {t}" for t, n in TABLES.items()) + " UNION ALL SELECT 'missing_table', false, 0, 0, false",
    "viable_docs": f"WITH {CUTS} SELECT doc_id, coalesce(n_lines >= {K} AND len(body) >= {M}, false) AS viable FROM bodies",
    "word_tokens": f"WITH t AS (SELECT doc_id, {words('text')} AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(0, len(w)))::INTEGER AS pos FROM t) SELECT doc_id, pos, w[pos + 1] AS word FROM p",
    "word_count": f"SELECT doc_id, {COUNT} AS n_words FROM documents",
    "extract_words": f"WITH {CUTS} SELECT doc_id, array_to_string(words, ' ') AS words, len(words) AS n_words, len(words) >= {M} AS success FROM cut",
    "sample_docs": f"WITH {CUTS} SELECT doc_id, array_to_string(words, ' ') AS sample FROM samples ORDER BY doc_id LIMIT 50",
    "human_ai_split": f"WITH {CUTS} SELECT doc_id, text_type, array_to_string(words, ' ') AS text, len(words) AS word_count FROM halves",
    "create_dataset": f"WITH {CUTS} SELECT text_type, array_to_string(words, ' ') AS text, doc_id || '.txt' AS filename, len(words) AS word_count FROM halves",
    "trim_words": f"SELECT doc_id, {trimmed('100')} FROM documents",
    "length_variations": f"SELECT doc_id, n::BIGINT AS target_words, {trimmed('n')} FROM documents, (VALUES {', '.join(f'({n})' for n in LENGTHS)}) t(n)",
    "text_md5": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "vocab": f"WITH {CUTS}, tokens AS (SELECT unnest(words) AS token FROM halves), counts AS (SELECT token, count(*) AS n FROM tokens GROUP BY token) SELECT token, n, row_number() OVER (ORDER BY n DESC, token) - 1 AS tok_id FROM counts",
    "token_ids": f"WITH {CUTS}, p AS (SELECT doc_id, text_type, words, unnest(range(0, len(words))) AS pos FROM halves), tokens AS (SELECT doc_id, text_type, pos, words[pos + 1] AS token FROM p), counts AS (SELECT token, count(*) AS n FROM tokens GROUP BY token), vocab AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS tok_id FROM counts) SELECT doc_id, text_type, pos, tok_id FROM tokens JOIN vocab USING (token)",
    "greenlist_rank": f"WITH v AS (SELECT lang AS token FROM documents WHERE lang IS NOT NULL UNION SELECT source FROM documents WHERE source IS NOT NULL), p AS (SELECT a.token AS prev, b.token AS token FROM v a, v b), o AS (SELECT prev, token, row_number() OVER (PARTITION BY prev ORDER BY {u(f"'{KEY}'", 'prev', 'token')}, token) AS n FROM p) SELECT prev, token FROM o WHERE n <= floor((SELECT count(*) FROM v) * {GAMMA})",
    "greenlist_hash": f"WITH {PAIRS} SELECT prev, token, {r(u(f"'{KEY}'", 'prev', 'token'))} AS u, {green('prev', 'token')} AS green FROM pairs",
    "bias_logits": f"WITH {PAIRS} SELECT prev, token, {r('ln(n::DOUBLE)')} AS logit, {r(f'ln(n::DOUBLE) + CASE WHEN {green('prev', 'token')} THEN {DELTA} ELSE 0 END')} AS biased FROM pairs",
    "bigram_counts": f"WITH {PAIRS} SELECT * FROM bigrams",
    "resume_antijoin": "SELECT doc_id AS id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "detect_text": f"WITH {SCORED} SELECT doc_id, text_type, {BITS} AS bits, {SCORES} FROM scored",
    "green_bits": f"WITH {SCORED}, p AS (SELECT doc_id, text_type, bits, unnest(range(0, t)) AS pos FROM scored) SELECT doc_id, text_type, pos, bits[pos + 1]::BIGINT AS bit FROM p",
    "bits_csv": f"WITH {SCORED} SELECT doc_id, text_type, array_to_string(bits, ',') AS watermark_bits FROM scored",
    "score_sequence": f"WITH {SCORED} SELECT doc_id, text_type, {SCORES} FROM scored",
    "detect_docs": f"WITH w AS (SELECT doc_id, coalesce({words('text')}, []) AS words FROM documents), b AS (SELECT doc_id, {bits_of('words')} AS bits FROM w), s AS (SELECT doc_id, len(bits) AS t, coalesce(list_sum(bits), 0)::BIGINT AS k FROM b) SELECT doc_id, {SCORES}, ({z('k', 't')}) > 1.5 AS prediction FROM s",
    "score_unique_bigrams": f"WITH {CUTS}, p AS (SELECT doc_id, text_type, list_distinct(list_transform(range(2, len(words) + 1), lambda i: {{'prev': words[i - 1], 'token': words[i]}})) AS pairs FROM halves), s AS (SELECT doc_id, text_type, len(pairs) AS t, len(list_filter(pairs, lambda x: {green('x.prev', 'x.token')}))::BIGINT AS k FROM p) SELECT doc_id, text_type, t AS num_tokens_scored, k AS num_green_tokens, {r(z('k', 't'))} AS z_score FROM s",
    "z_score": f"WITH s AS (SELECT doc_id, length(coalesce(text, '')) AS t, length(regexp_replace(coalesce(text, ''), '[^aeiou]', '', 'g')) AS k FROM documents) SELECT doc_id, k, t, {r(z('k', 't'))} AS z FROM s",
    "detect_prediction": f"WITH {SCORED} SELECT doc_id, text_type, {r(z('k', 't'))} AS z_score, ({z('k', 't')}) > 1.0 AS prediction FROM scored",
    "detect_all_depths": f"WITH {DETECTED} SELECT doc_id, text_type, depth, bits, {r('z_score')} AS z_score, {r('CASE WHEN t > 0 THEN k::DOUBLE / t ELSE 0 END')} AS green_fraction, k AS green_token_count FROM detected",
    "detection_summary": f"WITH {DETECTED} SELECT text_type, depth, count(*) AS n, {r('avg(z_score)')} AS mean_z, {r('avg(CASE WHEN t > 0 THEN k::DOUBLE / t ELSE 0 END)')} AS mean_green_fraction FROM detected GROUP BY text_type, depth",
    "paraphrase_prompt": f"SELECT doc_id, '[INST] Rewrite the following passage in your own words. Keep its meaning and write at least ' || ({COUNT} - {TOL}) || ' words.' || chr(10) || chr(10) || text || ' [/INST]' AS prompt FROM documents",
    "clean_output": r"SELECT conv_id, turn, regexp_replace(regexp_replace(CASE WHEN turn % 2 = 0 THEN 'OutPut: ' ELSE ' ' END || text || ' ' || chr(10), '^(?i:output:)\s*', ''), '^\s+|\s+$', '', 'g') AS cleaned FROM conversations",
    "paraphrase_budget": f"SELECT doc_id, {COUNT} AS target, {COUNT} - {TOL} AS min_words, {COUNT} + {TOL} AS max_words, floor(({COUNT} + {TOL}) * 1.5)::BIGINT AS max_tokens FROM documents",
    "paraphrase_rounds": f"WITH {DEEP} SELECT doc_id, text_type, depth, array_to_string(words, ' ') AS text FROM deep",
    "words_per_round": f"WITH {DEEP} SELECT text_type, depth, {r('avg(len(words))')} AS mean_words, count(*) AS n FROM deep GROUP BY text_type, depth",
    "resume_point": f"WITH {DEEP}, s AS (SELECT doc_id FROM deep WHERE text_type = 'ai' AND depth = 3 AND doc_id NOT IN (SELECT doc_id FROM labels)) SELECT CASE WHEN count(*) > 0 THEN 2 ELSE {ROUNDS} END::BIGINT AS iteration, min(doc_id) AS first_key FROM s",
    "unpivot_depths": f"WITH {DEEP} SELECT doc_id, text_type, depth, array_to_string(words, ' ') AS text FROM deep",
    "combine_detections": f"WITH {DETECTED} SELECT doc_id, {r('z_score')} AS z_score, k AS num_green_tokens, depth, 'ai' AS text_type FROM detected WHERE text_type = 'ai'",
    "combine_labeled": f"WITH {DETECTED} SELECT doc_id, depth, bits AS \"0_1_sequence\", {r('z_score')} AS z_score, label FROM detected",
    "sequential_id": f"WITH {CUTS}, {IDS} SELECT * FROM ids",
    "validate_counts": f"WITH {DEEP}, c AS (SELECT depth, count(*) AS n, sum((label = 1)::BIGINT)::BIGINT AS n_ai, sum((label = 0)::BIGINT)::BIGINT AS n_human FROM deep GROUP BY depth) SELECT *, (SELECT count(DISTINCT n) <= 1 FROM c) AS consistent FROM c",
    "merge_outer": "WITH a AS (SELECT doc_id, n_chars FROM documents), b AS (SELECT doc_id, quality FROM labels), c AS (SELECT doc_id, toxic FROM labels) SELECT coalesce(a.doc_id, b.doc_id, c.doc_id) AS doc_id, n_chars, b.quality AS quality_x, c.toxic AS quality_y FROM a FULL JOIN b ON a.doc_id = b.doc_id FULL JOIN c ON coalesce(a.doc_id, b.doc_id) = c.doc_id",
    "merge_concat": "SELECT doc_id AS id, length(text)::INTEGER AS n, NULL::VARCHAR AS digest FROM documents UNION ALL SELECT item_id, NULL, md5(text) FROM benchmark",
    "windows": f"WITH {WINS} SELECT depth, id, win_idx::INTEGER AS win_idx, win_start::INTEGER AS win_start, win_end::INTEGER AS win_end, win FROM wins",
    "window_literal": f"WITH {COMBINED}, top AS (SELECT id, array_to_string(string_split(bits, ''), ',') AS commas FROM combined WHERE depth = 0), {windowed('top', 'id', 'commas')} SELECT id, win_idx::INTEGER AS win_idx, win_start::INTEGER AS win_start, win_end::INTEGER AS win_end, {r('z')} AS z, run::INTEGER AS run, freq::INTEGER AS freq FROM wins",
    "window_z": f"WITH {WINS} SELECT depth, id, win_idx::INTEGER AS win_idx, {r('z')} AS z FROM wins",
    "window_runs": f"WITH {WINS} SELECT depth, id, win_idx::INTEGER AS win_idx, run::INTEGER AS run, freq::INTEGER AS freq FROM wins",
    "window_stats": f"WITH {WINS}, {statistics('wins')} SELECT depth, id, {', '.join(f'{r(c)} AS {c}' for c in STATIC if 'autocorr' not in c)} FROM stats",
    "autocorr": f"WITH {WINS}, {statistics('wins')} SELECT depth, id, {r('z_autocorr_lag1')} AS z_autocorr_lag1, {r('z_autocorr_lag2')} AS z_autocorr_lag2 FROM stats",
    "rolling_features": f"WITH {WINS}, {statistics('wins')} SELECT c.depth, c.id, c.label, {r('c.z_score')} AS z_score, {', '.join(f'{r(f"coalesce(s.{c}, 0)")} AS {c}' for c in STATIC)} FROM combined c LEFT JOIN stats s USING (depth, id)",
    "rolling_wide": f"WITH {WINS} SELECT depth, id, {WIDE} FROM wins GROUP BY depth, id",
    "common_windows": f"WITH {WINS}, d AS (SELECT depth, max(win_idx) + 1 AS n FROM wins WHERE depth BETWEEN 1 AND 8 GROUP BY depth) SELECT min(n)::BIGINT AS n_windows FROM d",
    "pss_matrix": f"WITH {WINS}, {members((ALL_DEPTHS,))}, {PSS} SELECT id, win_idx::INTEGER AS win_idx, {r('pss')} AS pss FROM pss",
    "pss_sweep": f"WITH {WINS}, {members()}, {PSS} SELECT experiment, win_idx::INTEGER AS win_idx, count(*) AS n, {r('avg(pss)')} AS mean_pss, {r('max(pss)')} AS max_pss FROM pss GROUP BY experiment, win_idx",
    "pss_features": f"WITH {WINS}, {statistics('(SELECT * FROM wins WHERE depth = 1)')}, {members((ALL_DEPTHS,))}, {PSS}, p AS (SELECT id, {', '.join(f'max(CASE WHEN win_idx = {i} THEN pss END) AS pss_win{i + 1}' for i in range(9))} FROM pss GROUP BY id) SELECT c.id, c.label, {', '.join(f'{r(f"coalesce(p.pss_win{i + 1}, 0)")} AS pss_win{i + 1}' for i in range(9))}, {', '.join(f'{r(f"coalesce(s.{c}, 0)")} AS {c}' for c in STATIC)} FROM combined c LEFT JOIN stats s ON c.id = s.id LEFT JOIN p ON c.id = p.id WHERE c.depth = 1",
    "stratified_split": f"WITH {CUTS}, {IDS}, o AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('{SMALL.classifier.seed}:' || id), id) AS n, count(*) OVER (PARTITION BY label) AS total FROM ids) SELECT id, label, n <= ceil(total * {SMALL.classifier.test_size}::DOUBLE) AS is_test FROM o",
    "auc": f"WITH {DETECTED}, s AS (SELECT label, z_score AS s FROM detected WHERE depth = 0), v AS (SELECT s, sum((label = 1)::BIGINT) AS pos, sum((label = 0)::BIGINT) AS neg FROM s GROUP BY s), c AS (SELECT *, sum(neg) OVER (ORDER BY s) AS upto FROM v) SELECT {r('sum(pos * (upto - neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg))')} AS auc FROM c",
    "confusion_matrix": f"WITH {JUDGED}, c AS (SELECT {CELLS} FROM judged) SELECT [[tn, fp], [fn, tp]] AS confusion_matrix FROM c",
    "prf": f"WITH {JUDGED}, c AS (SELECT {CELLS} FROM judged) SELECT {', '.join(f'round({RATES[x]}, 4) AS {x}' for x in ('precision', 'recall', 'f1'))} FROM c",
    "metrics": f"WITH {JUDGED}, c AS (SELECT toxic, {CELLS} FROM judged GROUP BY toxic) SELECT *, {', '.join(f'{r(v)} AS {k}' for k, v in RATES.items())} FROM c",
    "best_experiment": f"WITH {WINS}, {members()}, {PSS}, m AS (SELECT experiment, position, round(avg(pss), 6) AS mean_pss FROM pss GROUP BY ALL) SELECT experiment, mean_pss FROM m ORDER BY mean_pss DESC, position LIMIT 1",
}

#: The polynomial fit of the normal distribution's upper tail that the query uses.
X = "(abs(z) / sqrt(2.0::DOUBLE))"
TAIL = "0"
for c in ERFC[::-1]:
    TAIL = f"({c!r}::DOUBLE + t * {TAIL})"
TAIL = f"(0.5::DOUBLE * t * exp({TAIL} - x * x))"
ORACLES["p_value"] = f"WITH {SCORED}, s AS (SELECT doc_id, text_type, {z('k', 't')} AS z FROM scored), x AS (SELECT *, {X} AS x, 1 / (1 + 0.5::DOUBLE * {X}) AS t FROM s) SELECT doc_id, text_type, {r('z')} AS z_score, {r(f'CASE WHEN z >= 0 THEN {TAIL} ELSE 1 - {TAIL} END')} AS p_value FROM x"
LIST_U = u(f"'{KEY}'", "prev", "token")
ORACLES["greenlist_words"] = f"WITH v AS (SELECT DISTINCT unnest({words('text')}) AS token FROM documents), p AS (SELECT prev, token FROM v, (SELECT DISTINCT lang AS prev FROM documents WHERE lang IS NOT NULL)), o AS (SELECT prev, token, row_number() OVER (PARTITION BY prev ORDER BY {LIST_U}, token) AS n FROM p) SELECT prev, token FROM o WHERE n <= floor((SELECT count(*) FROM v) * {GAMMA})"
WHOLE_BITS = f"marked AS (SELECT doc_id, {bits_of('words')} AS b FROM (SELECT doc_id, coalesce({words('text')}, []) AS words FROM documents)), whole AS (SELECT doc_id, array_to_string(b, '') AS bits, len(b) AS t, coalesce(list_sum(b), 0)::BIGINT AS k FROM marked)"
ORACLES["windows_docs"] = f"WITH {WHOLE_BITS}, {windowed('whole', 'doc_id', W=50, STEP=10)} SELECT doc_id, win_idx::INTEGER AS win_idx, win_start::INTEGER AS win_start, win_end::INTEGER AS win_end, win, {r('z')} AS z, run::INTEGER AS run, freq::INTEGER AS freq FROM wins"
ORACLES["windows_chunked"] = f"WITH {WHOLE_BITS}, {windowed('whole', 'doc_id', W=50, STEP=10)} SELECT doc_id, win_idx, win_start, win_end, {r('z')} AS z, run, freq FROM wins"
ORACLES["rolling_presets"] = " UNION ALL ".join(
    f"(WITH {WHOLE_BITS}, {windowed('whole', 'doc_id', W=size, STEP=step)}, {statistics('wins', 'doc_id')} SELECT whole.doc_id, {r(z('k', 't'))} AS z_score, '{name}' AS preset, {', '.join(f'round({r(f"coalesce(stats.{c}, 0)")}, 4) + 0.0::DOUBLE AS {c}' for c in STATIC)} FROM whole LEFT JOIN stats USING (doc_id))"
    for name, (size, step) in WINDOW_PRESETS.items()
)
ORACLES["detection_file"] = f"WITH w AS (SELECT doc_id, text, coalesce({words('text')}, []) AS words FROM documents), b AS (SELECT doc_id, text, {bits_of('words')} AS bits FROM w), s AS (SELECT *, len(bits) AS t, coalesce(list_sum(bits), 0)::BIGINT AS k FROM b) SELECT doc_id, array_to_string(bits, ',') AS watermark_bits, {r(z('k', 't'))} AS z_score, {r('CASE WHEN t > 0 THEN k::DOUBLE / t ELSE 0 END')} AS green_fraction, k AS green_token_count, t AS num_tokens_scored FROM s"



#: How often the twin walks on from a number beyond the vocabulary; no test table's vocabulary needs more.
WALKS = 8


def permuted(source: str) -> str:
    """CTEs that end in ``permuted``: ``source`` (prev, tok_id, size, ...) with ``place``."""
    word = lambda k: f"('0x' || substr(digest, {8 * k + 1}, 8))::BIGINT"
    steps = [f"""
shapes AS (SELECT size, root, unnest(range(greatest(root // 4, 0) + 1, root + 1)) AS a FROM (SELECT DISTINCT size, ceil(sqrt(size))::BIGINT AS root FROM {source})),
shape AS (SELECT size, a, (size + a - 1) // a AS b FROM shapes QUALIFY row_number() OVER (PARTITION BY size ORDER BY a * ((size + a - 1) // a), a DESC) = 1),
keyed AS (SELECT s.*, a, b, md5('{KEY}:' || prev) AS digest FROM {source} s JOIN shape USING (size)),
worded AS (SELECT * EXCLUDE (digest), [{', '.join(map(word, range(4)))}] AS ks, tok_id AS y, true AS moves FROM keyed)"""]
    last = "worded"
    for walk in range(WALKS + 1):
        steps.append(f"w{walk} AS (SELECT *, y // b AS l, y % b AS r FROM {last})")
        last = f"w{walk}"
        for k in range(6):
            moving, radix = ("r", "a") if k % 2 == 0 else ("l", "b")
            target = "l" if k % 2 == 0 else "r"
            steps += [
                f"m{walk}_{k} AS (SELECT *, (({moving} + ((ks[{k % 4 + 1}] + {k * 0x9E3779B9}) & 4294967295)) & 4294967295) AS v FROM {last})",
                f"n{walk}_{k} AS (SELECT * REPLACE (((xor(v, v >> 16)) * 73244475) & 4294967295 AS v) FROM m{walk}_{k})",
                f"o{walk}_{k} AS (SELECT * EXCLUDE (v) REPLACE (({target} + xor(v, v >> 16)) % {radix} AS {target}) FROM n{walk}_{k})",
            ]
            last = f"o{walk}_{k}"
        steps.append(f"p{walk} AS (SELECT * EXCLUDE (l, r) REPLACE (CASE WHEN moves THEN l * b + r ELSE y END AS y, moves AND l * b + r >= size AS moves) FROM {last})")
        last = f"p{walk}"
    return ", ".join([*steps, f"permuted AS (SELECT * EXCLUDE (ks, y, moves, a, b), y AS place FROM {last})"])


ORACLES["greenlist_exact"] = f"WITH {PAIRS}, tokens AS (SELECT unnest(words) AS token FROM halves), counts AS (SELECT token, count(*) AS n FROM tokens GROUP BY token), vocab AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS tok_id, count(*) OVER () AS size FROM counts), met AS (SELECT prev, pairs.token, tok_id, size FROM pairs JOIN vocab ON pairs.token = vocab.token), {permuted('met')} SELECT prev, token, tok_id, place, place < floor(size * {GAMMA}) AS green FROM permuted"
ORACLES["greenlist_exact_lists"] = f"WITH tokens AS (SELECT unnest({words('text')}) AS token FROM documents), counts AS (SELECT token, count(*) AS n FROM tokens GROUP BY token), vocab AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS tok_id, count(*) OVER () AS size FROM counts), met AS (SELECT prev, token, tok_id, size FROM vocab, (SELECT DISTINCT lang AS prev FROM documents WHERE lang IS NOT NULL)), {permuted('met')} SELECT prev, token FROM permuted WHERE place < floor(size * {GAMMA})"

#: All words of all documents in place of the sample halves.
DOCS = f"halves AS (SELECT doc_id, 'document' AS text_type, 0 AS label, coalesce({words('text')}, []) AS words FROM documents)"
ORACLES |= {f"{name}_docs": ORACLES[name].replace(CUTS, DOCS) for name in ("vocab", "token_ids", "greenlist_exact", "greenlist_hash", "bias_logits", "bigram_counts", "green_bits", "bits_csv", "score_unique_bigrams", "p_value", "detect_text", "score_sequence", "detect_prediction", "paraphrase_rounds", "words_per_round", "detect_all_depths", "detection_summary")}
ORACLES["window_literal_depths"] = f"WITH {COMBINED}, top AS (SELECT depth, id, array_to_string(string_split(bits, ''), ',') AS commas FROM combined), {windowed('top', 'depth, id', 'commas')} SELECT depth, id, win_idx::INTEGER AS win_idx, win_start::INTEGER AS win_start, win_end::INTEGER AS win_end, {r('z')} AS z, run::INTEGER AS run, freq::INTEGER AS freq FROM wins"

#: Longest-match segmentation of each distinct word: the longest piece at every place first, then the walk from piece to piece.
SUBWORDS = f"""
texts AS (SELECT doc_id, coalesce({words('text')}, []) AS words FROM documents),
tokens AS (SELECT unnest(words) AS token FROM texts),
counts AS (SELECT token, count(*) AS n FROM tokens GROUP BY token),
pieces AS MATERIALIZED (
  SELECT piece, row_number() OVER (ORDER BY piece) - 1 AS id FROM (
    SELECT token AS piece FROM (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS k FROM counts) WHERE k <= 5000
    UNION SELECT unnest(string_split(token, '')) FROM counts) WHERE piece <> ''),
ats AS (SELECT token, unnest(range(1, length(token) + 1)) AS spot FROM counts),
sizes AS (SELECT token, spot, unnest(range(1, least(length(token) - spot + 1, (SELECT max(length(piece)) FROM pieces)) + 1)) AS size FROM ats),
best AS MATERIALIZED (SELECT token, spot, max(size) AS size, arg_max(id, size) AS id FROM sizes JOIN pieces ON substr(token, spot, size) = piece GROUP BY token, spot),
walk(token, spot, size, id, k) AS (
  SELECT token, spot, size, id, 0 FROM best WHERE spot = 1
  UNION ALL SELECT b.token, b.spot, b.size, b.id, k + 1 FROM walk w JOIN best b ON b.token = w.token AND b.spot = w.spot + w.size),
segments AS MATERIALIZED (SELECT token, list((2 * id + (k > 0)::BIGINT)::INTEGER ORDER BY k) AS ids FROM walk GROUP BY token),
places AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM texts),
segmented AS MATERIALIZED (SELECT doc_id, coalesce(flatten(list(ids ORDER BY i) FILTER (WHERE ids IS NOT NULL)), []) AS words FROM texts LEFT JOIN places USING (doc_id) LEFT JOIN segments ON token = places.words[i] GROUP BY doc_id)"""
ORACLES["token_ids_subword"] = f"WITH RECURSIVE {SUBWORDS}, p AS (SELECT doc_id, words, unnest(range(0, len(words)))::INTEGER AS pos FROM segmented) SELECT doc_id, pos, words[pos + 1] AS tok_id FROM p"
ORACLES["detect_subword"] = f"WITH RECURSIVE {SUBWORDS}, b AS (SELECT doc_id, {bits_of('words')} AS bits FROM segmented), s AS (SELECT doc_id, len(bits) AS t, coalesce(list_sum(bits), 0)::BIGINT AS k FROM b) SELECT doc_id, {SCORES} FROM s"


def curve(source: str, score: str, by: str, name: str) -> str:
    """CTEs that end in ``name``: AUC and the operating point at 5 % false positives, for each group of ``by``."""
    same = " AND ".join(f"a.{c} IS NOT DISTINCT FROM c.{c}" for c in by.split(", "))
    return f"""
v_{name} AS (SELECT {by}, {score} AS s, sum((label = 1)::BIGINT) AS pos, sum((label = 0)::BIGINT) AS neg FROM {source} GROUP BY ALL),
c_{name} AS (
  SELECT *, sum(pos) OVER (PARTITION BY {by} ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY {by} ORDER BY s DESC) AS fp,
    sum(pos) OVER (PARTITION BY {by}) AS p, sum(neg) OVER (PARTITION BY {by}) AS n FROM v_{name}),
a_{name} AS (SELECT {by}, max(p) AS p, max(n) AS n, sum(pos * (n - fp + neg / 2.0)) AS pairs, min(s) FILTER (WHERE fp <= n * 0.05::DOUBLE) AS threshold FROM c_{name} GROUP BY {by}),
{name} AS (
  SELECT {', '.join(f'a.{c}' for c in by.split(', '))}, a.p::BIGINT AS n_pos, a.n::BIGINT AS n_neg, CASE WHEN a.p > 0 AND a.n > 0 THEN a.pairs / (a.p::DOUBLE * a.n) END AS auc, a.threshold,
    CASE WHEN a.p > 0 THEN c.tp::DOUBLE / a.p END AS tpr, CASE WHEN a.n > 0 THEN c.fp::DOUBLE / a.n END AS fpr
  FROM a_{name} a LEFT JOIN c_{name} c ON {same} AND a.threshold = c.s)"""


POINTS = ", ".join(f"{r(c)} AS {c}" for c in ("auc", "threshold", "tpr", "fpr"))
ORACLES["auc_by_depth"] = f"WITH {DETECTED}, {curve('detected', 'z_score', 'depth', 'points')} SELECT depth, n_pos, n_neg, {POINTS} FROM points"
ORACLES["auc_by_experiment"] = f"WITH {WINS}, {members()}, {PSS}, texts AS (SELECT experiment, label, {r('avg(pss)')} AS mean_pss FROM pss JOIN ids USING (id) GROUP BY experiment, id, label), {curve('texts', 'mean_pss', 'experiment', 'points')} SELECT experiment, n_pos, n_neg, {POINTS} FROM points"

#: Both halves of all words of all documents in place of the sample halves.
BOTH = f"""
uncut AS (SELECT doc_id, coalesce({words('text')}, []) AS words FROM documents),
halves AS (
  SELECT doc_id, 'human' AS text_type, 0 AS label, words[1:len(words) // 2] AS words FROM uncut
  UNION ALL SELECT doc_id, 'ai', 1, words[len(words) // 2 + 1:] FROM uncut)"""
SIDES = DEEP.replace(CUTS, BOTH)[:-1] + f" UNION ALL SELECT doc_id, text_type, label, d::INTEGER, []::VARCHAR[] FROM halves, range(0, {ROUNDS + 1}) t(d) WHERE len(words) = 0)"


def of_both(sql: str) -> str:
    """A twin over the sample halves as one over whole halves, with windows of the default size."""
    for source, *more in (("combined", "depth, id, label"), ("top", "depth, id", "commas")):
        sql = sql.replace(windowed(source, *more), windowed(source, *more, W=50, STEP=10))
    return sql.replace(DEEP, SIDES).replace(CUTS, BOTH)


ORACLES |= {f"{name}_docs": of_both(ORACLES[name]) for name in ("unpivot_depths", "combine_detections", "combine_labeled", "validate_counts", "resume_point", "sequential_id", "auc", "auc_by_depth", "window_literal_depths", "rolling_features", "common_windows", "pss_matrix", "pss_sweep", "auc_by_experiment", "best_experiment")}
