"""The same results in plain SQL over the given tables, for an independent engine (DuckDB dialect).

Each named step is a common table expression; `sql` adds the steps a statement mentions.
"""

from __future__ import annotations

import re

from checks.queries import (
    CONFIG, CORPUS_LIMIT, FIXED_COEFFICIENTS, FIXED_INTERCEPT, JUDGED_LIMIT,
)
from rankloom.functions.stopwords import ENGLISH_STOP_WORDS
from rankloom.operators.hybrid import ALPHA_GRID
from rankloom.operators.reranker import DEFAULT_PARAMS, INTERCEPT, PARAM_GRID
from rankloom.schemas import FEATURE_COLUMNS, FRAME_COLUMNS

DESCENT_STEPS = 1500

STOP_LIST = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS) + "]"


def _compress(x: str) -> str:
    return f"sign({x}) * ln(1 + abs({x}))"


def _round(columns: list[str], digits: int = 6) -> str:
    # Adding zero turns a rounded -0.0 into 0.0.
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


def _words(source: str, key: str) -> str:
    return (
        f"SELECT {key}, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS words "
        f"FROM {source}"
    )


def _grams(source: str, key: str) -> str:
    return f"""
        SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram
        FROM (SELECT {key}, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                                        lambda x: NOT list_contains({STOP_LIST}, x)) AS w
              FROM {source})"""


def _runs(source: str, key: str) -> str:
    rest = ", ".join(f"lead(term, {i}) OVER w" for i in range(1, 8))
    return f"""
        SELECT {key}, run FROM (
          SELECT {key}, concat_ws(' ', term, {rest}) AS run, lead(term, 7) OVER w AS last_term
          FROM (SELECT {key}, unnest(words) AS term, generate_subscripts(words, 1) AS pos FROM {source})
          WINDOW w AS (PARTITION BY {key} ORDER BY pos)) WHERE last_term IS NOT NULL"""


def _ranked(source: str, keys: str, depth: int, score: str = "score") -> str:
    return (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC, doc_id) "
        f"AS rank FROM {source}) WHERE rank <= {depth}"
    )


def _metrics(run: str, judged: str, keys: str) -> str:
    using = f"({keys})"
    return f"""
        SELECT {keys}, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END AS ndcg,
               CASE WHEN n_relevant > 0 THEN coalesce(precisions, 0) / n_relevant ELSE 0 END AS ap
        FROM (SELECT {keys}, sum(CASE WHEN place <= 10 THEN grade / log2(place + 1) ELSE 0 END) AS ideal,
                     sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) AS n_relevant
              FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY grade DESC, doc_id) AS place
                    FROM {judged}) GROUP BY {keys}) AS ideals
        LEFT JOIN (SELECT {keys}, sum(CASE WHEN rank <= 10 THEN grade / log2(rank + 1) ELSE 0 END) AS dcg,
                          sum(CASE WHEN grade > 0 THEN seen / rank ELSE 0 END) AS precisions
                   FROM (SELECT h.*, CAST(sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) OVER (
                                PARTITION BY {keys} ORDER BY rank ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS seen
                         FROM (SELECT * FROM {run} JOIN {judged} USING ({keys}, doc_id)) AS h)
                   GROUP BY {keys}) AS hits USING {using}"""


def _scaling(source: str) -> str:
    """Long rows (feature, value with NULL for missing) to feature, median, mean, std."""
    return f"""
        SELECT feature, median, mean,
               CASE WHEN std <= 1e-12 * greatest(abs(mean), 1.0) THEN 1.0 ELSE std END AS std
        FROM (SELECT feature, any_value(median) AS median, avg(filled) AS mean, stddev_pop(filled) AS std
              FROM (SELECT feature, coalesce(m.median, 0) AS median,
                           coalesce(v.value, m.median, 0) AS filled
                    FROM {source} AS v JOIN (SELECT feature, median(value) AS median FROM {source}
                                            GROUP BY feature) AS m USING (feature))
              GROUP BY feature)"""


def _long(source: str, columns: str = "") -> str:
    parts = [
        f"SELECT {columns} '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {source}"
        for f in FEATURE_COLUMNS
    ]
    return " UNION ALL ".join(parts)


def _features(pairs: str, queries: str) -> str:
    return f"""
        SELECT p.qid AS query_id, p.doc_id, p.split, coalesce(c.tfidf, 0.0) AS tfidf,
               CAST(0.0 AS DOUBLE) AS semantic_similarity, p.bm25,
               {_compress('p.bm25')} AS bm25_feature, 1.0::DOUBLE / p.rank AS bm25_rank_feature,
               o.common_terms, o.overlap_ratio, o.query_coverage, o.idf_overlap,
               {_compress('CAST(d.dl AS DOUBLE)')} AS doc_length_feature,
               {_compress('CAST(len(q.words) AS DOUBLE)')} AS query_length_feature,
               CAST(len(q.words) AS DOUBLE) / greatest(d.dl, 1) AS length_ratio, p.label
        FROM {pairs} AS p JOIN {queries}_overlap AS o USING (qid, doc_id)
        LEFT JOIN {queries}_cosine AS c USING (qid, doc_id)
        JOIN doc_stats AS d USING (doc_id) JOIN query_words AS q USING (qid)"""


def _overlap(pairs: str) -> str:
    return f"""
        SELECT p.qid, p.doc_id, coalesce(any_value(s.common), 0)::DOUBLE AS common_terms,
               coalesce(any_value(s.common), 0)::DOUBLE / greatest(len(list_distinct(any_value(q.words))), 1) AS overlap_ratio,
               coalesce(any_value(s.common), 0)::DOUBLE / greatest(len(any_value(q.words)), 1) AS query_coverage,
               coalesce(any_value(s.idf_sum), 0.0) AS idf_overlap
        FROM {pairs} AS p JOIN query_words AS q USING (qid)
        LEFT JOIN (SELECT p.qid, p.doc_id, count(*) AS common, round(sum(i.idf), 9) AS idf_sum
                   FROM {pairs} AS p JOIN query_terms AS t USING (qid)
                   JOIN postings AS o ON o.doc_id = p.doc_id AND o.term = t.term
                   JOIN term_stats AS i ON i.term = t.term GROUP BY p.qid, p.doc_id) AS s USING (qid, doc_id)
        GROUP BY p.qid, p.doc_id"""


def _cosine(pairs: str) -> str:
    return f"""
        SELECT p.qid, p.doc_id, round(sum(a.w * b.w), 9) AS tfidf
        FROM {pairs} AS p JOIN query_vectors AS a USING (qid)
        JOIN doc_vectors AS b ON b.doc_id = p.doc_id AND b.gram = a.gram
        GROUP BY p.qid, p.doc_id"""


def _vectors(grams: str, key: str) -> str:
    return f"""
        SELECT {key}, gram, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS w
        FROM (SELECT {key}, gram, count(*) * any_value(idf) AS raw
              FROM {grams} JOIN vocabulary USING (gram) GROUP BY {key}, gram)"""


def _margin() -> str:
    terms = [str(FIXED_INTERCEPT) + "::DOUBLE"]
    for f in FEATURE_COLUMNS:
        terms.append(
            f"(f.{f} - (SELECT mean FROM scaling WHERE feature = '{f}')) / "
            f"(SELECT std FROM scaling WHERE feature = '{f}') * ({FIXED_COEFFICIENTS[f]})::DOUBLE"
        )
    return " + ".join(terms)


def _scored(frame: str) -> str:
    return (
        f"SELECT *, 1.0 / (1.0 + exp(-greatest(-500.0, least(500.0, margin)))) AS score "
        f"FROM (SELECT f.*, {_margin()} AS margin FROM {frame} AS f)"
    )


def _scaled(source: str) -> str:
    def unit(c: str) -> str:
        low, high = (f"{fn}({c}) OVER (PARTITION BY query_id)" for fn in ("min", "max"))
        return f"CASE WHEN {high} <= {low} THEN 0.0 ELSE ({c} - {low}) / ({high} - {low}) END"

    return f"SELECT *, {unit('bm25')} AS lexical, {unit('score')} AS learned FROM {source}"


BROKEN_TFIDF = (
    "CASE WHEN label = 1 THEN 'inf'::DOUBLE WHEN bm25_rank_feature = 0.5 THEN 'nan'::DOUBLE ELSE tfidf END"
)
CLEAN_TFIDF = "CASE WHEN label = 1 OR bm25_rank_feature = 0.5 THEN NULL ELSE tfidf END"
SEED = CONFIG.random_state
K = CONFIG.bm25_top_k
M = CONFIG.negatives_per_query

STEPS: dict[str, str] = {
    "query_texts": "SELECT item_id AS qid, text FROM benchmark",
    "doc_words": _words("documents", "doc_id"),
    "query_words": _words("query_texts", "qid"),
    "occurrences": "SELECT doc_id, unnest(words) AS term FROM doc_words",
    "postings": "SELECT term, doc_id, count(*) AS tf FROM occurrences GROUP BY term, doc_id",
    "doc_stats": "SELECT doc_id, len(words) AS dl FROM doc_words",
    "size": "SELECT count(*) AS n, avg(dl) AS avgdl FROM doc_stats",
    "term_raw": """SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5::DOUBLE)
                   - ln(count(*) + 0.5::DOUBLE) AS raw FROM postings, size GROUP BY term""",
    "term_stats": """SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM term_raw)
                     ELSE raw END AS idf FROM term_raw""",
    "query_terms": """SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(words) AS term FROM query_words)
                      GROUP BY qid, term""",
    "scored_docs": """SELECT t.qid, p.doc_id, round(sum(t.qtf * i.idf * p.tf * 2.5::DOUBLE /
                        (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d.dl / s.avgdl))), 6) AS score
                      FROM query_terms AS t JOIN postings AS p USING (term) JOIN term_stats AS i USING (term)
                      JOIN doc_stats AS d USING (doc_id), size AS s GROUP BY t.qid, p.doc_id""",
    "every_score": """SELECT q.qid, d.doc_id, coalesce(s.score, 0.0) AS score
                      FROM query_texts AS q CROSS JOIN doc_stats AS d
                      LEFT JOIN scored_docs AS s ON s.qid = q.qid AND s.doc_id = d.doc_id""",
    "top_all": _ranked("every_score", "qid", K),
    "doc_runs": _runs("doc_words", "doc_id"),
    "query_runs": _runs("query_words", "qid"),
    "relevant": "SELECT DISTINCT qid, doc_id FROM doc_runs JOIN query_runs USING (run)",
    "qrels": """SELECT r.qid, r.doc_id, CAST(1 + coalesce(l.quality, 0) AS INTEGER) AS grade
                FROM relevant AS r LEFT JOIN labels AS l USING (doc_id)""",
    "eligible": "SELECT DISTINCT qid FROM qrels",
    "sampled": "SELECT qid FROM eligible",
    "split": f"""SELECT qid, CASE WHEN place <= greatest(1, least(floor(n * 0.2::DOUBLE), n - 1))
                 THEN 'test' ELSE 'train' END AS split
                 FROM (SELECT qid, row_number() OVER (ORDER BY md5('{SEED}:split:' || qid)) AS place,
                       count(*) OVER () AS n FROM sampled)""",
    "top": "SELECT * FROM top_all SEMI JOIN sampled USING (qid)",
    "judged_train": """SELECT q.qid, q.doc_id, q.grade FROM qrels AS q JOIN split USING (qid)
                       WHERE split = 'train'""",
    "positive_order": """SELECT qid, doc_id, row_number() OVER (PARTITION BY qid
                         ORDER BY grade DESC, coalesce(t.score, '-inf'::DOUBLE), doc_id) AS pick
                         FROM judged_train LEFT JOIN top AS t USING (qid, doc_id)""",
    "negative_order": """SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS pick
                         FROM (SELECT t.* FROM top AS t ANTI JOIN qrels USING (qid, doc_id)) AS u
                         JOIN split USING (qid) WHERE split = 'train'""",
    "lists": """SELECT qid, doc_id, score, rank AS top_rank FROM top UNION ALL
                SELECT qid, doc_id, NULL, NULL FROM (SELECT * FROM positive_order WHERE pick <= 1) AS p
                ANTI JOIN top USING (qid, doc_id)""",
    "listed": "SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM lists JOIN split USING (qid)",
    "pairs": f"""SELECT l.qid, l.doc_id, l.split, coalesce(l.score, 0.0) AS bm25,
                 coalesce(l.top_rank, l.n + 1) AS rank,
                 CASE WHEN j.doc_id IS NULL THEN 0 ELSE 1 END AS label
                 FROM listed AS l LEFT JOIN qrels AS j USING (qid, doc_id)
                 WHERE l.split = 'test' OR (l.qid, l.doc_id) IN
                 (SELECT (qid, doc_id) FROM positive_order WHERE pick <= 1 UNION ALL
                  SELECT (qid, doc_id) FROM negative_order WHERE pick <= {M})""",
    "train_docs": "SELECT DISTINCT doc_id FROM listed WHERE split = 'train'",
    "doc_grams": _grams("documents", "doc_id"),
    "query_grams": _grams("query_texts", "qid"),
    "vocabulary": """SELECT gram, df, ln((1.0::DOUBLE + (SELECT count(*) FROM train_docs)
                       + (SELECT count(*) FROM split WHERE split = 'train')) / (1.0::DOUBLE + df)) + 1.0 AS idf
                     FROM (SELECT gram, count(*) AS df FROM (
                       SELECT DISTINCT 'd' AS kind, doc_id AS id, gram FROM doc_grams SEMI JOIN train_docs USING (doc_id)
                       UNION ALL SELECT DISTINCT 'q', qid, gram FROM query_grams
                       WHERE qid IN (SELECT qid FROM split WHERE split = 'train')) GROUP BY gram)""",
    "doc_vectors": _vectors("doc_grams", "doc_id"),
    "query_vectors": _vectors("query_grams", "qid"),
    "pairs_overlap": _overlap("pairs"),
    "pairs_cosine": _cosine("pairs"),
    "frame": _features("pairs", "pairs"),
    "found": f"""SELECT qid, doc_id, 'inference' AS split, score AS bm25, rank, 0 AS label
                 FROM top_all WHERE rank <= 20""",
    "found_overlap": _overlap("found"),
    "found_cosine": _cosine("found"),
    "found_frame": _features("found", "found"),
    "train_rows": "SELECT * FROM frame WHERE split = 'train'",
    "train_long": _long("train_rows"),
    "scaling": _scaling("train_long"),
    "clean_rows": f"SELECT * REPLACE ({CLEAN_TFIDF} AS tfidf) FROM train_rows",
    "clean_long": _long("clean_rows", "query_id, doc_id,"),
    "scored": _scored("frame"),
    "blended": _scaled("scored"),
    "alphas": f"SELECT unnest([{', '.join(map(str, ALPHA_GRID))}]::DOUBLE[]) AS alpha",
    "alpha_scores": """SELECT alpha, query_id AS qid, doc_id,
                       round(alpha * lexical + (1.0 - alpha) * learned, 9) AS score
                       FROM blended CROSS JOIN alphas WHERE split = 'train'""",
    "alpha_run": _ranked("alpha_scores", "alpha, qid", 10),
    "alpha_judged": "SELECT * FROM judged_train CROSS JOIN alphas",
    "alpha_queries": _metrics("alpha_run", "alpha_judged", "alpha, qid"),
    "alpha_table": """SELECT alpha, round(avg(ndcg), 9) AS ndcg_at_10, round(avg(ap), 9) AS map
                      FROM alpha_queries GROUP BY alpha""",
    "chosen_alpha": "SELECT alpha, ndcg_at_10, map FROM alpha_table ORDER BY ndcg_at_10 DESC, alpha LIMIT 1",
    "judged_test": "SELECT q.* FROM qrels AS q JOIN split USING (qid) WHERE split = 'test'",
    "shallow": "SELECT qid, doc_id, score, rank FROM top WHERE rank <= 10",
    "shallow_metrics": _metrics("shallow", "qrels", "qid"),
    "ltr_scores": """SELECT query_id AS qid, doc_id, round(score, 9) AS score FROM scored
                     WHERE split = 'test'""",
    "ltr_run": _ranked("ltr_scores", "qid", 10),
    "hybrid_scores": """SELECT query_id AS qid, doc_id, round(alpha * lexical + (1.0 - alpha) * learned, 9) AS score
                        FROM blended, chosen_alpha WHERE split = 'test'""",
    "hybrid_best": _ranked("hybrid_scores", "qid", 10),
    "model_runs": """SELECT 'bm25' AS model, qid, doc_id, rank FROM shallow WHERE qid IN (SELECT qid FROM judged_test)
                     UNION ALL SELECT 'ltr', qid, doc_id, rank FROM ltr_run
                     UNION ALL SELECT 'hybrid', qid, doc_id, rank FROM hybrid_best""",
    "model_judged": "SELECT * FROM judged_test CROSS JOIN (SELECT unnest(['bm25', 'ltr', 'hybrid']) AS model)",
    "model_queries": _metrics("model_runs", "model_judged", "model, qid"),
    "found_scored": _scored("found_frame"),
    "found_blended": _scaled("found_scored"),
    "nation_texts": "SELECT n_nationkey AS qid, n_name AS text FROM nation",
    "nation_words": _words("nation_texts", "qid"),
    "nation_scores": """SELECT w.qid, d.doc_id, coalesce(s.score, 0.0) AS score
                        FROM nation_words AS w CROSS JOIN doc_stats AS d LEFT JOIN
                        (SELECT t.qid, p.doc_id, round(sum(i.idf * p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE *
                           (0.25::DOUBLE + 0.75::DOUBLE * d.dl / s.avgdl))), 6) AS score
                         FROM (SELECT qid, unnest(words) AS term FROM nation_words) AS t
                         JOIN postings AS p USING (term) JOIN term_stats AS i USING (term)
                         JOIN doc_stats AS d USING (doc_id), size AS s GROUP BY t.qid, p.doc_id) AS s
                        ON s.qid = w.qid AND s.doc_id = d.doc_id""",
    "judged_docs": "SELECT DISTINCT doc_id FROM qrels",
    "limited": f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY judged DESC,
                     CASE WHEN judged = 1 THEN doc_id END, hash) AS place
                   FROM (SELECT d.doc_id, CASE WHEN j.doc_id IS NULL THEN 0 ELSE 1 END AS judged,
                         md5('{SEED}:corpus:' || d.doc_id) AS hash
                         FROM documents AS d LEFT JOIN judged_docs AS j USING (doc_id)))
                   WHERE place <= """,
    "known_items": """SELECT doc_id AS qid, array_to_string(words[5:12], ' ') AS run FROM doc_words
                      WHERE len(words) >= 12""",
}
LIMITED = STEPS.pop("limited")


def _fold_steps() -> dict[str, str]:
    """Fits of every grid setting on the rows outside each fold, and on all rows (fit -1), by accelerated
    gradient descent in a recursive step."""
    width = len(FEATURE_COLUMNS) + 1
    zeros = f"CAST(list_resize([0.0], {width}, 0.0) AS DOUBLE[])"
    position = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(FEATURE_COLUMNS))
    settings = ", ".join(
        f"({i}, {p['C']}::DOUBLE, '{p['solver']}')" for i, p in enumerate(PARAM_GRID)
    )
    return {
        "fold_of": f"""SELECT query_id, CAST((row_number() OVER (ORDER BY query_id) - 1) %
                       least(greatest(2, {CONFIG.tuning_folds}), count(*) OVER ()) AS INTEGER) AS fold
                       FROM (SELECT DISTINCT query_id FROM train_rows)""",
        "fold_cells": f"""SELECT c.*, f.fold, t.label FROM ({_long("train_rows", "query_id, doc_id,")}) AS c
                          JOIN fold_of AS f USING (query_id) JOIN train_rows AS t USING (query_id, doc_id)""",
        "fold_fits": """SELECT fit FROM (SELECT DISTINCT fold AS fit FROM fold_of UNION ALL SELECT -1) JOIN fold_cells ON fold <> fit
                        GROUP BY fit HAVING count(DISTINCT label) = 2""",
        "fold_scale": """SELECT fit, feature, mean,
                         CASE WHEN std <= 1e-12 * greatest(abs(mean), 1.0) THEN 1.0 ELSE std END AS std
                         FROM (SELECT fit, feature, avg(value) AS mean, stddev_pop(value) AS std
                               FROM fold_fits JOIN fold_cells ON fold <> fit GROUP BY fit, feature)""",
        "fold_rows": f"""SELECT fit, query_id, doc_id, fold, label, list_append(
                           list((value - mean) / std ORDER BY CASE feature {position} END), 1.0) AS x
                         FROM fold_scale JOIN fold_cells USING (feature) GROUP BY ALL""",
        "fold_data": f"""SELECT fit, xs, ys, n, list_transform(ys, lambda y: CASE WHEN y > 0 THEN n / (2 * ones) ELSE n / (2 * (n - ones)) END) AS ws,
                           list_transform(range(1, {width + 1}), lambda j: list_transform(xs, lambda r: r[j])) AS cols
                         FROM (SELECT fit, list(x ORDER BY query_id, doc_id) AS xs,
                                 list(CAST(label > 0 AS DOUBLE) ORDER BY query_id, doc_id) AS ys,
                                 CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(label > 0 AS INTEGER)) AS DOUBLE) AS ones
                               FROM fold_rows WHERE fold <> fit GROUP BY fit)""",
        "grid_settings": f"SELECT * FROM (VALUES {settings}) AS v(setting, c, solver)",
        "grid_fits": f"""
            WITH RECURSIVE start AS (
              SELECT setting, fit, list_append(list_resize([1 / c], {width - 1}, 1 / c),
                                               CASE solver WHEN 'liblinear' THEN 1 / c ELSE 0.0 END) AS ridge,
                1 / (1 / c + list_sum(list_transform(range(1, CAST(n AS INTEGER) + 1),
                                                     lambda r: ws[r] * list_dot_product(xs[r], xs[r]))) / 4) AS pace,
                c
              FROM grid_settings CROSS JOIN fold_data
            ),
            descent AS (
              SELECT 0 AS i, setting, fit, {zeros} AS b, {zeros} AS z FROM start
              UNION ALL
              SELECT i + 1, setting, fit, moved AS b,
                list_transform(range(1, {width + 1}), lambda j: moved[j] + drift * (moved[j] - b[j])) AS z
              FROM (
                SELECT i, setting, fit, b, drift, list_transform(range(1, {width + 1}), lambda j:
                    z[j] - pace * (list_dot_product(off, cols[j]) + ridge[j] * z[j])) AS moved
                FROM (
                  SELECT d.*, s.ridge, s.pace, cols,
                    (1 - sqrt(s.pace / s.c)) / (1 + sqrt(s.pace / s.c)) AS drift,
                    list_transform(range(1, CAST(n AS INTEGER) + 1), lambda r:
                      ws[r] * (1 / (1 + exp(-list_dot_product(xs[r], d.z))) - ys[r])) AS off
                  FROM descent AS d JOIN start AS s USING (setting, fit) JOIN fold_data USING (fit) WHERE d.i < {DESCENT_STEPS}
                )
              )
            )
            SELECT setting, fit, b FROM descent WHERE i = {DESCENT_STEPS}""",
        "grid_scores": f"""SELECT setting, fold, query_id AS qid, doc_id, label,
                             round(1 / (1 + exp(-list_dot_product(x, b))), 9) AS score
                           FROM fold_rows JOIN grid_fits USING (fit) WHERE fold = fit""",
        "grid_run": _ranked("grid_scores", "setting, fold, qid", 10),
        "grid_judged": "SELECT setting, fold, qid, doc_id, label AS grade FROM grid_scores WHERE label > 0",
        "grid_queries": _metrics("grid_run", "grid_judged", "setting, fold, qid"),
        "grid_folds": "SELECT setting, fold, avg(ndcg) AS ndcg FROM grid_queries GROUP BY setting, fold",
    }


STEPS.update(_fold_steps())


def sql(statement: str) -> str:
    """The statement with every step it needs, in order of definition."""
    needed: set[str] = set()
    pending = [statement]
    while pending:
        text = pending.pop()
        for word in set(re.findall(r"[a-z_]+", text)):
            if word in STEPS and word not in needed:
                needed.add(word)
                pending.append(STEPS[word])
    ordered = [name for name in STEPS if name in needed]
    if not ordered:
        return statement
    body = ",\n".join(f"{name} AS MATERIALIZED ({STEPS[name]})" for name in ordered)
    return f"WITH {body}\n{statement}"


FRAME_NUMBERS = [c for c in FRAME_COLUMNS if c not in ("query_id", "doc_id", "split", "label")]
FRAME_SELECT = f"SELECT query_id, doc_id, split, {_round(FRAME_NUMBERS)}, label FROM "
SCORE_SELECT = "SELECT query_id, doc_id, split, round(score, 6) AS score FROM scored"
ALPHA_SELECT = "SELECT alpha, round(ndcg_at_10, 6) AS ndcg_at_10, round(map, 6) AS map FROM "
MODEL_SELECT = """SELECT model, round(round(avg(ndcg), 9), 6) AS ndcg_at_10, round(round(avg(ap), 9), 6) AS map
                  FROM model_queries GROUP BY model"""


def _search(score: str) -> str:
    return f"""SELECT qid, doc_id, round(score, 6) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
        FROM (SELECT query_id AS qid, doc_id, round({score}, 9) AS score FROM found_blended, chosen_alpha))
        WHERE rank <= 5"""


SEARCH_FIXED_ALPHA = "0.4::DOUBLE * lexical + 0.6::DOUBLE * learned"


def _spearman() -> str:
    return """
    SELECT feature_a, feature_b, round(round(coalesce(CASE WHEN isnan(c) THEN 0 ELSE c END, 0), 6), 5) + 0.0 AS correlation
    FROM (
      SELECT feature_a, feature_b,
             CASE WHEN min(ra) = max(ra) OR min(rb) = max(rb) THEN NULL ELSE corr(ra, rb) END AS c
      FROM (
        SELECT feature_a, feature_b,
          rank() OVER (PARTITION BY feature_a, feature_b ORDER BY va)
            + (count(*) OVER (PARTITION BY feature_a, feature_b, va) - 1) / 2.0::DOUBLE AS ra,
          rank() OVER (PARTITION BY feature_a, feature_b ORDER BY vb)
            + (count(*) OVER (PARTITION BY feature_a, feature_b, vb) - 1) / 2.0::DOUBLE AS rb
        FROM (SELECT a.feature AS feature_a, b.feature AS feature_b, a.value AS va, b.value AS vb
              FROM clean_long AS a JOIN clean_long AS b USING (query_id, doc_id)
              WHERE a.value IS NOT NULL AND b.value IS NOT NULL))
      GROUP BY feature_a, feature_b)"""


def _summary() -> str:
    return f"""
    SELECT feature, count(*) FILTER (value IS NULL) AS missing_count,
           round(avg(CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS missing_ratio,
           CASE WHEN feature = 'tfidf' THEN (SELECT count(*) FROM train_rows WHERE label = 1) ELSE 0 END AS inf_count,
           round(CASE WHEN count(value) = 0 THEN 0 ELSE var_samp(value) END, 6) AS variance,
           round(coalesce(avg(value), 0), 6) AS mean,
           round(CASE WHEN count(value) = 0 THEN 0 ELSE stddev_samp(value) END, 6) AS std
    FROM clean_long GROUP BY feature"""


def _contract() -> str:
    zero = "(SELECT count(*) FROM {0} WHERE {1})"
    repeated = "(SELECT count(*) FROM (SELECT {1} FROM {0} GROUP BY {1} HAVING count(*) > 1))"
    checks = {
        "corpus_null_id": zero.format("documents", "doc_id IS NULL"),
        "corpus_duplicate_id": repeated.format("documents", "doc_id"),
        "corpus_empty_text": zero.format("documents", "coalesce(text, '') = ''"),
        "queries_null_id": zero.format("query_texts", "qid IS NULL"),
        "queries_duplicate_id": repeated.format("query_texts", "qid"),
        "queries_empty_text": zero.format("query_texts", "coalesce(text, '') = ''"),
        "qrels_null": zero.format("qrels", "qid IS NULL OR doc_id IS NULL OR grade IS NULL"),
        "qrels_duplicate_pair": repeated.format("qrels", "qid, doc_id"),
        "dangling_doc_id": "(SELECT count(DISTINCT doc_id) FROM qrels ANTI JOIN documents USING (doc_id))",
        "dangling_qid": "(SELECT count(DISTINCT qid) FROM qrels ANTI JOIN query_texts USING (qid))",
    }
    return " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, {value} AS violations" for name, value in checks.items()
    )


STATEMENTS: dict[str, str] = {
    "load_dataset": """
        SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, length(d.text) AS n_chars, g.grades FROM documents AS d
        LEFT JOIN (SELECT doc_id, CAST(sum(grade) AS BIGINT) AS grades FROM qrels GROUP BY doc_id) AS g
        USING (doc_id)""",
    "input_contract": _contract(),
    "passage_qrels": "SELECT qid, doc_id, grade FROM qrels",
    "known_item_qrels": """SELECT DISTINCT k.qid, r.doc_id, 1 AS grade FROM known_items AS k
                           JOIN doc_runs AS r USING (run)""",
    "corpus_limit": LIMITED + str(CORPUS_LIMIT),
    "corpus_limit_judged": LIMITED + str(JUDGED_LIMIT),
    "qrels_restrict": f"""SELECT qid, doc_id, grade FROM qrels WHERE doc_id IN
                          (SELECT doc_id FROM judged_docs ORDER BY doc_id LIMIT {JUDGED_LIMIT})""",
    "eligible_queries": "SELECT qid FROM eligible",
    "query_sample": f"SELECT qid FROM eligible ORDER BY md5('{SEED}:sample:' || qid) LIMIT 10",
    "query_split": "SELECT qid, split FROM split",
    "subset_qrels": "SELECT qid, doc_id, grade FROM judged_test",
    "tokenize": "SELECT doc_id, len(words) AS n_tokens, array_to_string(words, ' ') AS token_text FROM doc_words",
    "compress_lengths": """SELECT doc_id, round(ln(1 + n_chars::DOUBLE), 6) AS up,
                           round(-ln(1 + n_chars::DOUBLE), 6) AS down FROM documents""",
    "postings": "SELECT term, doc_id, tf FROM postings",
    "doc_stats": "SELECT doc_id, dl FROM doc_stats",
    "term_idf": "SELECT term, df, round(idf, 6) AS idf FROM term_stats",
    "bm25_score": "SELECT qid, doc_id, score FROM scored_docs",
    "bm25_topk": "SELECT qid, doc_id, score, rank FROM top_all",
    "bm25_topk_padded": f"""SELECT qid, doc_id, score, rank FROM ({_ranked('nation_scores', 'qid', K)})""",
    "score_candidates": """SELECT q.qid, q.doc_id, coalesce(s.score, 0.0) AS score FROM qrels AS q
                           LEFT JOIN scored_docs AS s USING (qid, doc_id)""",
    "baseline_run": """SELECT s.qid, s.doc_id, s.score, s.rank FROM shallow AS s JOIN split USING (qid)
                       WHERE split = 'test'""",
    "positives": "SELECT qid, doc_id, pick FROM positive_order WHERE pick <= 2",
    "negatives": f"SELECT qid, doc_id, pick FROM negative_order WHERE pick <= {M}",
    "candidate_lists": """
        WITH near AS (SELECT * FROM top WHERE rank <= 3),
        chosen AS (SELECT * FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid
                   ORDER BY grade DESC, coalesce(t.score, '-inf'::DOUBLE), doc_id) AS pick
                   FROM judged_train LEFT JOIN near AS t USING (qid, doc_id)) WHERE pick <= 2),
        both_parts AS (SELECT qid, doc_id, score, rank AS top_rank, rank AS place FROM near UNION ALL
                       SELECT qid, doc_id, NULL, NULL, 100 + pick FROM chosen ANTI JOIN near USING (qid, doc_id))
        SELECT qid, split, doc_id, row_number() OVER (PARTITION BY qid ORDER BY place) AS pos, score, top_rank,
               count(*) OVER (PARTITION BY qid) AS n_candidates
        FROM both_parts JOIN split USING (qid)""",
    "candidate_docs": "SELECT doc_id, bool_or(split = 'train') AS in_train FROM listed GROUP BY doc_id",
    "train_pairs": "SELECT qid, doc_id, split, bm25, rank FROM pairs",
    "candidate_ranks": """SELECT qid, doc_id, 'inference' AS split, score AS bm25,
                          row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM top""",
    "tfidf_vocab": "SELECT gram, df, round(idf, 6) AS idf FROM vocabulary",
    "tfidf_cosine": "SELECT qid, doc_id, round(tfidf, 6) AS tfidf FROM pairs_cosine",
    "semantic_similarity": """
        SELECT a.vec_id AS qid, a.vec_id + 1 AS doc_id,
               round(coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0.0), 6)
               + 0.0 AS semantic_similarity
        FROM embeddings AS a LEFT JOIN embeddings AS b ON b.vec_id = a.vec_id + 1""",
    "vector_dot": """SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS squared
                     FROM embeddings""",
    "overlap_features": f"""SELECT qid, doc_id, {_round(['common_terms', 'overlap_ratio', 'query_coverage',
                            'idf_overlap'])} FROM pairs_overlap""",
    "length_features": f"""SELECT query_id AS qid, doc_id, {_round(['doc_length_feature', 'query_length_feature',
                           'length_ratio'])} FROM frame""",
    "retrieval_features": f"""SELECT qid, doc_id, split, round(bm25, 6) AS bm25, rank,
                              round({_compress('bm25')}, 6) AS bm25_feature,
                              round(1.0::DOUBLE / rank, 6) AS bm25_rank_feature FROM pairs""",
    "labels": "SELECT qid, doc_id, split, label FROM pairs",
    "feature_frame": FRAME_SELECT + "frame",
    "inference_frame": FRAME_SELECT + "found_frame",
    "sanitize": f"""SELECT query_id, doc_id, round({CLEAN_TFIDF}, 6) AS tfidf,
                    round(bm25_feature, 6) AS bm25_feature FROM frame""",
    "scaling": f"SELECT feature, {_round(['median', 'mean', 'std'])} FROM ({_scaling('clean_long')})",
    "impute_scale": "SELECT query_id, doc_id, " + ", ".join(
        f"round((f.{f} - (SELECT mean FROM scaling WHERE feature = '{f}')) / "
        f"(SELECT std FROM scaling WHERE feature = '{f}'), 6) + 0.0 AS {f}" for f in FEATURE_COLUMNS
    ) + " FROM train_rows AS f",
    "class_weights": """SELECT label, count(*) AS n,
                        round((SELECT count(*) FROM train_rows) / (2.0::DOUBLE * count(*)), 6) AS weight
                        FROM train_rows GROUP BY label""",
    "query_folds": f"""SELECT query_id, CAST((row_number() OVER (ORDER BY query_id) - 1) %
                       least(greatest(2, {CONFIG.tuning_folds}), count(*) OVER ()) AS INTEGER) AS fold
                       FROM (SELECT DISTINCT query_id FROM train_rows)""",
    "reranker_fit": f"""SELECT unnest([{", ".join(f"'{f}'" for f in FEATURE_COLUMNS)}, '{INTERCEPT}']) AS feature,
                       unnest(list_transform(b, lambda w: round(w, 4) + 0.0)) AS coefficient
                       FROM grid_fits WHERE fit = -1 AND setting = {PARAM_GRID.index(DEFAULT_PARAMS)}""",
    "tuning_grid": """SELECT c, solver, list(round(ndcg, 6) ORDER BY fold) AS fold_scores, round(avg(ndcg), 6) AS mean_ndcg_at_10
                      FROM grid_settings JOIN grid_folds USING (setting) GROUP BY setting, c, solver""",
    "frame_qrels": "SELECT query_id AS qid, doc_id, label AS grade FROM frame WHERE label > 0",
    "feature_summary": _summary(),
    "spearman_matrix": _spearman(),
    "score_fixed": SCORE_SELECT,
    "minmax_norm": f"SELECT query_id, doc_id, {_round(['lexical', 'learned'])} FROM blended",
    "hybrid_blend": f"SELECT query_id, doc_id, round({SEARCH_FIXED_ALPHA}, 6) AS hybrid_score FROM blended",
    "alpha_grid": ALPHA_SELECT + "alpha_table",
    "best_alpha": ALPHA_SELECT + "chosen_alpha",
    "hybrid_run": f"""SELECT qid, doc_id, round(score, 6) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
        FROM (SELECT query_id AS qid, doc_id, round({SEARCH_FIXED_ALPHA}, 9) AS score FROM blended
              WHERE split = 'test')) WHERE rank <= 10""",
    "reranked_run": "SELECT qid, doc_id, round(score, 6) AS score, rank FROM ltr_run",
    "ndcg_at_10": "SELECT qid, round(ndcg, 6) AS ndcg FROM shallow_metrics",
    "average_precision": "SELECT qid, round(ap, 6) AS ap FROM shallow_metrics",
    "evaluate_run": """SELECT round(round(avg(ndcg), 9), 6) AS ndcg_at_10, round(round(avg(ap), 9), 6) AS map
                       FROM shallow_metrics""",
    "model_comparison": MODEL_SELECT,
    "search_bm25": "SELECT qid, doc_id, score, rank FROM top_all WHERE rank <= 5",
    "search_ltr": _search("learned_raw").replace("learned_raw", "found_blended.score"),
    "search_hybrid": _search(SEARCH_FIXED_ALPHA),
    "result_preview": """SELECT t.qid, t.rank, t.doc_id, t.score, CAST(NULL AS VARCHAR) AS title,
                         substr(trim(replace(d.text, chr(10), ' '), ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
                         1, 220) AS text_preview FROM top_all AS t JOIN documents AS d USING (doc_id)
                         WHERE t.rank <= 5""",
    "feature_sink": FRAME_SELECT + "frame",
    "feature_sink_csv": FRAME_SELECT + "frame",
    "scored_sink": SCORE_SELECT,
    "hybrid_sink": """SELECT query_id, doc_id, round(alpha * lexical + (1.0 - alpha) * learned, 6) AS hybrid_score
                      FROM blended, chosen_alpha""",
    "metric_sink": MODEL_SELECT,
    "run_summary": """SELECT (SELECT count(*) FROM split WHERE split = 'train') AS train_queries,
                      (SELECT count(*) FROM split WHERE split = 'test') AS test_queries,
                      (SELECT count(*) FROM frame) AS feature_rows""",
    "reloaded_model": SCORE_SELECT,
    "saved_search": _search("alpha * lexical + (1.0 - alpha) * learned"),
}

ORACLE = {name: sql(text) if not text.lstrip().startswith("WITH") else None for name, text in STATEMENTS.items()}
for _name, _text in STATEMENTS.items():
    if ORACLE[_name] is None:
        # The statement brings its own steps: append them after the shared ones.
        _inner = _text.lstrip()[len("WITH"):]
        _shared = sql(_text)
        ORACLE[_name] = _shared.replace("\n" + _text, ",\n" + _inner, 1)
