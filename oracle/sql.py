"""DuckDB statements that answer each query of the catalog independently.

RE2 knows ASCII word boundaries only and has no look-around. `folded` text
therefore has every other letter, digit or mark replaced by `_` and every other
sign by a blank, which leaves ASCII words and the boundaries around them as
they were.
"""

from __future__ import annotations

from casewright import lexicons as lx
from casewright.plans.overlay import SENTENCES

ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(items) -> str:
    return ", ".join(q(i) for i in items)


def word_list(items) -> str:
    return f"(SELECT unnest([{values(items)}]) AS term)"


# --- building blocks -------------------------------------------------------

SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def folded(x: str) -> str:
    signs = rf"regexp_replace({x}, '[^\x00-\x7F\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}]', ' ', 'g')"
    return rf"regexp_replace({signs}, '[^\x00-\x7F]', '_', 'g')"


def hit(term: str, low: str = "low") -> str:
    pattern = rf"\b{term[:-1]}" if term.endswith("*") else rf"\b{term}\b"
    return f"regexp_matches({low}, {q(pattern)})"


def hits(terms, low: str = "low") -> str:
    return " + ".join(f"CAST({hit(t, low)} AS INTEGER)" for t in terms)


def sub(x: str, pattern: str, new: str, options: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(new)}, {q(options)})"


HEADERS = [
    (rf"(?m)^.{{3,60}}\d{{1,2}}/\d{{1,2}}/\d{{4}}[{SPACE}]*$", " "),
    (r"(?i)For Educational Use Only", " "),
    (rf"(?is)©?[{SPACE}]*\d{{4}}[{SPACE}]*Thomson Reuters\..*?Works\.", " "),
    (rf"(?m)^\d{{4}} WL \d+[{SPACE}]*$", " "),
    (r"(?i)Only the Westlaw citation is currently available\.", " "),
    (rf"\d+[{SPACE}]+(?:F\.\d[a-z]*|S\.Ct\.|U\.S\.|F\.Supp\.\d*|L\.Ed\.\d*|U\.S\.[{SPACE}]*Dist\.[{SPACE}]*LEXIS)[{SPACE}]+\d+", " "),
    (rf"(?i)Case No\.?[{SPACE}]+[\p{{L}}\p{{N}}_:\-]+", " "),
    (rf"(?m)^\|[{SPACE}]*$", " "),
    (rf"(?m)^Signed[{SPACE}]+\d{{2}}/\d{{2}}/\d{{4}}[{SPACE}]*$", " "),
    (r"(?is)Attorneys and Law Firms.*?(\n[A-Z]{2}|\z)", r" \1"),
]


def collapsed(x: str) -> str:
    x = sub(sub(x, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    return sub(x, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def stripped(x: str) -> str:
    for pattern, new in HEADERS:
        x = sub(x, pattern, new)
    return collapsed(x)


def masked_context(x: str) -> str:
    triggers, terms = "|".join(lx.OUTCOME_TRIGGERS), "|".join(lx.OUTCOME_TERMS)
    return sub(x, rf"(?i)((?:{triggers})[{SPACE}]+)(?:{terms})", r"\1[OUTCOME]")


def masked(x: str) -> str:
    terms = "|".join(t.upper() for t in lx.OUTCOME_TERMS)
    # A boundary is a neighbour that is no letter, digit or underscore; the
    # neighbours are kept, and two passes catch terms that share one.
    pattern = rf"(^|[^\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}])(?:{terms})($|[^\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}])"
    once = sub(masked_context(x), pattern, r"\1[OUTCOME]\2")
    return sub(once, pattern, r"\1[OUTCOME]\2")


def cleaned(x: str) -> str:
    return masked(stripped(x))


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {q(rf'[^{SPACE}]+')})"


def analysis(x: str) -> str:
    word = r"[^\p{L}\p{N}\p{M}\p{Pc}]"
    x = f"replace({x}, '[OUTCOME]', '')"
    number = rf"(^|{word})\d+($|{word})"
    # Neighbouring numbers share a sign, so the second pass takes every other one.
    x = sub(sub(x, number, r"\1 \2"), number, r"\1 \2")
    return sub(sub(x, rf"[{SPACE}]+", " "), r"\A +| +\z", "")


def alpha(x: str) -> str:
    return f"regexp_extract_all({folded(f'lower({x})')}, {q(chr(92) + 'b[a-z][a-z' + chr(39) + chr(92) + '-]+' + chr(92) + 'b')})"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(chr(91) + chr(92) + 'p{L}' + chr(92) + 'p{N}_]{2,}')})"


def label_of(order: str) -> str:
    first, second, third = order
    top = "greatest(pillar_E, pillar_S, pillar_G)"
    return (
        f"CASE WHEN {top} = 0 THEN 'Non-ESG' WHEN pillar_{first} = {top} THEN '{first}' "
        f"WHEN pillar_{second} = {top} THEN '{second}' ELSE '{third}' END"
    )


_CASES = " ".join(f"WHEN {i} THEN {q(s)}" for i, s in enumerate(SENTENCES))


def filename(number: str) -> str:
    return (
        f"lpad(CAST({number} % 40 AS VARCHAR), 3, '0') || '-Case' || "
        f"CAST(CAST(floor({number} / 3) AS BIGINT) AS VARCHAR) || '.md'"
    )


COURT = "CASE " + " ".join(
    f"WHEN regexp_matches(text, {q('(?i)' + '|'.join(p).replace('.', chr(92) + '.'))}) THEN {q(n)}"
    for n, p in lx.COURTS.items()
) + " ELSE 'Other' END"

YEARS = rf"regexp_extract_all({folded('substring(text, 1, 2000)')}, '\b(20[0-9]{{2}})\b', 1)"

CTES = {
    "corpus": f"""SELECT doc_id, {filename('doc_id')} AS filename,
        CASE CAST(doc_id % 10 AS INTEGER) {_CASES} END || ' ' || text AS text FROM documents""",
    "lowered": f"SELECT *, {folded('lower(text)')} AS low FROM corpus",
    "scored": f"""SELECT doc_id, filename, text,
        CAST({hits(lx.NOISE_TERMS)} AS INTEGER) AS noise_terms,
        CAST({hits(lx.ESG_SIGNAL_TERMS)} AS INTEGER) AS esg_hits,
        CAST({hits(lx.PILLAR_E_TERMS)} AS INTEGER) AS pillar_E,
        CAST({hits(lx.PILLAR_S_TERMS)} AS INTEGER) AS pillar_S,
        CAST({hits(lx.PILLAR_G_TERMS)} AS INTEGER) AS pillar_G,
        CAST({hits(lx.SUSTAINABILITY_TERMS)} AS INTEGER) AS pillar_Sus,
        CAST({hits(lx.NOISE_DOMAIN_TERMS)} AS INTEGER) AS noise_hits
        FROM lowered""",
    "ruled": f"""SELECT *,
        CASE WHEN noise_terms > 0 AND esg_hits < 3 THEN 'exclude' WHEN esg_hits = 0 THEN 'exclude'
             ELSE 'retain' END AS decision,
        {label_of('GES')} AS label, {label_of('ESG')} AS inferred_pillar,
        CAST(pillar_Sus > 0 AS INTEGER) AS is_sustainability,
        CAST(regexp_matches(text, '(?i)greenwash') AS INTEGER) AS is_greenwash
        FROM scored""",
    "years": f"SELECT filename, unnest({YEARS}) AS y, generate_subscripts({YEARS}, 1) AS pos FROM corpus",
    "year_of": """SELECT corpus.filename, coalesce(best.y, 'unknown') AS year FROM corpus LEFT JOIN (
        SELECT filename, y FROM (SELECT filename, y, count(*) AS n, min(pos) AS first FROM years GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY filename ORDER BY n DESC, first) = 1) best USING (filename)""",
    "metadata": f"""SELECT ruled.filename, CAST(strlen(text) AS BIGINT) AS size_bytes, year,
        {COURT} AS court, pillar_E, pillar_S, pillar_G, pillar_Sus, noise_hits, is_greenwash,
        is_sustainability, inferred_pillar FROM ruled JOIN year_of USING (filename)""",
    "labelled": """SELECT filename, label, is_sustainability, is_greenwash, pillar_E AS E_score,
        pillar_S AS S_score, pillar_G AS G_score, pillar_Sus AS sus_score,
        greatest(pillar_E, pillar_S, pillar_G) AS signal_strength FROM ruled""",
    "clean": f"""SELECT filename, label, decision, is_sustainability, is_greenwash, {cleaned('text')} AS cleaned_text
        FROM ruled""",
    "audited": f"""SELECT *, CAST(len({tokens('cleaned_text')}) AS INTEGER) AS token_count,
        CAST(len({tokens('cleaned_text')}) > 512 AS INTEGER) AS exceeds_512 FROM clean""",
    "masks": r"""SELECT filename, label, is_sustainability, is_greenwash, token_count, exceeds_512,
        CAST(len(regexp_extract_all(cleaned_text, '\[OUTCOME\]')) AS INTEGER) AS outcome_mask_count FROM audited""",
    "dedup": rf"""SELECT filename, regexp_replace(regexp_replace(filename, '\.[^.]*$', ''), '^[0-9]+-', '') AS case_name,
        TRY_CAST(regexp_extract(filename, '^([0-9]+)', 1) AS BIGINT) AS prefix FROM corpus""",
    "dedup_status": """SELECT filename, case_name, CASE WHEN row_number() OVER (
        PARTITION BY case_name ORDER BY prefix NULLS LAST, filename) = 1 THEN 'canonical' ELSE 'duplicate' END AS status
        FROM dedup""",
    # models made of rules
    "majority": "SELECT label AS top FROM ruled GROUP BY label ORDER BY count(*) DESC, label LIMIT 1",
    "base": """SELECT filename, label AS actual, inferred_pillar, pillar_E AS e, pillar_S AS s, pillar_G AS g,
        is_greenwash, pillar_E + pillar_S + pillar_G + 2.0::DOUBLE AS mass,
        least(length(text) / 100000.0::DOUBLE, 1.0::DOUBLE) AS size FROM ruled""",
    "predictions": """
        SELECT filename, actual, 'pillar_rule' AS model, inferred_pillar AS predicted,
            (e + 0.5::DOUBLE) / mass AS p_0, (g + 0.5::DOUBLE) / mass AS p_1, 0.5::DOUBLE / mass AS p_2,
            (s + 0.5::DOUBLE) / mass AS p_3 FROM base
        UNION ALL SELECT filename, actual, 'keyword_rule',
            CASE WHEN is_greenwash = 1 OR e >= 2 THEN 'E' WHEN g > 0 THEN 'G' WHEN s > 0 THEN 'S' ELSE 'Non-ESG' END,
            (e + size) / mass, (g + size) / mass, size / mass, (s + size) / mass FROM base
        UNION ALL SELECT filename, actual, 'majority_class', top,
            CAST(top = 'E' AS INTEGER)::DOUBLE, CAST(top = 'G' AS INTEGER)::DOUBLE,
            CAST(top = 'Non-ESG' AS INTEGER)::DOUBLE, CAST(top = 'S' AS INTEGER)::DOUBLE
            FROM base, majority""",
    "rule_scores": " UNION ALL ".join(
        f"SELECT model, '{c}' AS class, CAST(actual = '{c}' AS INTEGER) AS y, p_{i} AS score FROM predictions"
        for i, c in enumerate(lx.CLASSES)
    ),
    "scores": """SELECT * FROM rule_scores UNION ALL
        SELECT 'length', 'quality', quality, n_chars::DOUBLE FROM labels JOIN documents USING (doc_id)""",
    "classes": f"SELECT unnest([{values(lx.CLASSES)}]) AS class",
    "confusion": """SELECT model, actual, predicted, count(filename) AS n FROM (
        SELECT model, a.class AS actual, p.class AS predicted
        FROM (SELECT DISTINCT model FROM predictions) CROSS JOIN classes a CROSS JOIN classes p)
        LEFT JOIN predictions USING (model, actual, predicted) GROUP BY ALL""",
    # rank-sum statistic with mean ranks for ties
    "ranked": """SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY model, class, score) - 1) / 2.0 AS r
        FROM scores WINDOW w AS (PARTITION BY model, class ORDER BY score)""",
    "auc": """SELECT model, class, coalesce((sum(r) FILTER (y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0)
        / nullif(count_if(y = 1)::DOUBLE * count_if(y = 0), 0), 0.5)::DOUBLE AS auc FROM ranked GROUP BY ALL""",
    "split": """SELECT filename, label, CASE WHEN r <= round(0.15 * n) THEN 'test'
        WHEN r <= round(0.15 * n) + round(0.15 * n) THEN 'val' ELSE 'train' END AS split FROM (
        SELECT filename, label, count(*) OVER (PARTITION BY label) AS n,
            row_number() OVER (PARTITION BY label ORDER BY md5('42|' || filename), filename) AS r FROM {rows})""",
    "folds": """SELECT seed, filename, label, inferred_pillar, CAST((row_number() OVER (
        PARTITION BY seed, label ORDER BY md5(seed || '|' || filename), filename) - 1) % 3 + 1 AS INTEGER) AS fold
        FROM ruled CROSS JOIN (SELECT unnest([42, 123, 7]) AS seed)""",
    # terms
    "alpha_tokens": f"""SELECT filename, label, list_filter({alpha(analysis('cleaned_text'))},
        lambda t: t NOT IN ({values(lx.STOP_WORDS)})) AS toks FROM clean""",
    "plain_terms": f"SELECT filename, unnest({alpha('text')}) AS term FROM corpus",
    "plain_counts": """SELECT term, count(*) AS count, count(DISTINCT filename) AS df FROM plain_terms GROUP BY term""",
    "label_terms": "SELECT label, filename, unnest(toks) AS term FROM alpha_tokens",
    "label_counts": """SELECT label, term, count(*) AS count, count(DISTINCT filename) AS df FROM label_terms
        GROUP BY label, term""",
    # TF-IDF of the retained corpus
    "kept": "SELECT filename, label, cleaned_text FROM clean WHERE decision = 'retain'",
    "kept_words": f"SELECT filename, {words('cleaned_text')} AS w FROM kept",
    "grams": """SELECT filename, unnest(w) AS term FROM kept_words UNION ALL
        SELECT filename, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM kept_words""",
    "tf": "SELECT filename, term, count(*) AS tf FROM grams GROUP BY ALL",
    "vocab": """SELECT term, count, df, ln((n + 1)::DOUBLE / (df + 1)) + 1 AS idf FROM (
        SELECT term, CAST(sum(tf) AS BIGINT) AS count, count(*) AS df FROM tf JOIN split USING (filename)
        WHERE split = 'train' GROUP BY term HAVING count(*) >= 3 ORDER BY count DESC, term LIMIT {features}),
        (SELECT count(*) AS n FROM split WHERE split = 'train')""",
    "raw_weights": "SELECT filename, term, (1 + ln(tf)) * idf AS raw FROM tf JOIN vocab USING (term)",
    "weights": """SELECT filename, label, split, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY filename)) AS weight
        FROM raw_weights JOIN split USING (filename)""",
    "class_means": """SELECT label, term, round(sum(weight) / n, 6) AS mean_weight FROM weights
        JOIN (SELECT label, count(*) AS n FROM split GROUP BY label) USING (label) GROUP BY label, term, n""",
    # complement naive Bayes in closed form
    "class_sums": "SELECT label, term, sum(weight) AS s FROM weights WHERE split = 'train' GROUP BY ALL",
    "rest": """SELECT class, term, coalesce(sum(s) FILTER (label <> class), 0) + 0.5::DOUBLE AS rest
        FROM vocab CROSS JOIN classes LEFT JOIN class_sums USING (term) GROUP BY ALL""",
    "coefs": "SELECT class, term, -ln(rest / sum(rest) OVER (PARTITION BY class)) AS coef FROM rest",
    "means": """SELECT term, sum(weight) / (SELECT count(*) FROM split WHERE split = 'train') AS mean_weight
        FROM weights WHERE split = 'train' GROUP BY term""",
    "contributions": """SELECT filename, class, term, coef * (weight - coalesce(mean_weight, 0)) AS contribution
        FROM weights JOIN coefs USING (term) LEFT JOIN means USING (term) WHERE split = 'test'""",
    "raw_scores": """SELECT filename, label, class, sum(coalesce(weight * coef, 0)) AS score FROM (
        SELECT filename, label FROM split WHERE split = 'test') CROSS JOIN classes
        LEFT JOIN weights USING (filename, label) LEFT JOIN coefs USING (class, term) GROUP BY ALL""",
}

# Each entry names the entries it reads.
NEEDS = {
    "corpus": [], "lowered": ["corpus"], "scored": ["lowered"], "ruled": ["scored"],
    "years": ["corpus"], "year_of": ["years"], "metadata": ["ruled", "year_of"],
    "labelled": ["ruled"], "clean": ["ruled"], "audited": ["clean"], "masks": ["audited"],
    "dedup": ["corpus"], "dedup_status": ["dedup"],
    "majority": ["ruled"], "base": ["ruled"], "predictions": ["base", "majority"],
    "rule_scores": ["predictions"], "scores": ["rule_scores"], "classes": [],
    "confusion": ["predictions", "classes"], "ranked": ["scores"], "auc": ["ranked"],
    "split": ["ruled"], "folds": ["ruled"],
    "alpha_tokens": ["clean"], "plain_terms": ["corpus"], "plain_counts": ["plain_terms"],
    "label_terms": ["alpha_tokens"], "label_counts": ["label_terms"],
    "kept": ["clean"], "kept_words": ["kept"], "grams": ["kept_words"], "tf": ["grams"],
    "vocab": ["tf", "split"], "raw_weights": ["vocab"], "weights": ["raw_weights"],
    "class_means": ["weights"], "class_sums": ["weights"], "rest": ["class_sums", "classes"],
    "coefs": ["rest"], "means": ["weights"], "contributions": ["coefs", "means"],
    "raw_scores": ["coefs", "weights"],
}

def oracle(name: str, reads: list[str], body: str, rows: str = "ruled", features: int = lx.MAX_FEATURES) -> None:
    """Register a statement with the entries it needs, in order."""
    ordered: list[str] = []

    def visit(cte: str) -> None:
        for need in NEEDS[cte]:
            visit(need)
        if cte not in ordered:
            ordered.append(cte)

    for cte in reads:
        visit(cte)
    parts = []
    for cte in ordered:
        sql = CTES[cte]
        if cte == "split":
            sql = sql.replace("{rows}", rows)
        if cte == "vocab":
            sql = sql.replace("{features}", str(features))
        parts.append(f"{cte} AS MATERIALIZED ({sql})")
    ORACLES[name] = (f"WITH {', '.join(parts)} " if parts else "") + body


KEPT = "(SELECT * FROM ruled WHERE decision = 'retain')"


def tfidf_oracle(name: str, reads: list[str], body: str, features: int = lx.MAX_FEATURES) -> None:
    oracle(name, reads, body, KEPT, features)


# --- sources and sinks -----------------------------------------------------

oracle("corpus_scan", ["corpus"], r"""SELECT filename, CAST(strlen(text) AS BIGINT) AS size_bytes,
    regexp_replace(replace(text, chr(65533), ''), '\r\n?', chr(10), 'g') AS text FROM corpus""")
oracle("csv_typed_scan", ["labelled"], "SELECT filename, label, E_score, signal_strength FROM labelled")
oracle("table_sink", ["ruled"], "SELECT decision, filename, noise_terms AS noise_hits, esg_hits FROM ruled")
oracle("quarantine_split", ["ruled"], "SELECT filename, decision, md5(text) AS text_md5 FROM ruled")
oracle("run_manifest", ["ruled"], """SELECT '02_filter_noise' AS step, 'complete' AS status, count(*) AS rows,
    '{"excluded_count": ' || count_if(decision = 'exclude') || ', "retained_count": ' ||
    count_if(decision = 'retain') || '}' AS details FROM ruled""")
oracle("stats_report", ["metadata"], """
    SELECT 'totals' AS section, 'files' AS item, count(*) AS n, NULL::DOUBLE AS value FROM metadata
    UNION ALL SELECT 'totals', 'total_mb', NULL, round(sum(size_bytes) / 1e6, 6) FROM metadata
    UNION ALL SELECT 'totals', 'mean_kb', NULL, round(avg(size_bytes) / 1e3, 6) FROM metadata
    UNION ALL SELECT 'pillar', inferred_pillar, count(*), round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6)
        FROM metadata GROUP BY inferred_pillar
    UNION ALL (SELECT 'year', year, count(*) AS n, NULL FROM metadata GROUP BY year ORDER BY n DESC, year LIMIT 10)
    UNION ALL SELECT 'court', court, count(*), NULL FROM metadata GROUP BY court
    UNION ALL SELECT 'imbalance', 'greenwash', CAST(sum(is_greenwash) AS BIGINT),
        CAST(sum(is_greenwash) < 10 AS INTEGER)::DOUBLE FROM metadata""")

LABEL_COLUMNS = ["filename", "label", "is_sustainability", "is_greenwash", "E_score", "S_score", "G_score",
                 "sus_score", "signal_strength"]
CLEAN_COLUMNS = ["filename", "label", "is_sustainability", "is_greenwash", "token_count", "exceeds_512", "cleaned_text"]


def fingerprint(columns: list[str], source: str) -> str:
    cells = " || chr(1) || ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '-')" for c in columns)
    return f"""SELECT count(*) AS n_rows, sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)::DECIMAL(38,0)) AS hash_sum,
        min(h) AS min_hash, max(h) AS max_hash FROM (SELECT sha256({cells}) AS h FROM {source})"""


oracle("snapshot_write", ["labelled"], f"""SELECT 'snapshot_04_label_construction_v1_4232026' AS snapshot,
    'label_construction' AS step, 'v1' AS version, '4232026' AS date_stamp, n_rows AS rows,
    {q(','.join(LABEL_COLUMNS))} AS columns, hash_sum, min_hash, max_hash,
    '{{"tiebreaker": "G > E > S"}}' AS decisions FROM ({fingerprint(LABEL_COLUMNS, 'labelled')})""")
HASHES = f"""SELECT e.filename, coalesce(sha256(text), 'NOT_FOUND') AS sha256
    FROM (SELECT {filename('c_custkey')} AS filename FROM customer) e LEFT JOIN corpus USING (filename)"""
oracle("file_hashes", ["corpus"], HASHES)
oracle("hash_left_join", ["corpus"], f"""SELECT CAST(sha256 = 'NOT_FOUND' AS INTEGER) AS missing, count(*) AS n,
    min(filename) AS first_file FROM ({HASHES}) GROUP BY 1""")
oracle("table_fingerprint", ["audited"], fingerprint(CLEAN_COLUMNS, "audited"))
oracle("integrity_check", ["clean"], """SELECT filename, sha256(text) AS expected, sha256(cleaned_text) AS actual,
    CASE WHEN text = cleaned_text THEN 'OK' ELSE 'MISMATCH' END AS status FROM ruled JOIN clean USING (filename)""")
FOLD_F1 = """SELECT seed, fold, round(avg(f1), 6) AS macro_f1 FROM (
    SELECT seed, fold, class, coalesce(2.0 * count_if(label = class AND inferred_pillar = class)
        / nullif(count_if(label = class) + count_if(inferred_pillar = class), 0), 0)::DOUBLE AS f1
    FROM folds CROSS JOIN classes GROUP BY ALL) GROUP BY ALL"""
oracle("fold_results_flatten", ["folds", "classes"], f"""SELECT seed, fold, macro_f1,
    round(avg(macro_f1) OVER w, 6) AS seed_mean, round(stddev_pop(macro_f1) OVER w, 6) AS seed_std
    FROM ({FOLD_F1}) WINDOW w AS (PARTITION BY seed)""")
oracle("fold_summary", ["folds", "classes"], f"""SELECT s AS seed, count(*) AS folds, round(avg(macro_f1), 6) AS mean,
    round(stddev_pop(macro_f1), 6) AS std FROM (
    SELECT unnest([CAST(seed AS VARCHAR), 'all']) AS s, macro_f1 FROM ({FOLD_F1})) GROUP BY s""")

# --- scalar functions ------------------------------------------------------

oracle("case_key", ["dedup"], "SELECT filename, case_name FROM dedup")
oracle("numeric_prefix", ["dedup"], "SELECT filename, prefix FROM dedup")
oracle("lexicon_hits", ["scored"], "SELECT filename, esg_hits FROM scored")
oracle("signal_scores", ["scored"], """SELECT filename, noise_terms, esg_hits, pillar_E, pillar_S, pillar_G,
    pillar_Sus, noise_hits FROM scored""")
oracle("extract_year", ["year_of"], "SELECT filename, year FROM year_of")
oracle("detect_court", ["corpus"], f"SELECT filename, {COURT} AS court FROM corpus")
oracle("flag_greenwash", ["ruled"], "SELECT filename, is_greenwash FROM ruled")
oracle("flag_sustainability", ["ruled"], "SELECT filename, is_sustainability FROM ruled")
oracle("infer_pillar", ["ruled"], "SELECT filename, pillar_E, pillar_S, pillar_G, inferred_pillar FROM ruled")
oracle("assign_label", ["labelled"], "SELECT * FROM labelled")
oracle("signal_strength", ["labelled"], "SELECT filename, signal_strength FROM labelled")
oracle("strip_headers", ["corpus"], f"SELECT filename, {stripped('text')} AS stripped FROM corpus")
oracle("collapse_whitespace", ["corpus"], f"SELECT filename, {collapsed('text')} AS collapsed FROM corpus")
oracle("mask_outcome_context", ["corpus"], f"SELECT filename, {masked_context('text')} AS masked FROM corpus")
oracle("mask_outcome_caps", ["corpus"], f"SELECT filename, {masked('text')} AS masked FROM corpus")
oracle("token_count", ["corpus"], f"""SELECT filename, CAST(n AS INTEGER) AS token_count,
    CAST(n > 512 AS INTEGER) AS exceeds_512 FROM (SELECT filename, len({tokens('text')}) AS n FROM corpus)""")
oracle("outcome_mask_count", ["masks"], "SELECT filename, outcome_mask_count FROM masks")
oracle("analysis_text", ["clean"], f"SELECT filename, {analysis('cleaned_text')} AS analysis_text FROM clean")
oracle("fill_text", [], """SELECT doc_id AS conv_id, turn, md5(coalesce(nullif(c.text, ''), '')) AS text_md5
    FROM documents LEFT JOIN conversations c ON doc_id = conv_id""")
INDEX = "CAST(list_position(['E', 'G', 'Non-ESG', 'S'], label) - 1 AS INTEGER)"
oracle("label_encode", ["labelled"], f"SELECT filename, label, {INDEX} AS label_index FROM labelled")
oracle("label_decode", ["labelled"], f"SELECT filename, {INDEX} AS label_index, label FROM labelled")
oracle("one_vs_rest_flags", ["labelled", "classes"],
       "SELECT filename, class, CAST(label = class AS INTEGER) AS y FROM labelled CROSS JOIN classes")
oracle("label_display_name", ["labelled"], """SELECT filename, CASE label WHEN 'E' THEN 'Environmental'
    WHEN 'S' THEN 'Social' WHEN 'G' THEN 'Governance' ELSE 'Non-ESG' END AS display_name,
    replace(label, '-', '') AS slug FROM labelled""")
oracle("truncate_tokens", ["clean"], f"""SELECT filename,
    coalesce(array_to_string(({tokens('cleaned_text')})[1:512], ' '), '') AS truncated FROM clean""")

oracle("chunk_tokens", ["clean"], f"""SELECT filename, CAST(floor(pos / 384) AS INTEGER) AS chunk,
    array_to_string(toks[pos + 1:pos + 512], ' ') AS chunk_text FROM (
    SELECT filename, toks, unnest(range(0, len(toks), 384)) AS pos FROM (
    SELECT filename, {tokens('cleaned_text')} AS toks FROM clean))""")
NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, list_sort({words("coalesce(text, '')")}) AS ws FROM documents),
    m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string(ws, ' ')) AS rep FROM w WHERE len(ws) > 0),
    t AS (SELECT rep, term, count(*) AS n FROM (SELECT rep, unnest(ws) AS term FROM w JOIN m USING (doc_id)
        WHERE doc_id = rep) GROUP BY ALL),
    norms AS (SELECT rep, sum(n * n) AS norm2 FROM t GROUP BY rep),
    dots AS (SELECT x.rep AS a, y.rep AS b, sum(x.n * y.n) AS dot FROM t x JOIN t y ON x.term = y.term AND x.rep < y.rep
        GROUP BY ALL),
    near AS (SELECT a, b, dot / sqrt(p.norm2::DOUBLE * q.norm2::DOUBLE) AS cosine FROM dots
        JOIN norms p ON p.rep = a JOIN norms q ON q.rep = b WHERE dot / sqrt(p.norm2::DOUBLE * q.norm2::DOUBLE) > 0.95),
    linked AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
    reach AS (SELECT rep AS node, rep AS root FROM norms
        UNION SELECT linked.b, reach.root FROM reach JOIN linked ON linked.a = reach.node),
    roots AS (SELECT node AS rep, min(root) AS cluster FROM reach GROUP BY node)"""
oracle("near_dup_pairs", [], f"{NEAR} SELECT a, b, round(cosine, 6) AS cosine FROM near")
oracle("near_dup_clusters", [], f"""{NEAR} SELECT doc_id, coalesce(cluster, doc_id) AS cluster FROM documents
    LEFT JOIN m USING (doc_id) LEFT JOIN roots USING (rep)""")
oracle("exact_dedup", [], """SELECT doc_id, CASE WHEN coalesce(text, '') = '' OR doc_id = min(doc_id) OVER (PARTITION BY text)
    THEN 'canonical' ELSE 'duplicate' END AS status FROM documents""")

# --- filters and joins -----------------------------------------------------

oracle("noise_filter", ["ruled"], "SELECT decision, filename, noise_terms AS noise_hits, esg_hits FROM ruled")
oracle("known_labels", ["labelled"], """SELECT * FROM (SELECT filename, label FROM labelled UNION ALL
    SELECT CAST(event_id AS VARCHAR), event_type FROM events) WHERE label IN ('E', 'S', 'G', 'Non-ESG')""")
oracle("class_slice", ["labelled"], "SELECT filename, label, S_score FROM labelled WHERE label = 'S'")
oracle("skew_flag", ["labelled"], """SELECT label, n, round(pct, 6) AS pct, CAST(pct < 15 AS INTEGER) AS is_skewed,
    CAST(n < 10 AS INTEGER) AS is_rare, CAST(n < 20 AS INTEGER) AS is_low_signal FROM (
    SELECT label, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM labelled GROUP BY label)""")
oracle("extension_filter", ["corpus"], """SELECT filename FROM (SELECT filename FROM corpus UNION ALL
    SELECT url FROM pages) WHERE filename LIKE '%.md'""")
oracle("join_labels_inner", ["ruled"], "SELECT filename, CAST(length(text) AS INTEGER) AS n_chars, label FROM ruled")
oracle("join_labels_left", ["labelled"], f"""SELECT filename, coalesce(label, '') AS label,
    coalesce(CAST(is_sustainability AS VARCHAR), '') AS is_sustainability,
    coalesce(CAST(is_greenwash AS VARCHAR), '') AS is_greenwash
    FROM (SELECT {filename('c_custkey')} AS filename FROM customer) LEFT JOIN labelled USING (filename)""")
oracle("join_mask_counts", ["masks"], "SELECT * FROM masks")
oracle("split_membership", [], """SELECT doc_id, CASE quality WHEN 1 THEN 'train' WHEN 0 THEN 'test' ELSE 'unused' END
    AS split FROM documents LEFT JOIN labels USING (doc_id)""")
PREDICTED = "coalesce(max(predicted) FILTER (split = 'test' AND model = '{}'), '')"
oracle("attach_predictions", ["predictions", "split"], f"""SELECT filename, {PREDICTED.format('majority_class')} AS majority_pred,
    {PREDICTED.format('pillar_rule')} AS pillar_pred, {PREDICTED.format('keyword_rule')} AS keyword_pred
    FROM predictions JOIN split USING (filename) GROUP BY filename""")
oracle("stopword_anti_join", ["plain_counts"], f"SELECT * FROM plain_counts WHERE term NOT IN ({values(lx.STOP_WORDS)})")
oracle("stopword_union", ["plain_counts"], f"""SELECT term, coalesce(count, 0) AS count, coalesce(df, 0) AS df
    FROM {word_list(lx.STOP_WORDS)} LEFT JOIN plain_counts USING (term)""")
ENTRIES = [
    (name, term)
    for name, terms in {
        "noise": lx.NOISE_TERMS, "signal": lx.ESG_SIGNAL_TERMS, "E": lx.PILLAR_E_TERMS,
        "S": lx.PILLAR_S_TERMS, "G": lx.PILLAR_G_TERMS,
    }.items()
    for term in terms
]
oracle("lexicon_theta_join", ["lowered"], " UNION ALL ".join(
    f"SELECT filename, {q(name)} AS lexicon, {q(term)} AS term FROM lowered WHERE {hit(term)}" for name, term in ENTRIES))

# --- aggregates ------------------------------------------------------------

oracle("canonical_dedup", ["dedup_status"], "SELECT filename, case_name, status FROM dedup_status")
oracle("dedup_counts", ["dedup_status"], """SELECT count_if(status = 'canonical')::BIGINT AS canonical_count,
    count_if(status = 'duplicate')::BIGINT AS duplicate_count, count(*) AS total_input FROM dedup_status""")
oracle("dedup_status_union", ["dedup_status"], """SELECT filename, status,
    CASE status WHEN 'canonical' THEN 'corpus_deduped' ELSE 'corpus_dupes' END AS corpus FROM dedup_status""")
oracle("filter_counts", ["ruled"], """SELECT count_if(decision = 'retain')::BIGINT AS retained_count,
    count_if(decision = 'exclude')::BIGINT AS excluded_count FROM ruled""")
oracle("corpus_totals", ["corpus"], """SELECT count(*) AS n_files, round(sum(strlen(text)) / 1e6, 6) AS total_mb,
    round(avg(strlen(text)) / 1e3, 6) AS mean_kb FROM corpus""")
SHARE = "round(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 6) AS pct"
oracle("pillar_distribution", ["ruled"], f"SELECT inferred_pillar, count(*) AS n, {SHARE} FROM ruled GROUP BY 1")
oracle("year_distribution", ["year_of"],
       "SELECT year, count(*) AS n FROM year_of GROUP BY year ORDER BY n DESC, year LIMIT 10")
oracle("court_distribution", ["corpus"],
       f"SELECT court, count(*) AS n, {SHARE} FROM (SELECT {COURT} AS court FROM corpus) GROUP BY court")
oracle("label_distribution", ["ruled"], """SELECT CAST(pos AS INTEGER) AS position, l.label, count(r.label) AS n,
    round(count(r.label) * 100.0::DOUBLE / sum(count(r.label)) OVER (), 6) AS pct
    FROM (VALUES (0, 'E'), (1, 'S'), (2, 'G'), (3, 'Non-ESG')) l(pos, label)
    LEFT JOIN (SELECT label FROM ruled WHERE decision = 'retain') r USING (label) GROUP BY pos, l.label""")
oracle("flag_sums", ["ruled"], """SELECT sum(is_sustainability)::BIGINT AS is_sustainability,
    sum(is_greenwash)::BIGINT AS is_greenwash FROM ruled""")
oracle("token_audit", ["audited"], """SELECT count(*) AS n_docs, sum(exceeds_512)::BIGINT AS over_limit,
    round(sum(exceeds_512) * 100.0::DOUBLE / count(*), 6) AS over_limit_pct, round(avg(token_count), 6) AS mean_tokens,
    CAST(sum(exceeds_512) * 100.0 / count(*) > 20 AS INTEGER) AS needs_long_model FROM audited""")
oracle("mask_audit", ["masks"], """SELECT sum(outcome_mask_count)::BIGINT AS total_masks,
    count_if(outcome_mask_count > 0)::BIGINT AS docs_with_masks FROM masks""")
oracle("describe_scores", ["labelled"], " UNION ALL ".join(
    f"""SELECT '{c}' AS score, count({c}) AS count, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std,
    min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 2)::DOUBLE AS p25,
    round(quantile_cont({c}, 0.5), 2)::DOUBLE AS p50, round(quantile_cont({c}, 0.75), 2)::DOUBLE AS p75,
    max({c})::DOUBLE AS max FROM labelled""" for c in ("E_score", "S_score", "G_score", "sus_score")))
oracle("class_weights", ["split"], """SELECT label, count(*) AS n,
    round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 6) AS weight
    FROM split WHERE split = 'train' GROUP BY label""")
oracle("majority_class", ["ruled"], "SELECT label, count(*) AS n FROM ruled GROUP BY label ORDER BY n DESC, label LIMIT 1")

# --- evaluation ------------------------------------------------------------

REPORT = """SELECT model, class, coalesce(tp / nullif(chosen, 0), 0)::DOUBLE AS precision,
    coalesce(tp / nullif(support, 0), 0)::DOUBLE AS recall,
    coalesce(2 * tp / nullif(chosen + support, 0), 0)::DOUBLE AS f1, support FROM (
    SELECT model, class, count_if(actual = class)::BIGINT AS support, count_if(predicted = class)::BIGINT AS chosen,
        count_if(actual = class AND predicted = class)::DOUBLE AS tp
    FROM predictions CROSS JOIN classes GROUP BY ALL)"""
# Correlation of the indicator variables, straight from the rows.
MCC = """SELECT model, coalesce(cov / nullif(sqrt(vp * vt), 0), 0)::DOUBLE AS mcc FROM (
    SELECT model, sum(hit * n - p * t) AS cov, sum(p * (n - p)) AS vp, sum(t * (n - t)) AS vt FROM (
        SELECT model, class, count(*)::DOUBLE AS n, count_if(predicted = class)::DOUBLE AS p,
            count_if(actual = class)::DOUBLE AS t, count_if(actual = class AND predicted = class)::DOUBLE AS hit
        FROM predictions CROSS JOIN classes GROUP BY ALL) GROUP BY model)"""
oracle("confusion_matrix", ["confusion"], "SELECT model, actual, predicted, n FROM confusion")
oracle("class_report", ["predictions", "classes"], f"""SELECT model, class, round(precision, 6) AS precision,
    round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM ({REPORT})""")
oracle("macro_f1", ["predictions", "classes"], f"SELECT model, round(avg(f1), 6) AS macro_f1 FROM ({REPORT}) GROUP BY model")
oracle("mcc_multiclass", ["predictions", "classes"], f"SELECT model, round(mcc, 6) AS mcc FROM ({MCC})")
oracle("auc_ovr", ["auc"], "SELECT model, class, round(auc, 6) AS auc FROM auc")
oracle("roc_points", ["scores"], """SELECT model, class, round(score, 6) AS threshold,
    round(coalesce(fp / nullif(sum(neg) OVER g, 0), 0), 6)::DOUBLE AS fpr,
    round(coalesce(tp / nullif(sum(pos) OVER g, 0), 0), 6)::DOUBLE AS tpr FROM (
        SELECT model, class, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (
            SELECT model, class, score, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM scores GROUP BY ALL)
        WINDOW w AS (PARTITION BY model, class ORDER BY score DESC))
    WINDOW g AS (PARTITION BY model, class)""")
oracle("evaluate_models", ["auc", "classes"], f"""SELECT model, round(macro_f1, 6) AS macro_f1, round(mcc, 6) AS mcc,
    round(auc_macro, 6) AS auc_macro FROM (SELECT model, avg(f1) AS macro_f1 FROM ({REPORT}) GROUP BY model)
    JOIN ({MCC}) USING (model) JOIN (SELECT model, avg(auc) AS auc_macro FROM auc GROUP BY model) USING (model)""")
oracle("best_model", ["predictions", "classes"], f"""SELECT model, round(avg(f1), 6) AS macro_f1 FROM ({REPORT})
    GROUP BY model ORDER BY avg(f1) DESC, model LIMIT 1""")
oracle("top_confidence_case", ["predictions"], """SELECT filename, actual, predicted, round(p_0, 6) AS score
    FROM predictions WHERE model = 'keyword_rule' ORDER BY score DESC, filename LIMIT 1""")
oracle("sorted_listing", ["corpus"], """SELECT filename, CAST(strlen(text) AS BIGINT) AS size_bytes FROM corpus
    ORDER BY filename""")
oracle("background_sample", [], """SELECT vec_id, label FROM embeddings
    ORDER BY md5('42|' || vec_id), vec_id LIMIT 200""")
oracle("stratified_split", ["split"], "SELECT label, filename, split FROM split")
oracle("stratified_kfold", ["folds"], "SELECT label, filename, fold, seed FROM folds")

# --- text features ---------------------------------------------------------

oracle("tokenize_words", ["corpus"], f"""SELECT filename, CAST(len(t) AS INTEGER) AS n,
    array_to_string(t, ' ') AS tokens FROM (SELECT filename, {words('text')} AS t FROM corpus)""")
oracle("tokenize_alpha", ["alpha_tokens"], """SELECT filename, CAST(len(toks) AS INTEGER) AS n,
    coalesce(array_to_string(toks, ' '), '') AS tokens FROM alpha_tokens""")
oracle("ngrams", ["alpha_tokens"], """SELECT filename,
    coalesce(array_to_string(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]), '|'), '') AS bigrams,
    coalesce(array_to_string(list_transform(range(1, len(toks) - 1),
        lambda i: toks[i] || ' ' || toks[i + 1] || ' ' || toks[i + 2]), '|'), '') AS trigrams FROM alpha_tokens""")
oracle("term_counts", ["label_counts"], "SELECT label, term, count, df FROM label_counts WHERE df >= 2")
oracle("top_ngrams", ["alpha_tokens"], """SELECT label, type, rank, term AS token, count FROM (
    SELECT label, type, term, count(*) AS count, CAST(row_number() OVER (
        PARTITION BY label, type ORDER BY count(*) DESC, term) AS INTEGER) AS rank
    FROM (SELECT label, filename, 'unigram' AS type, unnest(toks) AS term FROM alpha_tokens
        UNION ALL SELECT label, filename, 'bigram', unnest(list_transform(range(1, len(toks)),
            lambda i: toks[i] || ' ' || toks[i + 1])) FROM alpha_tokens
        UNION ALL SELECT label, filename, 'trigram', unnest(list_transform(range(1, len(toks) - 1),
            lambda i: toks[i] || ' ' || toks[i + 1] || ' ' || toks[i + 2])) FROM alpha_tokens)
    GROUP BY label, type, term HAVING count(DISTINCT filename) >= 2) WHERE rank <= 20""")
oracle("vocab_top_k", ["corpus"], f"""SELECT term, count(*) AS count, count(DISTINCT filename) AS df FROM (
    SELECT filename, unnest({words('text')}) AS term FROM corpus) GROUP BY term HAVING count(DISTINCT filename) >= 3
    ORDER BY count DESC, term LIMIT {lx.MAX_FEATURES}""")
oracle("cloud_frequencies", ["label_counts"], """SELECT label, term, count,
    round(count / max(count) OVER (PARTITION BY label)::DOUBLE, 6) AS frequency FROM (
    SELECT label, term, count FROM label_counts UNION ALL
    SELECT 'all', term, sum(count)::BIGINT FROM label_counts GROUP BY term)
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY count DESC, term) <= 150""")
tfidf_oracle("tfidf_fit", ["vocab"], "SELECT term, count, df, round(idf, 6) AS idf FROM vocab")
tfidf_oracle("tfidf_transform", ["weights"], "SELECT filename, term, round(weight, 6) AS weight FROM weights")
tfidf_oracle("class_mean_tfidf", ["class_means"], "SELECT label, term, mean_weight FROM class_means")
tfidf_oracle("top_class_terms", ["class_means"], """SELECT label, CAST(rank AS INTEGER) AS rank, term, mean_weight FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY mean_weight DESC, term) AS rank FROM class_means)
    WHERE rank <= 80""")
tfidf_oracle("class_term_sums", ["weights"], """SELECT term, round(sum(weight), 6) AS total FROM weights
    WHERE split = 'train' AND label = 'S' GROUP BY term ORDER BY total DESC, term LIMIT 5""")
tfidf_oracle("class_signal_check", ["weights"], """SELECT label, CAST(rank AS INTEGER) AS rank, term, total, n_train,
    CAST(n_train < 20 AS INTEGER) AS is_low_signal FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY total DESC, term) AS rank FROM (
        SELECT label, term, round(sum(weight), 6) AS total FROM weights WHERE split = 'train' GROUP BY ALL))
    JOIN (SELECT label, count(*) AS n_train FROM split WHERE split = 'train' GROUP BY label) USING (label)
    WHERE rank <= 5""")
tfidf_oracle("outcome_leak_terms", ["vocab"], f"""SELECT term, array_to_string(list_filter(
    [{values([*lx.OUTCOME_TERMS, 'outcome'])}], lambda o: contains(term, o)), ',') AS leaks FROM vocab
    WHERE len(list_filter([{values([*lx.OUTCOME_TERMS, 'outcome'])}], lambda o: contains(term, o))) > 0""")
tfidf_oracle("tfidf_vectors", ["weights"], f"""SELECT s.filename, {INDEX.replace('label', 's.label')}::DOUBLE AS label_index,
    CAST((SELECT count(*) FROM vocab) AS INTEGER) AS size, CAST(count(term) AS INTEGER) AS entries,
    round(coalesce(sum(weight * weight), 0), 6)::DOUBLE AS squared_norm
    FROM split s LEFT JOIN weights USING (filename) GROUP BY s.filename, s.label""")
tfidf_oracle("complement_nb", ["raw_scores"], """SELECT 'complement_naive_bayes' AS model, filename, label AS actual,
    arg_max(class, (score, -ascii(class))) AS predicted, """ + ", ".join(
    f"round(max(p) FILTER (class = '{c}'), 6) AS p_{i}" for i, c in enumerate(lx.CLASSES)) + """ FROM (
    SELECT *, exp(score - max(score) OVER w) / sum(exp(score - m)) OVER w AS p FROM (
        SELECT *, max(score) OVER (PARTITION BY filename) AS m FROM raw_scores) WINDOW w AS (PARTITION BY filename))
    GROUP BY filename, label""")
tfidf_oracle("linear_attribution", ["contributions"], """SELECT filename, class, CAST(rank AS INTEGER) AS rank, term,
    contribution FROM (SELECT *, row_number() OVER (PARTITION BY filename, class ORDER BY abs(contribution) DESC, term)
    AS rank FROM (SELECT filename, class, term, round(contribution, 6) AS contribution FROM contributions))
    WHERE rank <= 20""")
tfidf_oracle("global_attribution", ["contributions"], """SELECT class, CAST(rank AS INTEGER) AS rank, term, mean_abs FROM (
    SELECT *, row_number() OVER (PARTITION BY class ORDER BY mean_abs DESC, term) AS rank FROM (
        SELECT class, term, round((sum(abs(contribution)) + abs(any_value(coef) * any_value(mean_weight))
            * (any_value(n) - count(*))) / any_value(n), 6) AS mean_abs
        FROM contributions JOIN coefs USING (class, term) JOIN means USING (term),
            (SELECT count(*)::DOUBLE AS n FROM split WHERE split = 'test') GROUP BY ALL)) WHERE rank <= 20""")
