"""The registered queries restated as SQL for an independent engine (DuckDB).

Its regex engine has no look-around. For the three rules that need it, every
non-digit of the text is doubled, the guards become ordinary characters, and the
match is un-doubled afterwards: two neighbouring matches then never share a guard.
"""

from __future__ import annotations

from .. import fixed_values as fv
from .corpus import keys_of, texts_sql
from .inputs import derive_sql


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# patterns of the guarded rules over doubled text; group 1 is the match
_SEP = r"(?:--|\s\s)?"
_DOUBLED = {
    "phone_in": rf"[^0-9]((?:\+\+91{_SEP}|91{_SEP}|0)?[6-9][0-9]{{9}})[^0-9]",
    "aadhaar": rf"[^0-9]([2-9][0-9]{{3}}{_SEP}[0-9]{{4}}{_SEP}[0-9]{{4}})[^0-9]",
    "credit_card": (
        r"[^0-9]((?:4[0-9]{3}|5[1-5][0-9]{2}|6[0-9]{3}|3[47][0-9]{2}|3(?:0[0-5]|[68][0-9])[0-9]"
        rf"|(?:50|5[6-9]|6[0-9])[0-9]{{2}}){_SEP}[0-9]{{4}}{_SEP}[0-9]{{4}}{_SEP}[0-9]{{1,7}})[^0-9]"
    ),
}


def matches_sql(key: str, browser: bool = False, own: dict[str, str] | None = None) -> str:
    if own and key in own:
        return f"regexp_extract_all(text, {q(own[key])})"
    if key in _DOUBLED:
        doubled = r"regexp_replace(' ' || text || ' ', '([^0-9])', '\1\1', 'g')"
        return (
            f"list_transform(regexp_extract_all({doubled}, {q(_DOUBLED[key])}, 1), "
            r"lambda x: regexp_replace(x, '([^0-9])[^0-9]', '\1', 'g'))"
        )
    pattern = fv.PATTERNS[key]
    if browser and key in fv.BROWSER_IGNORE_CASE:
        pattern = "(?i)" + pattern
    return f"regexp_extract_all(text, {q(pattern)})"


def digits_sql(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def luhn_sql(x: str) -> str:
    d = digits_sql(x)
    digit = f"CAST(substr(reverse({d}), CAST(i + 1 AS INTEGER), 1) AS INTEGER) * (1 + i % 2)"
    total = f"list_sum(list_transform(range(length({d})), lambda i: ({digit}) // 10 + ({digit}) % 10))"
    return f"(length({d}) >= 13 AND {total} % 10 = 0)"


def _digits(table: tuple) -> str:
    return "".join(str(digit) for row in table for digit in row)


def verhoeff_sql(x: str) -> str:
    d = digits_sql(x)
    digit = f"CAST(substr({d}, CAST(12 - i AS INTEGER), 1) AS INTEGER)"
    permuted = f"CAST(substr({q(_digits(fv.VERHOEFF_P))}, CAST((i % 8) * 10 + {digit} + 1 AS INTEGER), 1) AS INTEGER)"
    step = f"CAST(substr({q(_digits(fv.VERHOEFF_D))}, CAST(c * 10 + {permuted} + 1 AS INTEGER), 1) AS BIGINT)"
    return (
        f"CASE WHEN length({d}) = 12 THEN "
        f"list_reduce(range(12), lambda c, i: {step}, CAST(0 AS BIGINT)) = 0 ELSE false END"
    )


def redact_sql(x: str) -> str:
    return (
        f"CASE WHEN length({x}) <= 6 THEN left({x}, 1) || repeat('*', length({x}) - 1) "
        f"ELSE left({x}, 2) || repeat('*', length({x}) - 4) || right({x}, 2) END"
    )


def volume_sql(n: str) -> str:
    return (
        f"CASE WHEN {n} = 0 THEN 0.0 WHEN {n} = 1 THEN 1.0 WHEN {n} BETWEEN 2 AND 5 THEN 1.3 "
        f"WHEN {n} BETWEEN 6 AND 20 THEN 1.6 WHEN {n} BETWEEN 21 AND 100 THEN 2.0 ELSE 2.5 END"
    )


def factor_sql(c: str) -> str:
    return f"CASE WHEN {c} = 'HIGH' THEN 1.0 WHEN {c} = 'LOW' THEN 0.4 ELSE 0.7 END"


def weight_sql(key: str, default: int = 10, own: dict[str, int] | None = None) -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {w}" for k, w in (fv.WEIGHTS | (own or {})).items())
    return f"CASE {key} {arms} ELSE {default} END"


def points_sql(key: str, n: str, c: str, own: dict[str, int] | None = None) -> str:
    return f"CAST({weight_sql(key, own=own)} * {factor_sql(c)} * {volume_sql(n)} AS DECIMAL(10,2))"


def bonus_sql(n: str, browser: bool = False) -> str:
    return f"CAST(CASE {n} WHEN 0 THEN {0 if browser else 12} WHEN 1 THEN 0 WHEN 2 THEN 5 ELSE 12 END AS INTEGER)"


def final_sql(raw: str, bonus: str, browser: bool = False) -> str:
    rounding = "round" if browser else "round_even"
    return f"CAST(least(100, {rounding}(CAST({raw} + {bonus} AS DECIMAL(18,2)), 0)) AS INTEGER)"


def level_sql(s: str) -> str:
    return f"CASE WHEN {s} <= 29 THEN 'LOW' WHEN {s} <= 59 THEN 'MEDIUM' WHEN {s} <= 84 THEN 'HIGH' ELSE 'CRITICAL' END"


def extension_sql(name: str, browser: bool = False) -> str:
    after = f"lower(regexp_replace({name}, '^.*[.]', ''))"
    return after if browser else f"CASE WHEN contains({name}, '.') THEN {after} ELSE '' END"


def bytes_sql(n: str) -> str:
    def scaled(unit: int, suffix: str) -> str:
        tenths = f"(({n}) * 20 + {unit}) // {2 * unit}"
        return (
            f"CAST(({tenths}) // 10 AS VARCHAR) || CASE WHEN ({tenths}) % 10 = 0 THEN '' "
            f"ELSE '.' || CAST(({tenths}) % 10 AS VARCHAR) END || ' {suffix}'"
        )

    return (
        f"CASE WHEN {n} < 1024 THEN CAST({n} AS VARCHAR) || ' B' WHEN {n} < 1048576 THEN {scaled(1024, 'KB')} "
        f"WHEN {n} < 1073741824 THEN {scaled(1048576, 'MB')} ELSE {scaled(1073741824, 'GB')} END"
    )


def length_sql(text: str, browser: bool = False) -> str:
    if not browser:
        return f"CAST(length({text}) AS INTEGER)"
    wide = rf"length(regexp_replace({text}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g'))"
    return f"CAST(length({text}) + {wide} AS INTEGER)"


# the registry of the queries on own rules: (row, pattern, weight), one replaced and one added
_OWN = (
    (("email", "Internal address", "PII", "medium", "HIGH"), r"\bu\d+@mail\.example\.com\b", 30),
    (("closing", "Closing word", "Notes", "low", "LOW"), r"\s+end\b", 50),
)


def scan_ctes(
    corpus: str, browser: bool = False, keys: tuple[str, ...] | None = None, own: tuple = (),
    source: str | None = None, kept: str | None = None,
) -> str:
    """``docs``, ``rules``, ``found`` (one row per finding) and ``scored`` (one per document)."""
    replaced = {r[0]: r for r, _, _ in own}
    patterns, weights = {r[0]: p for r, p, _ in own}, {r[0]: w for r, _, w in own}
    rows = [replaced.pop(r[0], r) for r in fv.RULE_ROWS if keys is None or r[0] in keys]
    rows += replaced.values()
    rank = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
    rules = ", ".join(
        f"({i}, {', '.join(q(v) for v in r)}, {rank[r[4]]})" for i, r in enumerate(rows)
    )
    checks = {"aadhaar": verhoeff_sql("x"), "credit_card": luhn_sql("x")}
    hits = " UNION ALL ".join(
        f"SELECT rid, {i} AS idx, "
        + (f"list_filter({matches_sql(r[0], browser)}, lambda x: {checks[r[0]]})" if r[0] in checks
           else matches_sql(r[0], browser, patterns))
        + f" AS m FROM docs"
        for i, r in enumerate(rows)
    )
    order = "r.conf_rank, len(m) DESC, h.idx" if browser else "len(m) DESC, h.idx"
    kept = kept or ", ".join(keys_of(corpus))
    return f"""
    WITH docs AS MATERIALIZED (
      SELECT row_number() OVER () AS rid, * FROM ({source or texts_sql(corpus)})),
    rules(idx, key, label, category, severity, confidence, conf_rank) AS (VALUES {rules}),
    hits AS MATERIALIZED ({hits}),
    found AS (
      SELECT h.rid, h.idx, r.key, r.label, r.category, r.severity, r.confidence,
        CAST(len(m) AS INTEGER) AS count,
        list_transform(list_filter(m, lambda x, i: list_position(m, x) = i)[1:3],
                       lambda x: {redact_sql('x')}) AS samples,
        {points_sql('r.key', 'len(m)', 'r.confidence', weights)} AS contribution,
        CAST(row_number() OVER (PARTITION BY h.rid ORDER BY {order}) AS INTEGER) AS position
      FROM hits h JOIN rules r ON h.idx = r.idx WHERE len(m) > 0),
    sums AS (
      SELECT d.rid, CAST(coalesce(sum(f.count), 0) AS INTEGER) AS total_findings,
        CAST(count(f.idx) AS INTEGER) AS types,
        CAST(coalesce(sum(f.contribution), 0) AS DECIMAL(18,2)) AS raw
      FROM docs d LEFT JOIN found f ON d.rid = f.rid GROUP BY d.rid),
    scored AS (
      SELECT d.rid, {kept}, {length_sql('text', browser)} AS total_characters, s.total_findings, s.types,
        {bonus_sql('s.types', browser)} AS cooccurrence_bonus, s.raw,
        CAST(s.raw AS DOUBLE) AS raw_score,
        {final_sql('s.raw', bonus_sql('s.types', browser), browser)} AS score,
        octet_length(encode(text)) AS size_bytes
      FROM docs d JOIN sums s ON d.rid = s.rid),
    levelled AS (SELECT *, {level_sql('score')} AS risk_level FROM scored)
    """


def masked_sql(corpus: str) -> str:
    """Offsets from what lies between the matches; stars by character.

    For the rules whose text is doubled a digit counts two halves and any other character one.
    """
    checks = {"aadhaar": verhoeff_sql("match"), "credit_card": luhn_sql("match")}
    halves = lambda x: f"(length({x}) + length({digits_sql(x)}))"
    rules = []
    for i, (key, *_) in enumerate(fv.RULE_ROWS):
        doubled = key in _DOUBLED
        over = r"regexp_replace(' ' || text || ' ', '([^0-9])', '\1\1', 'g')" if doubled else "text"
        pattern = q(_DOUBLED[key] if doubled else fv.PATTERNS[key])
        units = halves if doubled else (lambda x: f"length({x})")
        order = "PARTITION BY rid ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND"
        at = f"sum({units('gap')}) OVER ({order} CURRENT ROW) + coalesce(sum({units('whole')}) OVER ({order} 1 PRECEDING), 0)"
        rules.append(f"""
          SELECT rid, {i} AS idx, {q(key)} AS key, match, {f"({at} + 1) // 2 - 1" if doubled else at} AS s FROM (
            SELECT rid, unnest(w) AS whole, unnest(g[1:len(w)]) AS gap, unnest(m) AS match, generate_subscripts(w, 1) AS n
            FROM (SELECT rid, regexp_extract_all({over}, {pattern}) AS w, string_split_regex({over}, {pattern}) AS g,
              {matches_sql(key)} AS m FROM docs))""")
        rules[-1] = f"SELECT * FROM ({rules[-1]}) WHERE {checks.get(key, 'true')}"
    kept = ", ".join(keys_of(corpus))
    return f"""
    WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, * REPLACE (coalesce(text, '') AS text) FROM ({texts_sql(corpus)})),
    places AS MATERIALIZED (SELECT * REPLACE (CAST(s AS BIGINT) AS s), CAST(s AS BIGINT) + length(match) AS e FROM ({" UNION ALL ".join(rules)})),
    stars AS (SELECT DISTINCT rid, unnest(CASE WHEN e - s <= 6 THEN range(s + 1, e) ELSE range(s + 2, e - 2) END) AS pos FROM places),
    letters AS (SELECT rid, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS pos
      FROM docs WHERE rid IN (SELECT rid FROM places)),
    masked AS (SELECT rid, string_agg(CASE WHEN stars.pos IS NULL THEN c ELSE '*' END, '' ORDER BY letters.pos) AS text
      FROM letters LEFT JOIN stars USING (rid, pos) GROUP BY rid),
    listed AS (SELECT rid, count(*) AS n, string_agg(key || ':' || s || ':' || e, ',' ORDER BY s, idx) AS places
      FROM places GROUP BY rid)
    SELECT {kept}, CAST(coalesce(n, 0) AS INTEGER) AS n_masked, md5(coalesce(m.text, d.text)) AS masked_md5, coalesce(places, '') AS places
    FROM docs d LEFT JOIN masked m USING (rid) LEFT JOIN listed USING (rid)"""


def flat_sql(corpus: str, browser: bool = False) -> str:
    kept = ", ".join(keys_of(corpus))
    return scan_ctes(corpus, browser) + f"""
    SELECT {kept}, total_characters, total_findings, types, cooccurrence_bonus, raw_score, score, risk_level,
      CAST(CASE WHEN types = 0 THEN 0 ELSE types + 2 END AS INTEGER) AS n_recommendations
    FROM levelled"""


def advice_sql(corpus: str, browser: bool = False, own: tuple = (), advice: dict | None = None) -> str:
    texts = (fv.ADVICE_BROWSER if browser else fv.ADVICE_BACKEND) | (advice or {})
    weights = {r[0]: w for r, _, w in own}
    always = fv.ADVICE_ALWAYS_BROWSER if browser else fv.ADVICE_ALWAYS_BACKEND
    arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in texts.items())
    kept = ", ".join(keys_of(corpus))
    return scan_ctes(corpus, browser, own=own) + f"""
    , lines AS (
      SELECT rid, CAST(row_number() OVER (PARTITION BY rid ORDER BY {weight_sql('key', 0, weights)} DESC, position) AS INTEGER)
               AS number, CASE key {arms} END AS recommendation FROM found
      UNION ALL SELECT rid, types + 1, {q(always[0])} FROM sums WHERE types > 0
      UNION ALL SELECT rid, types + 2, {q(always[1])} FROM sums WHERE types > 0)
    SELECT {kept}, number, recommendation FROM lines JOIN docs USING (rid)"""


def gate_sql(name: str, size: str, browser: bool = False) -> dict[str, str]:
    ext = extension_sql(name, browser)
    bad_type = f"({ext}) NOT IN ('txt', 'csv', 'pdf', 'docx')"
    if browser:
        arms = [
            (f"{size} > 10485760", 413, f"'File too large (' || {bytes_sql(size)} || '). Maximum is 10 MB.'"),
            (f"{size} = 0", 400, "'Uploaded file is empty.'"),
            (bad_type, 400, "'Unsupported file type. Allowed: txt, csv, pdf, docx'"),
        ]
    else:
        arms = [
            (bad_type, 400, f"'Unsupported file type ''.' || {ext} || '''. Allowed: [''csv'', ''docx'', ''pdf'', ''txt'']'"),
            (f"{size} > 10485760", 413,
             f"'File too large (' || format('{{:,}}', {size}) || ' bytes). Maximum allowed size is 10,485,760 bytes (10 MB).'"),
            (f"{size} = 0", 400, "'Uploaded file is empty.'"),
        ]
    code = "CASE " + " ".join(f"WHEN {c} THEN {n}" for c, n, _ in arms) + " ELSE 200 END"
    detail = "CASE " + " ".join(f"WHEN {c} THEN {t}" for c, _, t in arms) + " END"
    return {"extension": ext, "code": f"CAST({code} AS INTEGER)", "detail": detail}


UPLOAD_CAP = 5000
_LATIN = r"regexp_replace(coalesce(text, ''), '[^\x{00}-\x{ff}]', '?', 'g')"
_BEST_EFFORT = rf"regexp_replace({_LATIN}, '[\x{{80}}-\x{{ff}}]', chr(65533), 'g')"
# documents as files: name, bytes of the encoding, and the text that decoding gives back
_FILES_SQL = f"""
    SELECT doc_id, source, CAST(doc_id AS VARCHAR) || suffix AS filename, lower(replace(suffix, '.', '')) AS kind,
      CASE doc_id % 3 WHEN 0 THEN octet_length(encode(coalesce(text, ''))) + 3
        WHEN 1 THEN octet_length(encode(coalesce(text, ''))) ELSE length({_LATIN}) END AS file_size,
      CASE WHEN suffix IN ('.pdf', '.Docx') THEN coalesce(text, '')
        WHEN doc_id % 3 = 2 THEN CASE WHEN suffix IN ('.txt', '.CSV') THEN {_LATIN} ELSE {_BEST_EFFORT} END
        WHEN doc_id % 3 = 0 AND suffix NOT IN ('.txt', '.CSV') THEN chr(65279) || coalesce(text, '')
        ELSE coalesce(text, '') END AS text
    FROM (SELECT *, (['.txt', '.CSV', '.pdf', '.txt', '.exe', '', '.Docx'])[CAST(doc_id % 7 + 1 AS INTEGER)] AS suffix FROM documents)"""


def violations_sql(source: str, columns: str, checks: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {columns}, {q(name)} AS violation FROM ({source}) WHERE NOT coalesce({ok}, false)"
        for name, ok in checks.items()
    )


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    keys = [r[0] for r in fv.RULE_ROWS]

    # whole reports
    for corpus in ("documents", "derived", "pages", "conversations", "benchmark"):
        out[f"report_{corpus}"] = flat_sql(corpus)
    for corpus in ("documents", "derived", "pages"):
        out[f"report_{corpus}_browser"] = flat_sql(corpus, browser=True)
    out["stream_scan"] = flat_sql("documents")

    # single rules
    samples = "array_to_string(samples, ' | ') AS samples"
    for key in keys:
        out[f"detect_{key}"] = scan_ctes("derived", keys=(key,)) + (
            f"SELECT doc_id, count, {samples} FROM found JOIN docs USING (rid)"
        )
    for corpus in ("documents", "pages"):
        kept = ", ".join(keys_of(corpus))
        out[f"detect_all_{corpus}"] = scan_ctes(corpus) + (
            f"SELECT {kept}, key, count, {samples} FROM found JOIN docs USING (rid)"
        )

    # findings
    long = f"SELECT doc_id, position, key, label, category, severity, confidence, count, {samples} FROM found JOIN docs USING (rid)"
    out["findings_long"] = scan_ctes("derived") + long
    out["findings_order_backend"] = scan_ctes("derived") + (
        "SELECT doc_id, string_agg(key, ',' ORDER BY position) AS keys FROM found JOIN docs USING (rid) GROUP BY doc_id"
    )
    out["findings_order_browser"] = scan_ctes("derived", browser=True) + (
        "SELECT doc_id, string_agg(key, ',' ORDER BY position) AS keys FROM found JOIN docs USING (rid) GROUP BY doc_id"
    )
    out["samples"] = scan_ctes("documents") + """
      , s AS (SELECT rid, key, unnest(samples) AS sample, CAST(generate_subscripts(samples, 1) AS INTEGER) AS number FROM found)
      SELECT doc_id, lang, source, key, number, sample FROM s JOIN docs USING (rid)"""
    out["samples_derived"] = scan_ctes("derived") + """
      , s AS (SELECT rid, key, unnest(samples) AS sample, CAST(generate_subscripts(samples, 1) AS INTEGER) AS number FROM found)
      SELECT doc_id, key, number, sample FROM s JOIN docs USING (rid)"""
    out["samples_distinct"] = out["samples_derived"].replace(scan_ctes("derived"), scan_ctes("orders"))
    out["findings_distinct"] = flat_sql("orders")
    out["sensitive_flag"] = scan_ctes("documents") + "SELECT doc_id, types > 0 AS sensitive, total_findings FROM scored"
    out["text_length_browser"] = f"SELECT doc_id, {length_sql('text', True)} AS total_characters, CAST(length(text) AS INTEGER) AS code_points FROM documents"
    out["secrets_only"] = scan_ctes("derived", keys=("api_key", "aws_access", "aws_secret", "jwt", "password", "db_conn")) + (
        "SELECT doc_id, total_findings, types, score, risk_level FROM levelled"
    )
    out["custom_rule"] = scan_ctes("derived", own=_OWN) + (
        "SELECT doc_id, score, position, key, label, count FROM found JOIN scored USING (rid)"
    )
    out["recommendations_custom"] = advice_sql("derived", own=_OWN, advice={"closing": "Check the closing notes."})
    catalog = ", ".join(
        f"({i}, {', '.join(q(v) for v in r)}, {fv.WEIGHTS[r[0]]}, {r[0] in ('pan', 'aadhaar', 'credit_card')})"
        for i, r in enumerate(fv.RULE_ROWS)
    )
    out["rule_catalog"] = scan_ctes("derived") + f"""
      , catalog(rule_idx, key, label, category, severity, confidence, severity_weight, has_validator) AS (VALUES {catalog})
      , hit AS (SELECT key, count(*) AS documents, CAST(sum(count) AS BIGINT) AS matches FROM found GROUP BY key)
      SELECT c.*, coalesce(documents, 0) AS documents, coalesce(matches, 0) AS matches
      FROM catalog c LEFT JOIN hit ON c.key = hit.key"""
    entries = ", ".join(
        f"({i}, {', '.join(q(v) for v in row)})" for i, row in enumerate(fv.COVERAGE_ROWS, 1)
    )
    out["coverage"] = scan_ctes("documents") + f"""
      , entries(position, key, label, category, confidence) AS (VALUES {entries})
      , hit AS (SELECT key, count(*) AS documents FROM found GROUP BY key)
      SELECT e.position, e.label, e.category, e.confidence, coalesce(documents, 0) AS documents
      FROM entries e LEFT JOIN hit ON e.key = hit.key"""

    # scalars
    out["luhn"] = f"SELECT o_orderkey, {luhn_sql('number')} AS valid FROM ({derive_sql('card_numbers')})"
    out["verhoeff"] = f"SELECT o_orderkey, {verhoeff_sql('number')} AS valid FROM ({derive_sql('identity_numbers')})"
    out["pan_valid"] = (
        "SELECT o_orderkey, regexp_full_match(code, '[A-Z]{5}[0-9]{4}[A-Z]') AS valid "
        f"FROM ({derive_sql('tax_codes')})"
    )
    out["redact"] = f"SELECT c_custkey, {redact_sql('value')} AS redacted FROM ({derive_sql('names')})"
    out["format_bytes"] = (
        f"SELECT l_orderkey, l_linenumber, {bytes_sql('size_bytes')} AS shown, {bytes_sql('price')} AS price_shown "
        f"FROM ({derive_sql('sizes')})"
    )
    out["rule_label"] = (
        "SELECT key, upper(replace(key, '_', ' ')) AS label, count(*) AS n "
        f"FROM ({derive_sql('line_findings')}) GROUP BY key"
    )
    out["file_extension"] = (
        f"SELECT o_orderkey, {extension_sql('dotted')} AS extension, {extension_sql('dotless')} AS dotless, "
        f"{extension_sql('dotless', True)} AS dotless_browser FROM ({derive_sql('uploads')})"
    )

    # scoring
    out["volume_multiplier"] = (
        f"SELECT l_orderkey, n, CAST({volume_sql('n')} AS DOUBLE) AS multiplier FROM ({derive_sql('counts')})"
    )
    out["contribution"] = (
        f"SELECT l_orderkey, key, count, CAST({weight_sql('key')} AS INTEGER) AS weight, "
        f"CAST({factor_sql('confidence')} AS DOUBLE) AS factor, "
        f"CAST({points_sql('key', 'count', 'confidence')} AS DOUBLE) AS contribution FROM ({derive_sql('line_findings')})"
    )
    out["bonus"] = (
        f"SELECT types, {bonus_sql('types')} AS backend, {bonus_sql('types', True)} AS browser, count(*) AS n "
        f"FROM ({derive_sql('types')}) GROUP BY types"
    )
    out["final_score"] = (
        f"SELECT o_orderkey, {final_sql('raw_score', bonus_sql('types'))} AS backend, "
        f"{final_sql('raw_score', bonus_sql('types', True), True)} AS browser FROM ({derive_sql('raw_scores')})"
    )
    out["risk_level"] = f"SELECT o_orderkey, score, {level_sql('score')} AS risk_level FROM ({derive_sql('whole_scores')})"
    out["classify_tier"] = (
        f"SELECT c_custkey, {level_sql('trunc(value)')} AS backend, {level_sql('value')} AS browser "
        f"FROM ({derive_sql('balances')})"
    )
    for name, browser in (("score_findings", False), ("score_findings_browser", True)):
        out[name] = f"""
          WITH f AS ({derive_sql('line_findings')}),
          s AS (SELECT l_orderkey,
              CAST(coalesce(sum({points_sql('key', 'count', 'confidence')}) FILTER (WHERE count <> 0), 0) AS DECIMAL(18,2)) AS raw,
              CAST(count(*) FILTER (WHERE count <> 0) AS INTEGER) AS active_types,
              CAST(sum(count) AS BIGINT) AS total_findings
            FROM f GROUP BY l_orderkey),
          t AS (SELECT *, {bonus_sql('active_types', browser)} AS cooccurrence_bonus FROM s),
          u AS (SELECT *, {final_sql('raw', 'cooccurrence_bonus', browser)} AS score FROM t)
          SELECT l_orderkey, CAST(raw AS DOUBLE) AS raw_score, active_types, total_findings, cooccurrence_bonus, score,
            {level_sql('score')} AS risk_level FROM u"""
    out["breakdown_findings"] = f"""
      WITH f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, key
          ORDER BY l_linenumber DESC, l_extendedprice DESC, l_quantity DESC, l_suppkey DESC) AS rn
        FROM ({derive_sql('line_findings')}) WHERE count <> 0)
      SELECT l_orderkey, key, count, confidence, CAST({weight_sql('key')} AS INTEGER) AS severity_weight,
        CAST({factor_sql('confidence')} AS DOUBLE) AS confidence_factor,
        CAST({volume_sql('count')} AS DOUBLE) AS volume_multiplier,
        CAST({points_sql('key', 'count', 'confidence')} AS DOUBLE) AS contribution
      FROM f WHERE rn = 1"""
    out["score_legacy"] = scan_ctes("derived") + "SELECT doc_id, CAST(score AS DOUBLE) AS score FROM scored"
    for name, browser in (("breakdown_sorted", False), ("breakdown_sorted_browser", True)):
        out[name] = scan_ctes("derived", browser) + f"""
          SELECT doc_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY contribution DESC, position) AS INTEGER) AS rank,
            key, upper(replace(key, '_', ' ')) AS label, count, confidence,
            CAST({weight_sql('key')} AS INTEGER) AS severity_weight,
            CAST({factor_sql('confidence')} AS DOUBLE) AS confidence_factor,
            CAST({volume_sql('count')} AS DOUBLE) AS volume_multiplier,
            CAST(contribution AS DOUBLE) AS contribution
          FROM found JOIN docs USING (rid)"""

    # advice and records
    out["recommendations_long"] = advice_sql("derived")
    out["recommendations_long_browser"] = advice_sql("derived", browser=True)
    out["recommendations_documents"] = advice_sql("documents")
    record = "'doc-' || CAST(doc_id AS VARCHAR) || '.txt'"
    out["report_record"] = scan_ctes("derived") + f"""
      SELECT 'success' AS status, {record} AS filename, CAST(size_bytes AS BIGINT) AS size_bytes, total_characters,
        score, risk_level, total_findings, types AS n_findings, types AS n_breakdown, cooccurrence_bonus, raw_score,
        CAST(CASE WHEN types = 0 THEN 0 ELSE types + 2 END AS INTEGER) AS n_recommendations FROM levelled"""
    out["report_json"] = scan_ctes("derived") + f"""
      SELECT '{{"filename":"' || {record} || '","size_bytes":' || CAST(size_bytes AS VARCHAR)
        || ',"chars":' || CAST(total_characters AS VARCHAR) || ',"findings":' || CAST(total_findings AS VARCHAR)
        || ',"score":' || CAST(score AS VARCHAR) || ',"risk_level":"' || risk_level || '","raw_score":'
        || CAST(raw AS VARCHAR) || ',"cooccurrence_bonus":' || CAST(cooccurrence_bonus AS VARCHAR) || '}}' AS report
      FROM levelled"""
    out["scan_log"] = scan_ctes("documents") + f"""
      SELECT {record} AS filename, CAST(size_bytes AS BIGINT) AS size_bytes, total_characters AS chars,
        total_findings AS findings, score, risk_level, raw_score, cooccurrence_bonus FROM levelled"""

    # gates and contracts
    for name, browser in (("gates", False), ("gates_browser", True)):
        g = gate_sql("filename", "size_bytes", browser)
        uploads = f"SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN dotless ELSE dotted END AS filename FROM ({derive_sql('uploads')})"
        out[name] = f"""
          WITH u AS ({uploads}), g AS (SELECT o_orderkey, filename, size_bytes, {g['extension']} AS extension,
            {g['code']} AS http_code, {g['detail']} AS detail FROM u)
          SELECT *, CASE WHEN http_code = 200 THEN 'ok' ELSE 'error' END AS status FROM g"""
    out["quarantine"] = f"SELECT filename, status, http_code, detail FROM ({out['gates']}) WHERE status = 'error'"
    out["request_violations"] = violations_sql(
        f"SELECT o_orderkey, filename, size_bytes, coalesce(content_type, 'application/octet-stream') AS content_type FROM ({derive_sql('requests')})",
        "o_orderkey, filename, size_bytes, content_type",
        {"filename_length": "length(filename) BETWEEN 1 AND 255", "size_range": "size_bytes BETWEEN 0 AND 10485760"},
    )
    out["report_violations"] = violations_sql(
        derive_sql("foreign_reports"),
        "o_orderkey, score, risk_level, total_findings, total_characters, cooccurrence_bonus",
        {
            "score_range": "score BETWEEN 0 AND 100",
            "risk_level": "upper(risk_level) IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')",
            "total_findings": "total_findings >= 0",
            "total_characters": "total_characters >= 0",
            "cooccurrence_bonus": "cooccurrence_bonus >= 0",
        },
    )
    out["own_report_violations"] = scan_ctes("derived") + """
      , spoilt(n, violation, needs_finding) AS (VALUES (1, 'score_range', false), (2, 'risk_level', false),
        (3, 'total_findings', false), (4, 'total_characters', false), (5, 'cooccurrence_bonus', false),
        (6, 'size_bytes', false), (7, 'finding_count', true), (8, 'breakdown_entry', true))
      SELECT doc_id, violation FROM scored JOIN spoilt ON doc_id % 9 = n WHERE types > 0 OR NOT needs_finding"""

    # roll-ups
    for corpus, name in (("documents", "exposure_by_rule"), ("derived", "exposure_by_rule_derived")):
        out[name] = scan_ctes(corpus) + (
            "SELECT key, count(DISTINCT rid) AS documents, CAST(sum(count) AS BIGINT) AS matches FROM found GROUP BY key"
        )
    by = {
        "exposure_by_source": "source, category",
        "exposure_by_lang": "lang, severity",
        "exposure_by_source_only": "source",
    }
    for name, columns in by.items():
        out[name] = scan_ctes("documents") + (
            f"SELECT {columns}, count(DISTINCT rid) AS documents, CAST(sum(count) AS BIGINT) AS matches "
            f"FROM found JOIN docs USING (rid) GROUP BY {columns}"
        )
    out["docs_by_level"] = scan_ctes("documents") + "SELECT risk_level, count(*) AS documents FROM levelled GROUP BY risk_level"
    out["docs_by_level_derived"] = scan_ctes("derived") + "SELECT risk_level, count(*) AS documents FROM levelled GROUP BY risk_level"
    out["docs_by_level_source"] = scan_ctes("documents") + (
        "SELECT source, risk_level, count(*) AS documents FROM levelled GROUP BY source, risk_level"
    )
    out["top_k_risky"] = scan_ctes("documents") + (
        "SELECT doc_id, score, risk_level, total_findings FROM levelled ORDER BY score DESC, doc_id LIMIT 20"
    )
    out["top_k_risky_derived"] = scan_ctes("derived") + (
        "SELECT doc_id, score, risk_level, total_findings FROM levelled ORDER BY score DESC, doc_id LIMIT 50"
    )

    # files
    kept = "doc_id, source, filename, file_size, kind"
    total = scan_ctes("documents", source=_FILES_SQL, kept=kept)
    out["file_scan"] = total + """
      SELECT source, file_size > 0 AS was_read, count(*) AS files, CAST(sum(total_characters) AS BIGINT) AS characters,
        CAST(sum(total_findings) AS BIGINT) AS matches FROM scored GROUP BY ALL"""
    out["any_extension"] = f"""
      SELECT doc_id, filename, CASE WHEN file_size > 0 THEN 'ok' ELSE 'error' END AS status,
        CASE WHEN file_size > 0 THEN 200 ELSE 400 END AS http_code,
        CASE WHEN file_size > 0 THEN md5(text) END AS text_md5 FROM ({_FILES_SQL})"""
    bad = f"kind IN ('exe', '') OR file_size > {UPLOAD_CAP} OR file_size = 0 OR kind IN ('pdf', 'docx')"
    done = ["total_characters", "score", "risk_level", "total_findings", "types", "raw_score"]
    out["report_uploads"] = total + f"""
      SELECT doc_id, CASE WHEN {bad} THEN 'error' ELSE 'success' END AS status, filename,
        CAST(file_size AS BIGINT) AS size_bytes, {', '.join(f"CASE WHEN NOT ({bad}) THEN {c} END AS {c}" for c in done)}
      FROM levelled"""
    out["stream_reports"] = out["report_uploads"]
    code = f"CASE WHEN kind IN ('exe', '') THEN 400 WHEN file_size > {UPLOAD_CAP} THEN 413 WHEN file_size = 0 THEN 400 " \
        "WHEN kind IN ('pdf', 'docx') THEN 422 ELSE 200 END"
    done += ["cooccurrence_bonus", "n_recommendations"]
    out["assess_uploads"] = total + f"""
      SELECT doc_id, filename, CASE WHEN {bad} THEN 'error' ELSE 'ok' END AS status, {code} AS http_code,
        {', '.join(f"CASE WHEN NOT ({bad}) THEN {c} END AS {c}" for c in done)}
      FROM (SELECT *, CAST(CASE WHEN types = 0 THEN 0 ELSE types + 2 END AS INTEGER) AS n_recommendations FROM levelled)"""
    out["levels_uploads"] = total + f"""
      SELECT source, CASE WHEN {bad} THEN 'UNREAD' ELSE risk_level END AS risk_level, count(*) AS documents
      FROM levelled GROUP BY ALL"""
    out["stream_quarantine"] = f"""
      SELECT filename, 'error' AS status,
        CASE WHEN kind IN ('exe', '') THEN 400 WHEN file_size > {UPLOAD_CAP} THEN 413 WHEN file_size = 0 THEN 400 ELSE 422 END AS http_code,
        CASE WHEN kind IN ('exe', '') THEN 'Unsupported file type ''.' || kind || '''. Allowed: [''csv'', ''docx'', ''pdf'', ''txt'']'
          WHEN file_size > {UPLOAD_CAP} THEN 'File too large (' || format('{{:,}}', file_size)
            || ' bytes). Maximum allowed size is 5,000 bytes (0.00476837 MB).'
          WHEN file_size = 0 THEN 'Uploaded file is empty.'
          ELSE 'No text extraction for ''.' || kind || ''' files.' END AS detail
      FROM ({_FILES_SQL}) WHERE {bad}"""
    finding = """'{"category":' || to_json(category) || ',"label":' || to_json(label) || ',"count":' || count
        || ',"severity":' || to_json(severity) || ',"confidence":' || to_json(confidence) || ',"samples":' || to_json(samples) || '}'"""
    entry = f"""to_json(key) || ':{{"count":' || count || ',"confidence":' || to_json(confidence) || ',"severity_weight":'
        || {weight_sql('key')} || ',"confidence_factor":' || CAST({factor_sql('confidence')} AS DECIMAL(3,1)) || ',"volume_multiplier":'
        || CAST({volume_sql('count')} AS DECIMAL(3,1)) || ',"contribution":' || contribution || '}}'"""
    arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.ADVICE_BACKEND.items())
    always = ", ".join(q(a) for a in fv.ADVICE_ALWAYS_BACKEND)
    out["report_json_full"] = scan_ctes("derived") + f"""
      , nested AS (SELECT rid, string_agg({finding}, ',' ORDER BY position) AS findings,
          string_agg({entry}, ',' ORDER BY position) AS breakdown,
          to_json(list(CASE key {arms} END ORDER BY {weight_sql('key', 0)} DESC, position) || [{always}]) AS advice
        FROM found GROUP BY rid)
      SELECT '{{"status":"success","filename":"' || {record} || '","size_bytes":' || size_bytes || ',"total_characters":'
        || total_characters || ',"score":' || score || ',"risk_level":"' || risk_level || '","total_findings":'
        || total_findings || ',"findings":[' || coalesce(findings, '') || '],"breakdown":{{' || coalesce(breakdown, '')
        || '}},"cooccurrence_bonus":' || cooccurrence_bonus || ',"raw_score":' || raw || ',"recommendations":'
        || coalesce(advice, '[]') || '}}' AS report
      FROM levelled LEFT JOIN nested USING (rid)"""

    for name, corpus in (("masked_text", "documents"), ("masked_text_derived", "derived"), ("masked_text_orders", "orders")):
        out[name] = masked_sql(corpus)

    for name in ("folder_scan", "folder_update", "stream_sinks_reports"):
        out[name] = out["report_uploads"]
    out["stream_sinks_errors"] = out["stream_quarantine"]
    out["stream_once"] = out["report_documents"]
    out["stream_exposure"], out["stream_levels"] = out["exposure_by_source"], out["docs_by_level_source"]
    out["top_k_by_source"] = scan_ctes("documents") + """
      SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score, risk_level
      FROM levelled QUALIFY rank <= 5"""
    for name, fields in (("exposure_cube", "category"), ("exposure_cube_two", "category, severity")):
        out[name] = scan_ctes("documents") + f"""
          SELECT source, lang, {fields}, CAST(grouping(source, lang, {fields}) AS INTEGER) AS grouping,
            count(DISTINCT rid) AS documents, CAST(sum(count) AS BIGINT) AS matches
          FROM found JOIN docs USING (rid) GROUP BY CUBE (source, lang, {fields})"""
    out["distinct_exposed"] = scan_ctes("orders") + """
      SELECT key, count(DISTINCT value) AS values FROM (SELECT r.key, unnest(m) AS value FROM hits JOIN rules r USING (idx)) GROUP BY key"""
    out["distinct_estimates"] = f"SELECT *, true AS near FROM ({out['distinct_exposed']})"
    out["report_metrics"] = f"""
      WITH v AS ({out['own_report_violations']}), n AS (SELECT count(*) AS n FROM customer),
      checks(metric) AS (VALUES ('score_range'), ('risk_level'), ('total_findings'), ('total_characters'), ('cooccurrence_bonus'),
        ('size_bytes'), ('finding_count'), ('breakdown_entry'))
      SELECT metric, count(violation) AS n FROM checks LEFT JOIN v ON metric = violation GROUP BY metric
      UNION ALL SELECT 'broken', count(*) FROM v UNION ALL SELECT 'rows', n FROM n"""
    for name, browser in (("sql_functions", False), ("sql_functions_browser", True)):
        out[name] = f"""
          SELECT o_orderkey, {luhn_sql('card')} AS luhn, {verhoeff_sql('identity')} AS verhoeff,
            regexp_full_match(code, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') AS pan, {redact_sql('code')} AS redacted,
            {bytes_sql('size_bytes')} AS shown, upper(replace(key, '_', ' ')) AS label,
            CAST({points_sql('key', 'n', 'confidence')} AS DOUBLE) AS contribution,
            {final_sql('raw_score', bonus_sql('types', browser), browser)} AS final, {level_sql('score')} AS risk_level,
            {level_sql('score * CAST(1.01 AS DOUBLE)' if browser else 'trunc(score * CAST(1.01 AS DOUBLE))')} AS tier
          FROM ({derive_sql('sql_values')})"""

    # decoding
    latin = r"regexp_replace(text, '[^\x{00}-\x{ff}]', '?', 'g')"
    decoded = f"CASE WHEN doc_id % 3 = 2 THEN {latin} ELSE text END"
    out["binary_decode"] = (
        f"SELECT doc_id, md5({decoded}) AS text_md5, CAST(length({decoded}) AS INTEGER) AS chars FROM documents"
    )
    replaced = r"regexp_replace(text, '[\x{80}-\x{ff}]', chr(65533), 'g')"
    decoded = f"CASE WHEN doc_id % 3 = 2 THEN {replaced} ELSE text END"
    out["binary_decode_browser"] = (
        f"SELECT doc_id, md5({decoded}) AS text_md5, CAST(length({decoded}) AS INTEGER) AS chars FROM documents"
    )
    return out
