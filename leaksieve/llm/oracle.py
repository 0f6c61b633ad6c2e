"""The registered queries that SQL can express, restated for an independent engine (DuckDB)."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(table: str, key: str, text: str, inside: str) -> str:
    """``row, key, n, p, word`` of every word, numbered from 1; ``n`` counts those of the row."""
    return f"""
      SELECT row, {key}, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM (
        SELECT row_number() OVER (ORDER BY {key}) AS row, {key},
          regexp_extract_all({text}, '{inside}') AS w FROM {table})"""


def _runs(words: str, length: int) -> str:
    """The ``length`` words from each word on, as one string; none where the row ends before."""
    return f"""
      SELECT *, array_to_string(list(word) OVER (PARTITION BY row ORDER BY p
        ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING), ' ') AS run
      FROM {words} QUALIFY p + {length - 1} <= n"""


def decontaminate_sql(window: int = 13) -> str:
    inside = r"[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"
    lowered = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    # a phrase is as long as the window, or as its item where that is shorter
    lengths = range(1, window + 1)
    doc_runs = " UNION ALL ".join(
        f"SELECT row, p, {k} AS k, run FROM ({_runs(f'(SELECT * FROM dw WHERE {k} IN (SELECT k FROM phrases))', k)})"
        for k in lengths
    )
    item_runs = " UNION ALL ".join(
        f"SELECT item_id, {k} AS k, run FROM ({_runs(f'(SELECT * FROM bw WHERE least(n, {window}) = {k})', k)})"
        for k in lengths
    )
    return f"""
    WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS row, doc_id,
        CAST(len(regexp_extract_all({lowered}, '{inside}')) AS BIGINT) AS n_words FROM documents),
    dw AS MATERIALIZED ({_words('documents', 'doc_id', lowered, inside)}),
    bw AS MATERIALIZED ({_words('benchmark', 'item_id', lowered, inside)}),
    phrases AS MATERIALIZED (SELECT DISTINCT * FROM ({item_runs})),
    found AS MATERIALIZED (SELECT d.row, d.p, d.k, f.item_id FROM ({doc_runs}) d JOIN phrases f ON d.k = f.k AND d.run = f.run),
    hit AS (SELECT row, count(*) AS n_hit FROM (SELECT DISTINCT row, unnest(range(p, p + k)) AS at FROM found) GROUP BY row),
    items AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
      FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY row)
    SELECT doc_id, n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= n_words AS contaminated
    FROM docs LEFT JOIN hit USING (row) LEFT JOIN items USING (row)"""


def substring_dedup_sql(window: int = 20) -> str:
    inside = r"[^ \t\n\x{0B}\x{0C}\r]+"
    text = "coalesce(text, '')"
    return f"""
    WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS row, doc_id,
        CAST(len(regexp_extract_all({text}, '{inside}')) AS BIGINT) AS n_words FROM documents),
    dw AS MATERIALIZED ({_words('documents', 'doc_id', text, inside)}),
    runs AS (SELECT row, doc_id, p, md5(run) AS run FROM ({_runs('dw', window)})),
    later AS (SELECT row, p FROM runs QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, p) > 1),
    gone AS (SELECT DISTINCT row, unnest(range(p, p + {window})) AS p FROM later),
    kept AS (SELECT row, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS words FROM dw ANTI JOIN gone USING (row, p) GROUP BY row)
    SELECT doc_id, n_words, n_words - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
    FROM docs LEFT JOIN kept USING (row)"""


def suffix_dedup_sql(size: int = 200) -> str:
    """Hashes of ``size`` bytes are put together from hashes of 1, 2, 4, ... bytes."""
    steps, width = ["h1 AS (SELECT *, hash(byte) AS h1 FROM bytes)"], 1
    while 2 * width <= size:
        ahead = f"lead(h{width}, {width}) OVER (PARTITION BY row ORDER BY p)"
        steps.append(f"h{2 * width} AS (SELECT *, hash(h{width}, {ahead}) AS h{2 * width} FROM h{width})")
        width *= 2
    parts, at = [], 0
    for power in (2**i for i in reversed(range(size.bit_length()))):
        if size & power:
            parts.append(f"lead(h{power}, {at}) OVER (PARTITION BY row ORDER BY p)")
            at += power
    return f"""
    WITH docs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS row, doc_id,
        regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS w FROM documents),
    bytes AS (SELECT row, len(w) AS n, unnest(w) AS byte, generate_subscripts(w, 1) AS p FROM docs),
    {", ".join(steps)},
    windows AS (SELECT row, p, n, byte, CASE WHEN p + {size - 1} <= n THEN hash({", ".join(parts)}) END AS h FROM h{width}),
    counted AS (SELECT *, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS twice FROM windows),
    marked AS (SELECT *, bool_or(twice) OVER (PARTITION BY row ORDER BY p
      ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) AS gone FROM counted),
    edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY row ORDER BY p), false) AS opens FROM marked),
    sums AS (SELECT row, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
      string_agg(byte, '' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM edges GROUP BY row)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(unhex(coalesce(kept, ''))) AS kept_sha256
    FROM docs LEFT JOIN sums USING (row)"""


def conversation_repair_sql() -> str:
    """The cheapest repair by dynamic programming from the last row back.

    For each of the states nothing, s, u, a there is the least (cost, audit) with its lines.
    Rows of one turn are told apart by role and text; only equal rows share a turn in the tables.
    """
    nothing, infinite = "CAST([] AS VARCHAR[])", 10**9
    made = lambda cost, edit, lines, rest: (
        f"struct_pack(c := CAST({cost} + {rest}.c AS BIGINT), a := '{edit}' || {rest}.a, l := list_concat({lines}, {rest}.l))"
    )
    never = f"struct_pack(c := CAST({infinite} AS BIGINT), a := '', l := {nothing})"
    least = lambda *options: f"list_sort([{', '.join(options)}])[1]"
    speaker = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    wanted, after = {0: 2, 1: 2, 2: 3, 3: 2}, {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def edited(s: int) -> str:
        keep = " ".join(
            f"WHEN NOT r.gone AND r.i = '{i}' THEN {made('r.more', 'K', '[r.line]', f'b.s{t}')}" for i, t in after[s].items()
        )
        again = made("3 + r.more", "R", f"['{speaker[s]}:' || r.text]", f"b.s{wanted[s]}")
        return least(
            made(4, "D", nothing, f"b.s{s}"), f"CASE {keep} ELSE {never} END", f"CASE WHEN r.gone THEN {never} ELSE {again} END"
        )

    put = lambda s, rest: made(3, "I", f"['{speaker[s]}:']", rest)
    best = {s: least(edited(s), put(s, edited(wanted[s]))) for s in (2, 3)}
    best |= {s: least(edited(s), put(s, best[2])) for s in (0, 1)}
    step = ", ".join(f"s{s} := {best[s]}" for s in range(4))
    end = f"struct_pack(c := CAST(0 AS BIGINT), a := '', l := {nothing})"
    start = f"struct_pack(s0 := {end}, s1 := {put(1, put(2, end))}, s2 := {put(2, end)}, s3 := {end})"
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    bits = "lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = (
        "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(key) + 1), "
        "lambda i: CAST(ord(substr(key, i, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, "
        f"list_reduce(list_concat([xor(c, b) & 255], range(8)), {bits}))), 4294967295)"
    )
    return f"""
    WITH keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {key} AS key FROM conversations),
    fated AS (SELECT *, {crc} % 20 AS fate FROM keyed),
    damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
        CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE fate WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM fated),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p,
        right(rtrim(text, {blank}), 1) AS last, left(role, 1) AS i FROM damaged),
    judged AS (SELECT *, last = '' AS blank,
        last <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS duplicate,
        coalesce(lag(i) OVER (PARTITION BY conv_id ORDER BY p) || i NOT IN ('su', 'ua', 'au'), false) AS illegal FROM placed),
    named AS (SELECT *, NOT blank AND NOT duplicate AND last NOT IN ('.', '!', '?') AS truncated FROM judged),
    listed AS (SELECT conv_id,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
        count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal,
        list(struct_pack(i := i, gone := blank OR duplicate, more := CASE WHEN truncated THEN 3 ELSE 0 END,
          line := role || ':' || text, text := text) ORDER BY p DESC) AS rows FROM named GROUP BY conv_id),
    repaired AS (SELECT *, list_reduce(rows, lambda b, r: struct_pack({step}), {start}).s0 AS best FROM listed)
    SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
      coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.l, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": suffix_dedup_sql(),
        "op5_decontaminate": decontaminate_sql(),
        "op6_substring_dedup": substring_dedup_sql(),
        "op12_conversation_repair": conversation_repair_sql(),
    }
