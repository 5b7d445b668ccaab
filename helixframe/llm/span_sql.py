"""DuckDB SQL for the span queries."""

from __future__ import annotations


def with_matches(kinds: list[tuple[str, str, str]], needs: dict[str, str] | None = None) -> str:
    """Common tables up to f: for each kind m_ (matches), n_ (their lengths), g_ (lengths of the gaps between them), s_ (kept spans).

    needs: a pattern that a text must have to be taken apart for a kind.
    """
    q = lambda p: "'" + p.replace("'", "''") + "'"
    needs = needs or {}
    found = ", ".join((f"CASE WHEN regexp_matches(t, {q(needs[k])}) THEN regexp_extract_all(t, {q(p)}) ELSE [] END" if k in needs else f"regexp_extract_all(t, {q(p)})") + f" AS m_{k}" for k, p, _ in kinds)
    sizes = ", ".join(f"list_transform(m_{k}, lambda x: length(x)) AS n_{k}, CASE WHEN len(m_{k}) > 0 THEN list_transform(regexp_split_to_array(t, {q(p)}), lambda x: length(x)) ELSE [] END AS g_{k}" for k, p, _ in kinds)
    spans = ", ".join(
        f"list_filter(list_transform(generate_series(1, len(m_{k})), lambda i: {{'start': list_sum(g_{k}[1:i]) + coalesce(list_sum(n_{k}[1:i - 1]), 0), 'rank': {i}, 'n': n_{k}[i], 'm': m_{k}[i], 'kind': '{k}'}}), lambda s: {keep}) AS s_{k}"
        for i, (k, _, keep) in enumerate(kinds)
    )
    return f"d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT *, {found} FROM d), g AS (SELECT *, {sizes} FROM m), f AS (SELECT doc_id, {spans} FROM g)"


JOINED = "coalesce(array_to_string(list_transform({spans}, lambda s: s.kind || ':' || CAST(s.start AS BIGINT) || ':' || CAST(s.start + s.n AS BIGINT)), ','), '')"

DIGITS = "regexp_replace(s.m, '[^0-9]', '', 'g')"
LUHN = f"""length({DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(generate_series(1, length({DIGITS})), lambda i:
  CASE WHEN (length({DIGITS}) - i) % 2 = 0 THEN CAST(substring({DIGITS}, CAST(i AS INT), 1) AS INT)
  WHEN CAST(substring({DIGITS}, CAST(i AS INT), 1) AS INT) > 4 THEN CAST(substring({DIGITS}, CAST(i AS INT), 1) AS INT) * 2 - 9
  ELSE CAST(substring({DIGITS}, CAST(i AS INT), 1) AS INT) * 2 END)) % 10 = 0"""
IP = r"len(list_filter(string_split(s.m, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0"
TURNED = "(substring(s.m, 5) || substring(s.m, 1, 4))"
#: Letters become two digits, in two parts so that each fits 128 bits: 34 signs are at most 68 digits.
MOD97 = f"""list_reduce(list_prepend(0, list_transform(string_split({TURNED}, ''), lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
  lambda a, b: CASE WHEN b > 9 THEN (a * 100 + b) % 97 ELSE (a * 10 + b) % 97 END) = 1"""


def op5_sql() -> str:
    near = "regexp_matches(substring(t, CAST(greatest(s.start - 40, 0) + 1 AS BIGINT), CAST(least(s.start, 40) AS BIGINT)), '(?i)\\b(?:ssn|social security|tax id)\\b')"
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", IP),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", LUHN),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 9 AND 15"),
        ("iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", MOD97),
        ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", f"NOT regexp_matches(s.m, '^(?:000|666|9)|-00-|-0000$') AND {near}"),
    ]
    base = " || ".join(f"s_{k}" for k, _, _ in kinds[:4])
    both = " || ".join(f"s_{k}" for k, _, _ in kinds)
    return f"""WITH {with_matches(kinds)}
SELECT doc_id, {", ".join(f"CAST(len(s_{k}) AS BIGINT) AS n_{k}" for k, _, _ in kinds[:4])},
sha256({JOINED.format(spans=f"({base})")}) AS base_sha256, {JOINED.format(spans=f"({both})")} AS spans FROM f"""


def op7_sql() -> str:
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
    value = assign.replace("[A-Za-z0-9+/_.=-]+", "([A-Za-z0-9+/_.=-]+)").replace("'", "''")
    kinds = [
        ("assign", assign, f"length(regexp_extract(s.m, '{value}', 1)) >= 12"),
        ("access", "AKIA[A-Z0-9]+", "s.n >= 18"),
        ("hex", "[0-9a-f]+", "s.n >= 16"),
        ("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "true"),
        ("git", "gh[pousr]_[A-Za-z0-9]{36,}", "true"),
    ]
    base = " || ".join(f"s_{k}" for k in ("assign", "access", "hex"))
    both = " || ".join(f"s_{k}" for k, _, _ in kinds)
    # Texts have very many short runs of hex letters; only those with a long one are taken apart.
    return f"""WITH {with_matches(kinds, {"hex": "[0-9a-f]{16}"})}
SELECT doc_id, {", ".join(f"CAST(len(s_{k}) AS BIGINT) AS n_{k}" for k in ("assign", "access", "hex"))},
sha256({JOINED.format(spans=f"list_sort({base})")}) AS base_sha256, {JOINED.format(spans=f"list_sort({both})")} AS spans FROM f"""


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all(coalesce({LOWERED}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT item, w, least(10, len(w)) AS m FROM items WHERE len(w) > 0), unnest(generate_series(1, len(w) - m + 1)) AS t(i)),
docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
places AS (SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS s FROM docs, (SELECT DISTINCT m FROM windows), unnest(generate_series(1, len(w) - m + 1)) AS t(p)),
found AS (SELECT DISTINCT doc_id, p, m, item FROM places JOIN windows USING (m, s)),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + m - 1)) AS q FROM found) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)"""
