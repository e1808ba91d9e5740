"""The SQL of a ranked prefix search over the derived documents."""

from __future__ import annotations

from lectern.plans import fixtures as fx

PREFIXES = ("stlich", "er")
#: Digits of the ranks that the SQL shows and orders by (its ORDER BY names the column that it shows), before keys.
SHOWN = 9


def bm25(scope: str = "true", prefixes: tuple[str, ...] = PREFIXES, order: str = "rank, key", limit: int | None = 200) -> str:
    each = ",".join(f"('{p}')" for p in prefixes)
    return f"""
WITH {fx.SEARCH_DOCS},
t AS (SELECT key, kind, book_id, regexp_extract_all(strip_accents(lower(content)), '[\\p{{L}}\\p{{N}}]+') AS words FROM s),
c AS (SELECT count(*)::DOUBLE AS total, avg(len(words)) AS mean FROM t),
u AS (SELECT key, unnest(words) AS term FROM t),
p AS (SELECT * FROM (VALUES {each}) x(prefix)),
f AS (SELECT key, prefix, count(*)::DOUBLE AS f FROM u JOIN p ON starts_with(term, prefix) GROUP BY ALL),
n AS (SELECT prefix, count(*)::DOUBLE AS n FROM f GROUP BY 1),
i AS (SELECT prefix, CASE WHEN ln((total - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE
      ELSE ln((total - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) END AS idf, mean FROM n, c),
r AS (SELECT key, round(-sum(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(words) / mean))), 12) AS rank
      FROM f JOIN i USING (prefix) JOIN t USING (key) GROUP BY key HAVING count(*) = {len(prefixes)})
SELECT key, kind, book_id, round(rank, 9) AS rank FROM r JOIN t USING (key) WHERE {scope} ORDER BY {order} {"" if limit is None else f"LIMIT {limit}"}"""
