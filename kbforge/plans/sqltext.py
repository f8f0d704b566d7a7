"""DuckDB SQL fragments used by the oracle side of the query catalog.

These are independent re-statements of each operator's semantics in SQL, so the
Spark result can be checked against a second engine.  They are text only; the
library never executes them.
"""

from __future__ import annotations

from ..functions.text import UNICODE_WS_RUN
from .adapters import SQL_TOKENS

NL = "chr(10)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def collapse_ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '{UNICODE_WS_RUN}', ' ', 'g'))"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{UNICODE_WS_RUN}|{UNICODE_WS_RUN}$', '', 'g')"


def clean_html(x: str) -> str:
    """STR-1 for code-free HTML (the regex path)."""
    tags = "script|style|template|rt|rp"
    e = f"regexp_replace({x}, '(?is)<({tags})\\b.*?</({tags})\\s*>', ' ', 'g')"
    e = f"regexp_replace({e}, '(?s)<!--.*?-->', ' ', 'g')"
    e = f"regexp_replace({e}, '(?i)<code\\b[^>]*>([^<]*)</code\\s*>', ' ' || chr(10) || '```' || chr(10) || '\\1' || chr(10) || '```' || chr(10) || ' ', 'g')"
    e = f"regexp_replace({e}, '<[!?/]?[A-Za-z][^>]*>|<![^>]*>|<\\?[^>]*>', ' ', 'g')"
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·")]:
        e = f"replace({e}, {q(ent)}, {q(ch)})"
    e = f"regexp_replace({e}, '&amp;?', '&', 'g')"
    return f"coalesce({collapse_ws(e)}, '')"


def tokens(x: str) -> str:
    return SQL_TOKENS.format(x=x)


def bucket(t: str, dim: int) -> str:
    return f"(CAST(('0x' || substr(md5({t}), 1, 8)) AS BIGINT) % {dim})"


def sparse_vectors(name: str, src: str, key: str, text: str, dim: int) -> str:
    """CTEs ``{name}_vec(key, b, c)`` and ``{name}_norm(key, n2)`` for hashed counts."""
    return (f"{name}_tok AS (SELECT {key} AS key, unnest({tokens(text)}) AS t FROM {src}), "
            f"{name}_vec AS (SELECT key, {bucket('t', dim)} AS b, count(*) AS c FROM {name}_tok GROUP BY ALL), "
            f"{name}_norm AS (SELECT s.{key} AS key, CAST(coalesce(sum(v.c * v.c), 0) AS DOUBLE) AS n2 "
            f"FROM {src} s LEFT JOIN {name}_vec v ON v.key = s.{key} GROUP BY s.{key})")


def knn_sparse(qname: str, dname: str, k: int, out: str = "hits") -> str:
    """Exact top-k by cosine between two hashed-count vector sets (ties by key)."""
    return (f"{out}_dots AS (SELECT qv.key AS query_id, dv.key AS key, CAST(sum(qv.c * dv.c) AS DOUBLE) AS dot "
            f"FROM {qname}_vec qv JOIN {dname}_vec dv USING (b) GROUP BY ALL), "
            f"{out}_dist AS (SELECT qn.key AS query_id, dn.key AS key, "
            f"CASE WHEN dn.n2 * qn.n2 = 0 THEN 1.0 ELSE 1.0 - coalesce(x.dot, 0.0) / sqrt(dn.n2 * qn.n2) END AS distance "
            f"FROM {qname}_norm qn CROSS JOIN {dname}_norm dn "
            f"LEFT JOIN {out}_dots x ON x.query_id = qn.key AND x.key = dn.key), "
            f"{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS rank "
            f"FROM {out}_dist) WHERE rank <= {k})")


def validate(x: str) -> str:
    """FLT-3 status expression."""
    return (f"CASE WHEN {x} IS NULL THEN 'too_short' WHEN length({x}) < 5 THEN 'too_short' "
            f"WHEN length({x}) > 1000 THEN 'too_long' WHEN length({py_strip(x)}) = 0 THEN 'empty_after_strip' "
            f"ELSE 'ok' END")


def fixed1(x: str) -> str:
    return f"printf('%.1f', {x})"
