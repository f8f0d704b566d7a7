"""String, number and record expressions (JVM-side, codegen friendly).

Every function takes and returns ``Column`` objects so callers compose them inside
one projection; nothing here leaves the JVM except :func:`python_fixed1`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference / the libraries it relies on)
# ---------------------------------------------------------------------------
# Default missing-value words of pandas ``read_csv``.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
# Error-message markers that send generation on to the next candidate model.
RETRY_MARKERS = ["404", "model_not_found", "does not exist"]
# Document template pieces and cuts used when indexing a question-answer pair.
DOC_QUESTION_CUT = 600
DOC_ANSWER_CUT = 900
META_TITLE_CUT = 200
# Request validation bounds (characters, checked before stripping).
QUESTION_MIN_CHARS = 5
QUESTION_MAX_CHARS = 1000
# ---------------------------------------------------------------------------

# Python's ``\s`` (str.isspace) expressed for Java and RE2 regex engines alike:
# ASCII whitespace plus VT, the four information separators, NEL and every
# Unicode space/line/paragraph separator.  U+200B is deliberately not included.
UNICODE_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
UNICODE_WS_RUN = UNICODE_WS + "+"


def collapse_ws(c: Column) -> Column:
    """STR-2: runs of Unicode whitespace -> one space, then strip."""
    return F.trim(F.regexp_replace(c, UNICODE_WS_RUN, " "))


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(c, f"^{UNICODE_WS_RUN}|{UNICODE_WS_RUN}$", "")


def normalize_na(c: Column, tokens: list[str] | None = None) -> Column:
    """SRC-3: pandas NA words become null."""
    toks = NA_TOKENS if tokens is None else tokens
    return F.when(c.isin(toks), F.lit(None).cast("string")).otherwise(c)


def doc_template(title: Column, question: Column, answer: Column,
                 q_cut: int | None = DOC_QUESTION_CUT, a_cut: int | None = DOC_ANSWER_CUT) -> Column:
    """STR-4: ``Q: {title}\\n{question[:600]}\\n\\nA: {answer[:900]}`` (title not cut; None: no cut)."""
    return F.concat(
        F.lit("Q: "), title, F.lit("\n"),
        question if q_cut is None else F.substring(question, 1, q_cut), F.lit("\n\nA: "),
        answer if a_cut is None else F.substring(answer, 1, a_cut),
    )


def ellipsis(c: Column, n: int, mode: str = "if_longer") -> Column:
    """STR-5: cut to ``n`` code points.

    modes: ``if_longer`` adds ``...`` only when text was cut; ``always`` adds it to
    any text; ``never`` only cuts; ``strip`` cuts, strips whitespace, adds ``...``.
    """
    cut = F.substring(c, 1, n)
    if mode == "if_longer":
        return F.when(F.length(c) > n, F.concat(cut, F.lit("..."))).otherwise(c)
    if mode == "always":
        return F.concat(cut, F.lit("..."))
    if mode == "never":
        return cut
    if mode == "strip":
        return F.concat(py_strip(cut), F.lit("..."))
    raise ValueError(f"unknown ellipsis mode {mode!r}")


def relevance_pct(distance: Column) -> Column:
    """STR-6 numeric part: ``(1 - distance) * 100``."""
    return (F.lit(1.0) - distance) * F.lit(100.0)


def fixed1(x: Column) -> Column:
    """``f"{x:.1f}"`` for |x| < 1000 without leaving the JVM.

    ``format_number`` rounds the exact binary value half-even (0.25 -> 0.2,
    12.35 -> 12.3), which is what Python's formatter does; ``format_string``
    would round the shortest decimal form half-up instead.
    """
    return F.regexp_replace(F.format_number(x, 1), ",", "")


@F.pandas_udf(T.StringType())
def python_fixed1(x: pd.Series) -> pd.Series:
    """Reference formatter, used by tests to check :func:`fixed1`."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:.1f}")


def model_label(m: Column) -> Column:
    """STR-7: first two ``-``-separated segments, else the whole name."""
    return F.substring_index(m, "-", 2)


def is_retry_error(msg: Column) -> Column:
    """STR-8: does an error message mean "model missing, try the next one"?"""
    cond = F.lit(False)
    for marker in RETRY_MARKERS:
        cond = cond | F.coalesce(msg.contains(marker), F.lit(False))
    return cond


def error_action(msg: Column) -> Column:
    """STR-8: ``retry`` / ``fail`` per error message, ``none`` for no error."""
    return (F.when(msg.isNull(), F.lit("none"))
            .when(is_retry_error(msg), F.lit("retry"))
            .otherwise(F.lit("fail")))


def default_title(c: Column) -> Column:
    """STR-9: missing title -> ``Unknown``."""
    return F.coalesce(c, F.lit("Unknown"))


def default_score(c: Column) -> Column:
    """STR-9: missing score -> 0."""
    return F.coalesce(c, F.lit(0))


def clock_label(ts: Column) -> Column:
    """STR-10: ``HH:MM`` of a timestamp (session time zone)."""
    return F.date_format(ts, "HH:mm")


def elapsed_seconds(start: Column, end: Column, digits: int = 3) -> Column:
    """STR-11: ``end - start`` in seconds, rounded.

    ``timestamp_diff`` on wall-clock (NTZ) values does not depend on the session
    time zone, so a daylight-saving change never shifts the result.
    """
    # round in integer microseconds (half up), then one division: no engine-specific
    # rounding of a binary fraction, so every engine returns the same double
    unit = 10 ** (6 - digits)
    micros = F.timestamp_diff("MICROSECOND", start, end)
    q = F.floor((micros + F.lit(unit // 2)) / F.lit(unit))
    return q / F.lit(float(10 ** digits))


def validate_question(raw: Column) -> tuple[Column, Column]:
    """FLT-3: classify a raw question; returns (status, stripped text or null).

    Length is checked on the raw text first (5..1000 code points), then the text
    is stripped and an empty result is its own class, as in the request path.
    """
    stripped = py_strip(raw)
    status = (F.when(raw.isNull(), F.lit("too_short"))
              .when(F.length(raw) < QUESTION_MIN_CHARS, F.lit("too_short"))
              .when(F.length(raw) > QUESTION_MAX_CHARS, F.lit("too_long"))
              .when(F.length(stripped) == 0, F.lit("empty_after_strip"))
              .otherwise(F.lit("ok")))
    return status, F.when(status == "ok", stripped)


def tokens(text: Column) -> Column:
    """Lower-cased letter/digit runs of a text (shared by embedder and tags)."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0)
