"""Queries on the quality of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boreline.llm import robust_outliers as ro
from boreline.llm.registry import query, table

P = range(len(ro.NAMES))


def _factor_sql(source: str, name: str) -> str:
    """CTEs from own, m*, c* to the Cholesky factor own, m*, l*, an entry at a time."""
    out, last = [], source
    for i in P:
        for j in range(i + 1):
            rest = f"(c{i}{j} + {ro.FEATURES[ro.NAMES[i]] ** 2 if i == j else 0.0!r}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + ")"
            out.append(f"{name}_{i}{j} AS (SELECT *, {f'sqrt({rest})' if i == j else f'{rest} / l{j}{j}'} AS l{i}{j} FROM {last})")
            last = f"{name}_{i}{j}"
    return ", ".join(out) + f", {name} AS (SELECT * EXCLUDE ({', '.join(f'c{i}{j}' for i in P for j in range(i + 1))}) FROM {last})"


def _distance_sql(source: str, name: str) -> str:
    """CTEs from features and factors to d2."""
    out, last = [], source
    for i in P:
        rest = f"({ro.NAMES[i]} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i)) + f") / l{i}{i}"
        out.append(f"{name}_{i} AS (SELECT *, {rest} AS y{i} FROM {last})")
        last = f"{name}_{i}"
    return ", ".join(out) + f", {name} AS (SELECT * EXCLUDE ({', '.join(f'y{i}' for i in P)}), {' + '.join(f'y{i} * y{i}' for i in P)} AS d2 FROM {last})"


def _step_sql(n: int) -> str:
    """One concentration step, from factors f<n> to f<n + 1>."""
    means = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(ro.NAMES))
    scatter = ", ".join(f"{ro.CONSISTENCY} * covar_pop({ro.NAMES[i]}, {ro.NAMES[j]}) AS c{i}{j}" for i in P for j in range(i + 1))
    return f"""j{n} AS (SELECT * FROM members JOIN f{n} USING (own)), {_distance_sql(f'j{n}', f'd{n}')},
b{n} AS (SELECT *, floor(16 * log2(1 + 64 * d2)) AS bin FROM d{n}),
e{n} AS (SELECT own, list_sort(list(bin))[CAST(ceil({ro.KEEP} * count(*)) AS INTEGER)] AS edge FROM b{n} GROUP BY own),
g{n} AS (SELECT own, {means}, {scatter} FROM b{n} JOIN e{n} USING (own) WHERE bin <= edge GROUP BY own), {_factor_sql(f'g{n}', f'f{n + 1}')}"""


def _sql() -> str:
    blank = "\\x20\\x09-\\x0D"
    bins = ", ".join(f"list_sort(list(floor({c} * {ro.BINS}))) AS b{i}" for i, c in enumerate(ro.NAMES))
    middle = ", ".join(f"(b{i}[CAST(ceil(0.5 * n) AS INTEGER)] + 0.5) / {ro.BINS} AS m{i}" for i in P)
    spread = ", ".join(f"(b{i}[CAST(ceil(0.84 * n) AS INTEGER)] - b{i}[CAST(ceil(0.16 * n) AS INTEGER)]) / {2.0 * ro.BINS} AS s{i}" for i in P)
    start = ", ".join(f"{f's{i} * s{i}' if i == j else '0.0'} AS c{i}{j}" for i in P for j in range(i + 1))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, lang, source FROM documents),
w AS (SELECT id, list_filter(string_split_regex(t, '[{blank}]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{blank}]')) AS ls FROM d),
v AS (SELECT id, i, [ws[i], ws[i + 1], ws[i + 2]] AS g FROM w, unnest(range(1, len(ws) - 1)) AS x(i)),
r AS (SELECT id, i FROM v QUALIFY count(*) OVER (PARTITION BY id, g) > 1),
k AS (SELECT id, least(3, i - lag(i, 1, i - 3) OVER (PARTITION BY id ORDER BY i)) AS n FROM r),
rep AS (SELECT id, sum(n) AS n_repeat_words FROM k GROUP BY id),
s AS MATERIALIZED (SELECT id, doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(t, '[{blank}]+', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM d JOIN w USING (id) LEFT JOIN rep USING (id)),
x AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, ln(greatest(word_chars, 1) / greatest(n_words, 1)::DOUBLE) AS word_length,
        sqrt(n_symbols / greatest(n_words, 1)::DOUBLE) AS symbols, sqrt(n_dup_lines / greatest(n_words, 1)::DOUBLE) AS dup_lines,
        sqrt(n_repeat_words / greatest(n_words, 1)::DOUBLE) AS repeats, ln(greatest(n_words, 1)::DOUBLE) AS size,
        ['0', '1' || chr(31) || coalesce('1' || lang, '0'), '2' || chr(31) || coalesce('1' || lang, '0') || chr(31) || coalesce('1' || source, '0')] AS own3 FROM s),
u AS (SELECT id, unnest(own3) AS own FROM x WHERE NOT base_failed),
z AS (SELECT own, count(*) AS n FROM u GROUP BY own),
m AS MATERIALIZED (SELECT id, max(own) FILTER (WHERE n >= {ro.MIN_ROWS}) AS model FROM u JOIN z USING (own) GROUP BY id),
members AS MATERIALIZED (SELECT own, {', '.join(ro.NAMES)} FROM u JOIN x USING (id) WHERE own IN (SELECT model FROM m)),
l AS (SELECT own, count(*) AS n, {bins} FROM members GROUP BY own), q AS (SELECT own, {middle}, {spread} FROM l),
g AS (SELECT own, {', '.join(f'm{i}' for i in P)}, {start} FROM q), {_factor_sql('g', 'f0')},
{', '.join(_step_sql(n) for n in range(ro.STEPS))},
a AS (SELECT x.id, f{ro.STEPS}.*, {', '.join(ro.NAMES)} FROM x JOIN m ON x.id = m.id JOIN f{ro.STEPS} ON model = own), {_distance_sql('a', 'dist')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(d2 > {ro.CUTOFF}, false) AS kept FROM x LEFT JOIN dist ON x.id = dist.id"""


@query("op8_quality", _sql())
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Base rules and outlier verdict for all documents."""
    return ro.judge(table(spark, folder, "documents")).drop("distance2")
