"""The registered queries of this subpackage, each beside the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import (
    conversation_repair,
    decontamination,
    html_text,
    jaccard,
    language_id,
    line_templates,
    multiset_hash,
    periodic_runs,
    secrets,
    sentencepieces,
    sharding,
    token_files,
    topk,
)
from tickloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def wrap(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return wrap


OP7_SQL = r"""
WITH iw AS (
  SELECT item_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, array_to_string(w[s + 1:s + 10], ' ') AS win, least(len(w), 10) AS l
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM iw WHERE len(w) > 0)),
dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
lens AS (SELECT DISTINCT l FROM wins),
runs AS (
  SELECT r, s, l, array_to_string(w[s + 1:s + l], ' ') AS win
  FROM (SELECT r, w, l, unnest(range(0, len(w) - l + 1)) AS s FROM dw, lens WHERE len(w) >= l)),
hit AS (SELECT runs.r, runs.s, runs.l, wins.item_id FROM runs JOIN wins ON runs.win = wins.win AND runs.l = wins.l),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + l)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""




@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.report(table(spark, folder, "documents"), token_files.Tokenizer.load())


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.report(table(spark, folder, "documents"))


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
#: kind, regex, and the test of a match m, in the order of the kinds.
_KINDS = (
    ("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_extract(m, $re$, 2)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]+", "length(m) >= 24"),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", "true"),
    ("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "true"),
)


def _kind_sql(order: int, kind: str, regex: str, test: str) -> str:
    quoted = "'" + regex.replace("'", "''") + "'"
    return f"""
  SELECT r, {order} AS o, '{kind}' AS kind, e - length(m) AS s, e FROM (
    SELECT r, m, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM (
      SELECT r, unnest(f) AS m, unnest(gaps[1:len(f)]) AS g, generate_subscripts(f, 1) AS i FROM (
        SELECT r, regexp_extract_all(text, {quoted}, 0) AS f, string_split_regex(text, {quoted}) AS gaps FROM d)))
  WHERE {test.replace("$re$", quoted)}"""


OP3_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), sp AS ("
    + " UNION ALL ".join(_kind_sql(n, *k) for n, k in enumerate(_KINDS))
    + """), per AS (
  SELECT r, count(*) FILTER (o = 0) AS a, count(*) FILTER (o = 1) AS c, count(*) FILTER (o = 2) AS h,
         string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, o) FILTER (o < 3) AS base,
         string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, o) AS spans
  FROM sp GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (r)"""
)


@query("op3_secret_scans", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(table(spark, folder, "documents"))


@query("op4_html_extraction")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.report(table(spark, folder, "pages"))


@query("op5_sentencepieces")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepieces.report(table(spark, folder, "documents"), sentencepieces.Pieces.load())


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
cut AS (SELECT r, doc_id, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS s FROM w WHERE len(w) > 0),
sh AS (SELECT DISTINCT r, doc_id, array_to_string(w[s + 1:s + 5], ' ') || ' ' || least(len(w), 5) AS t FROM cut),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
met AS (SELECT a.r AS ra, b.r AS rb, a.doc_id AS da, b.doc_id AS db, count(*) AS c FROM sh a JOIN sh b ON a.t = b.t AND a.r < b.r GROUP BY ALL),
link AS MATERIALIZED (SELECT DISTINCT da, db FROM met JOIN n x ON x.r = ra JOIN n y ON y.r = rb WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS MATERIALIZED (SELECT da AS u, db AS v FROM link UNION SELECT db, da FROM link),
reach AS (SELECT u, v FROM edge UNION SELECT reach.u, edge.v FROM reach JOIN edge ON reach.v = edge.u),
comp AS (SELECT u, least(min(v), u) AS c FROM reach GROUP BY u)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id
FROM w LEFT JOIN n USING (r) LEFT JOIN comp ON comp.u = doc_id
"""


@query("op6_ngram_jaccard_join", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents"))


@query("op7_benchmark_decontamination", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP8_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, dense_rank() OVER (ORDER BY doc_id NULLS FIRST, text) AS k, doc_id, text FROM documents),
raw AS (SELECT DISTINCT k, doc_id, text FROM doc WHERE text IS NOT NULL),
cut AS (SELECT k, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM raw),
tok AS (SELECT k, doc_id, ln, [CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END
        FOR x IN string_split_regex(line, '[ 	
]+') IF x <> ''] AS w FROM cut),
leafed AS (SELECT *, len(w) || ' ' || array_to_string(w[1:3], ' ') AS leaf FROM tok WHERE len(w) > 0),
leaf AS (SELECT leaf, count(*) AS n FROM leafed GROUP BY leaf HAVING count(*) >= 3),
sh AS (SELECT leafed.*, n FROM leafed JOIN leaf USING (leaf)),
pos AS (SELECT leaf, n, p, t, count(*) AS c FROM (SELECT leaf, n, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM sh) GROUP BY ALL HAVING count(*) * 2 > n),
agree AS (SELECT k, ln, count(*) AS a FROM (SELECT k, ln, leaf, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM sh) JOIN pos USING (leaf, p, t) GROUP BY k, ln),
named AS (SELECT k, doc_id, ln, CASE WHEN coalesce(a, 0) >= 0.8 * len(w) THEN 'leaf ' || leaf ELSE 'line ' || array_to_string(w, ' ') END AS template
          FROM sh LEFT JOIN agree USING (k, ln)),
rec AS (SELECT template, min(k) AS first FROM named GROUP BY template HAVING count(DISTINCT k) >= 3),
gone AS (SELECT DISTINCT k, ln FROM named JOIN rec USING (template) WHERE k <> first),
kept AS (SELECT k, string_agg(line, chr(10) ORDER BY ln) AS text FROM cut ANTI JOIN gone USING (k, ln) GROUP BY k),
lost AS (SELECT k, count(*) AS n FROM gone GROUP BY k)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_dropped, CASE WHEN n IS NULL THEN doc.text ELSE coalesce(kept.text, '') END AS text
FROM doc LEFT JOIN lost USING (k) LEFT JOIN kept USING (k)
"""


@query("op8_line_dedup", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return line_templates.report(table(spark, folder, "documents"))


@query("op9_sharding")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_table(table(spark, folder, "documents"))


@query("op10_topk_search")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return topk.report(table(spark, folder, "documents"))


OP11_SQL = r"""
WITH o AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r, doc_id, coalesce(text, '') AS t FROM documents),
nx AS (SELECT r, doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY r), first_value(t) OVER (ORDER BY r)) AS f FROM o),
ed AS (SELECT *, substr(t, 1, n - n // 2) || substr(f, 1, n // 2) AS e FROM nx),
v AS (SELECT r, 0 AS w, t FROM ed UNION ALL SELECT r, 1, e FROM ed),
line AS (SELECT r, w, unnest(string_split(t, chr(10))) AS p FROM v),
dig AS (SELECT r, w, k, sha256(k || ':' || p) AS h FROM line, (SELECT unnest(range(4)) AS k)),
lane AS (SELECT r, w, 4 * k + j AS nr, sum((('0x' || substr(h, 1 + 16 * j, 16))::UBIGINT % 4611686018427387904)::HUGEINT) % 4611686018427387904 AS x
         FROM dig, (SELECT unnest(range(4)) AS j) GROUP BY ALL),
strong AS (SELECT r, w, string_agg(lpad(lower(to_hex(x::BIGINT)), 16, '0'), '' ORDER BY nr) AS s FROM lane GROUP BY r, w),
ph AS (SELECT r, w, sha256(unnest(regexp_extract_all(t, '(?:[^ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c.!?][ \t]+){0,5}[^ \t\n\r\x0b\x0c]+', 0))) AS h FROM v),
word AS (SELECT r, w, q, ('0x' || substr(h, 1 + 16 * q, 16))::UBIGINT AS x FROM ph, (SELECT unnest(range(4)) AS q)),
bit AS (SELECT r, w, q, i, f, count(*) AS n, sum((x >> (i + 20 * f)::UBIGINT) & 1) AS c
        FROM word, (SELECT unnest(range(20)) AS i), (SELECT unnest(range(3)) AS f) GROUP BY ALL),
num AS (SELECT r, w, q, i, sum((c % 524288)::BIGINT << (20 * f)) AS x FROM bit GROUP BY ALL),
sk AS (SELECT r, w, string_agg(lpad(lower(to_hex(x::BIGINT)), 16, '0'), '' ORDER BY q, i) AS s FROM num GROUP BY r, w),
vec AS (SELECT r, w, any_value(n) AS n, list((2 * c - n)::BIGINT ORDER BY q, i, f) AS c FROM bit GROUP BY r, w),
fp AS (SELECT v.r, v.w, coalesce(n, 0) AS n, coalesce(c, list_transform(range(240), lambda z: 0::BIGINT)) AS c,
              lpad(lower(to_hex(coalesce(n, 0))), 16, '0') || strong.s || coalesce(sk.s, repeat('0', 1280)) AS s
       FROM v JOIN strong USING (r, w) LEFT JOIN sk USING (r, w) LEFT JOIN vec USING (r, w)),
dots AS (SELECT a.r, a.s, e.s AS es, list_dot_product(a.c::DOUBLE[], a.c::DOUBLE[]) AS aa, list_dot_product(e.c::DOUBLE[], e.c::DOUBLE[]) AS ee, list_dot_product(b.c::DOUBLE[], b.c::DOUBLE[]) AS bb,
                list_dot_product(a.c::DOUBLE[], e.c::DOUBLE[]) AS ae, list_dot_product(a.c::DOUBLE[], b.c::DOUBLE[]) AS ab
         FROM fp a JOIN fp e ON e.r = a.r AND e.w = 1 JOIN fp b ON b.w = 0 AND b.r = CASE WHEN a.r = (SELECT max(r) FROM o) THEN 1 ELSE a.r + 1 END WHERE a.w = 0)
SELECT doc_id, n::BIGINT AS n_chars, sha256(e) AS edited_sha256, s AS fingerprint, es AS edited_fingerprint,
       CASE WHEN aa + ee > 0 THEN least(greatest(2 * ae / (aa + ee), 0.0), 1.0) ELSE 1.0 END::DOUBLE AS near_edited,
       CASE WHEN aa + bb > 0 THEN least(greatest(2 * ab / (aa + bb), 0.0), 1.0) ELSE 1.0 END::DOUBLE AS near_next
FROM ed JOIN dots USING (r)
"""


@query("op11_multiset_hash", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return multiset_hash.report(table(spark, folder, "documents"))


def _crc_sql(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bits = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {bits}), 4294967295)"


def _more(path: str, cost: str, edit: str) -> str:
    """A path, nine digits of cost and then its edits, after one more edit; compared as a string."""
    return f"lpad(({path}[1:9]::BIGINT + {cost})::VARCHAR, 9, '0') || {path}[10:] || '{edit}'"


_NEVER = "'900000000'"
_KEPT = lambda path, initial: f"CASE WHEN gone OR a <> '{initial}' THEN {_NEVER} ELSE {_more(path, 'cut', 'K')} END"  # noqa: E731
_REROLED = lambda path: f"CASE WHEN gone THEN {_NEVER} ELSE {_more(path, '1 + cut', 'R')} END"  # noqa: E731
_DELETED = lambda path: _more(path, "2", "D")  # noqa: E731
_INSERTED = lambda path: _more(path, "5", "I")  # noqa: E731

OP12_SQL = (
    r"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         """
    + _crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")
    + r""" % 20 AS d FROM conversations),
dmg AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
               CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS c FROM src),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), c) AS i FROM dmg),
f AS (SELECT *, left(role, 1) AS a, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
             NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
t AS MATERIALIZED (SELECT conv_id, i, turn, role, text, a, pair, blank, seen AND NOT blank AS dup, open AND NOT seen AND NOT blank AS trunc,
             blank OR seen AS gone, CASE WHEN open AND NOT seen AND NOT blank THEN 5 ELSE 0 END AS cut FROM f),
dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000000' AS p0, '900000000' AS p1, '000000005I' AS p2, '000000010II' AS p3 FROM src
  UNION ALL
  SELECT conv_id, i, b0, b1, n2, least(b3, """
    + _INSERTED("n2")
    + """) FROM (
    SELECT *, least(b2, """
    + ", ".join(map(_INSERTED, ("b0", "b1", "b3")))
    + """) AS n2 FROM (
      SELECT dp.conv_id, t.i, """
    + f"{_DELETED('p0')} AS b0, least({_DELETED('p1')}, {_KEPT('p0', 's')}) AS b1, "
    + f"least({_DELETED('p2')}, {', '.join(_KEPT(p, 'u') + ', ' + _REROLED(p) for p in ('p0', 'p1', 'p3'))}) AS b2, "
    + f"least({_DELETED('p3')}, {_KEPT('p2', 'a')}, {_REROLED('p2')}) AS b3"
    + r"""
      FROM dp JOIN t ON t.conv_id IS NOT DISTINCT FROM dp.conv_id AND t.i = dp.i + 1))),
fin AS (SELECT conv_id, least(p0, p3)[1:9]::BIGINT AS cost, least(p0, p3)[10:] AS audit FROM dp
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
full_ AS (SELECT fin.conv_id, cost * (n > 0)::INT AS cost, CASE WHEN n > 0 THEN audit ELSE '' END AS audit FROM fin
          LEFT JOIN (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id) c ON c.conv_id IS NOT DISTINCT FROM fin.conv_id),
ch AS (SELECT conv_id, p, audit[p] AS e FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM full_)),
num AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS k FROM ch WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
got AS (SELECT num.*, t.role, t.text, max((e = 'K' AND a = 's')::INT) OVER (PARTITION BY num.conv_id) AS s
        FROM num LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM num.conv_id AND t.i = num.i AND e <> 'I' WHERE e <> 'D'),
rep AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (k - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END,
                                   chr(10) ORDER BY p) AS t FROM got GROUP BY conv_id),
st AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
              count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id)
SELECT x.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit, sha256(coalesce(rep.t, '')) AS repaired_sha256
FROM full_ x LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN rep ON rep.conv_id IS NOT DISTINCT FROM x.conv_id
"""
)


@query("op12_conversation_repair", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.report(table(spark, folder, "conversations"))


OP13_SQL = (
    r"""
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[ 	-
]+') IF x <> ''] AS w FROM documents),
num AS (SELECT *, len(w) AS n, """
    + _crc_sql("doc_id::VARCHAR")
    + r""" AS h FROM raw),
par AS (SELECT *, (h // 10) % n AS a, h // 10 AS g FROM num WHERE n > 0),
doc AS (SELECT r, n, CASE WHEN h % 10 <> 0 THEN w ELSE list_transform(range(n), lambda i:
        w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM par),
tok AS (SELECT r, n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM doc),
tri AS (SELECT r, n, i, x || ' ' || lead(x) OVER v || ' ' || lead(x, 2) OVER v AS t FROM tok WINDOW v AS (PARTITION BY r ORDER BY i)),
met AS (SELECT a.r, a.i, b.i - a.i AS q FROM tri a JOIN tri b ON a.r = b.r AND a.t = b.t AND b.i > a.i AND (b.i - a.i) * 4 <= a.n),
isl AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM met),
per AS (SELECT r, q, min(i) AS s, count(*) + 2 + q AS l FROM isl GROUP BY r, q, k HAVING count(*) + 2 + q >= greatest(6, 4 * q)),
run AS (SELECT r, s, l, min(q) AS q FROM per GROUP BY r, s, l),
best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY l::DOUBLE / q DESC, s, q) AS k FROM run),
all_runs AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM tok ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli,
       sha256(coalesce(all_runs.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM raw LEFT JOIN all_runs USING (r) LEFT JOIN (SELECT * FROM best WHERE k = 1) b USING (r) LEFT JOIN kept USING (r)
"""
)


@query("op13_periodic_runs", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.report(table(spark, folder, "documents"))
