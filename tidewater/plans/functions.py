"""Scalar functions."""

from __future__ import annotations

from tidewater.plans.runner import Query as Q

QUERIES = [
    Q(
        "fn_string_basic",
        "SELECT p_partkey, LEN(p_name + '  ') AS n, UPPER(p_name) AS u, LOWER(p_type) AS l, LTRIM('  ' + p_name) AS lt, RTRIM(p_name + ' ') AS rt, TRIM(' ' + p_name + ' ') AS tr, LEFT(p_name, 4) AS le, RIGHT(p_name, 3) AS ri, SUBSTRING(p_name, 2, 5) AS su, REVERSE(p_name) AS re, REPLACE(p_name, 'a', 'A_') AS rp FROM part",
        "SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS n, upper(p_name) AS u, lower(p_type) AS l, p_name AS lt, p_name AS rt, p_name AS tr, left(p_name, 4) AS le, right(p_name, 3) AS ri, substr(p_name, 2, 5) AS su, reverse(p_name) AS re, replace(p_name, 'a', 'A_') AS rp FROM part",
    ),
    Q(
        "fn_string_search",
        "SELECT p_partkey, CHARINDEX('a', p_name) AS c, CHARINDEX('a', p_name, 4) AS c4, PATINDEX('%re%', p_name) AS p, ASCII(p_name) AS a, UNICODE(p_name) AS u, CHAR(65 + p_size % 26) AS ch, DATALENGTH(p_name) AS bytes FROM part",
        "SELECT p_partkey, CAST(instr(p_name, 'a') AS INTEGER) AS c, CAST(CASE WHEN instr(substr(p_name, 4), 'a') > 0 THEN instr(substr(p_name, 4), 'a') + 3 ELSE 0 END AS INTEGER) AS c4, CAST(instr(p_name, 're') AS INTEGER) AS p, ascii(p_name) AS a, unicode(p_name) AS u, chr(CAST(65 + p_size % 26 AS INTEGER)) AS ch, CAST(strlen(p_name) * 2 AS INTEGER) AS bytes FROM part",
    ),
    Q(
        "fn_string_build",
        "SELECT n_nationkey, CONCAT(n_name, NULL, n_regionkey) AS c, CONCAT_WS('/', n_name, NULL, 'z') AS w, STUFF(n_name, 2, 3, '##') AS s, REPLICATE('ab', n_regionkey) AS r, SPACE(2) + 'x' AS sp, TRANSLATE(n_name, 'NAT', 'xyz') AS t, QUOTENAME(n_name) AS q, PARSENAME('a.' + n_name, 1) AS p, STR(n_regionkey + 0.256, 8, 2) AS st FROM nation",
        "SELECT n_nationkey, concat(n_name, CAST(n_regionkey AS VARCHAR)) AS c, n_name || '/z' AS w, CASE WHEN length(n_name) < 2 THEN NULL ELSE left(n_name, 1) || '##' || substr(n_name, 5) END AS s, repeat('ab', n_regionkey) AS r, '  x' AS sp, translate(n_name, 'NAT', 'xyz') AS t, '[' || n_name || ']' AS q, n_name AS p, lpad(printf('%.2f', n_regionkey + 0.256), 8, ' ') AS st FROM nation",
    ),
    Q(
        "fn_string_escape",
        "SELECT page_id, LEN(STRING_ESCAPE(html, 'html')) AS n, UNISTR('\\0041\\00e9') AS u, SOUNDEX('Robert') AS s, DIFFERENCE('Smith', 'Smythe') AS d, SOUNDEX('') AS e FROM pages",
        "SELECT page_id, CAST(length(rtrim(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;'))) AS INTEGER) AS n, 'Aé' AS u, 'R163' AS s, 4 AS d, '0000' AS e FROM pages",
    ),
    Q(
        "fn_format",
        "SELECT p_partkey, FORMAT(p_retailprice, 'N2') AS n, FORMAT(p_size, 'D5') AS d, FORMAT(p_retailprice, 'C') AS c FROM part",
        "SELECT p_partkey, format('{:,.2f}', p_retailprice) AS n, lpad(CAST(p_size AS VARCHAR), 5, '0') AS d, '$' || format('{:,.2f}', p_retailprice) AS c FROM part",
    ),
    Q(
        "fn_date_parts",
        "SELECT event_id, YEAR(ts) AS y, MONTH(ts) AS m, DAY(ts) AS d, DATEPART(hour, ts) AS h, DATEPART(quarter, ts) AS q, DATEPART(dayofyear, ts) AS dy, DATEPART(weekday, ts) AS wd, DATENAME(month, ts) AS mn, DATENAME(weekday, ts) AS dn FROM events",
        "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(quarter(ts) AS INTEGER) AS q, CAST(dayofyear(ts) AS INTEGER) AS dy, CAST(dayofweek(ts) + 1 AS INTEGER) AS wd, monthname(ts) AS mn, dayname(ts) AS dn FROM events",
    ),
    Q(
        "fn_date_add_diff",
        "SELECT o_orderkey, DATEADD(month, 1, o_orderdate) AS m1, DATEADD(day, -45, o_orderdate) AS d45, DATEDIFF(month, o_orderdate, '1998-08-02') AS dm, DATEDIFF(day, o_orderdate, '1998-08-02') AS dd, DATEDIFF(year, o_orderdate, '1998-08-02') AS dy, EOMONTH(o_orderdate) AS e, ISDATE('2024-02-30') AS bad FROM orders",
        "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH AS TIMESTAMP) AS m1, CAST(o_orderdate - INTERVAL 45 DAY AS TIMESTAMP) AS d45, CAST(date_diff('month', o_orderdate, TIMESTAMP '1998-08-02') AS INTEGER) AS dm, CAST(date_diff('day', o_orderdate, TIMESTAMP '1998-08-02') AS INTEGER) AS dd, CAST(date_diff('year', o_orderdate, TIMESTAMP '1998-08-02') AS INTEGER) AS dy, last_day(o_orderdate) AS e, 0 AS bad FROM orders",
    ),
    Q(
        "fn_date_diff_fine",
        "SELECT event_id, DATEDIFF_BIG(second, '2024-01-01', ts) AS s, DATEDIFF_BIG(minute, '2024-01-01', ts) AS m, DATEDIFF_BIG(hour, '2024-01-01', ts) AS h FROM events",
        "SELECT event_id, date_diff('second', TIMESTAMP '2024-01-01', ts) AS s, date_diff('minute', TIMESTAMP '2024-01-01', ts) AS m, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS h FROM events",
    ),
    Q(
        "fn_math",
        "SELECT p_partkey, ABS(-p_size) AS a, CAST(CEILING(p_retailprice) AS FLOAT) AS c, CAST(FLOOR(p_retailprice) AS FLOAT) AS f, ROUND(p_retailprice, 1) AS r, ROUND(p_size, -1) AS r10, SIGN(p_size - 25) AS s, POWER(p_size, 2) AS p, ROUND(SQRT(p_size), 9) AS q, CAST(SQUARE(p_size) AS FLOAT) AS sq FROM part",
        "SELECT p_partkey, abs(-p_size) AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(p_retailprice, 1) AS r, CAST(round(p_size, -1) AS INTEGER) AS r10, CAST(sign(p_size - 25) AS DOUBLE) AS s, pow(p_size, 2) AS p, round(sqrt(p_size), 9) AS q, CAST(p_size * p_size AS DOUBLE) AS sq FROM part",
    ),
    Q(
        "fn_math_trig",
        "SELECT p_partkey, ROUND(SIN(p_size), 9) AS s, ROUND(COS(p_size), 9) AS c, ROUND(TAN(p_size), 6) AS t, ROUND(ATN2(p_size, 3), 9) AS a, ROUND(DEGREES(p_size), 6) AS d, ROUND(RADIANS(p_size * 1e0), 9) AS r, ROUND(LOG(p_size), 9) AS l, ROUND(LOG(p_size, 2), 9) AS l2, ROUND(CAST(LOG10(p_size * 1e0) AS FLOAT), 9) AS l10, ROUND(COT(p_size), 6) AS k, ROUND(PI(), 9) AS pi FROM part",
        "SELECT p_partkey, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(tan(p_size), 6) AS t, round(atan2(p_size, 3), 9) AS a, round(degrees(p_size), 6) AS d, round(radians(p_size), 9) AS r, round(ln(p_size), 9) AS l, round(log2(p_size), 9) AS l2, round(log10(p_size), 9) AS l10, round(cot(p_size), 6) AS k, round(pi(), 9) AS pi FROM part",
    ),
    Q(
        "fn_logic",
        "SELECT p_partkey, ISNULL(NULLIF(p_size, 5), -1) AS i, COALESCE(NULL, NULLIF(p_size, 6), 0) AS c, IIF(p_size > 25, 'big', 'small') AS f, NULLIF(p_size, 7) AS n, CHOOSE(p_size % 3 + 1, 'a', 'b') AS ch, GREATEST(p_size, 10, p_partkey) AS g, LEAST(p_size, NULLIF(10, p_size)) AS l FROM part",
        "SELECT p_partkey, coalesce(NULLIF(p_size, 5), -1) AS i, coalesce(NULLIF(p_size, 6), 0) AS c, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS f, NULLIF(p_size, 7) AS n, CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS ch, greatest(CAST(p_size AS BIGINT), 10, p_partkey) AS g, CASE WHEN p_size <> 10 THEN least(p_size, 10) END AS l FROM part",
    ),
    Q(
        "fn_json_read",
        "SELECT event_id, JSON_VALUE(props, '$.k') AS v, ISJSON(props) AS ok, JSON_PATH_EXISTS(props, '$.zz') AS z, JSON_KEYS(props) AS keys, JSON_QUERY('{\"a\":{\"b\":[1,2]}}', '$.a.b') AS q, JSON_ARRAY_LENGTH('[1,2,3]') AS n, JSON_VALUE('{\"arr\":[5,6]}', '$.arr[1]') AS at FROM events",
        "SELECT event_id, props::JSON ->> 'k' AS v, TRUE AS ok, FALSE AS z, CAST(to_json(json_keys(props)) AS VARCHAR) AS keys, '[1,2]' AS q, 3 AS n, '6' AS at FROM events",
    ),
    Q(
        "fn_json_modify",
        "SELECT n_nationkey, JSON_MODIFY('{\"a\":1,\"b\":{\"c\":2}}', '$.b.c', n_name) AS m, JSON_MODIFY('{\"a\":1}', '$.z', n_nationkey) AS z FROM nation",
        "SELECT n_nationkey, '{\"a\":1,\"b\":{\"c\":\"' || n_name || '\"}}' AS m, '{\"a\":1,\"z\":' || n_nationkey || '}' AS z FROM nation",
    ),
    Q(
        "fn_regexp",
        "SELECT doc_id, REGEXP_LIKE(text, 'the\\s+[a-z]+', 'i') AS l, REGEXP_COUNT(text, '[A-Z][a-z]+') AS n, LEN(REGEXP_REPLACE(text, '[aeiou]', '')) AS r, REGEXP_SUBSTR(text, '[a-z]{4,}', 1, 2) AS s FROM documents",
        "SELECT doc_id, regexp_matches(text, '(?i)the\\s+[a-z]+') AS l, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS INTEGER) AS n, CAST(length(rtrim(regexp_replace(text, '[aeiou]', '', 'g'))) AS INTEGER) AS r, regexp_extract_all(text, '[a-z]{4,}')[2] AS s FROM documents",
    ),
    Q(
        "fn_regexp_instr",
        "SELECT n_nationkey, REGEXP_INSTR(n_name, '[0-9]+') AS a, REGEXP_INSTR('a1b22c333', '[0-9]+', 1, 3) AS b, REGEXP_INSTR('a1b22c333', '[0-9]+', 1, 2, 1) AS e, REGEXP_INSTR(n_name, 'zzz') AS z FROM nation",
        "SELECT n_nationkey, 8 AS a, 7 AS b, 6 AS e, 0 AS z FROM nation",
    ),
    Q(
        "fn_fuzzy",
        "SELECT a.n_nationkey AS x, b.n_nationkey AS y, EDIT_DISTANCE(a.n_name, b.n_name) AS d, CAST(EDIT_DISTANCE_SIMILARITY(a.n_name, b.n_name) AS FLOAT) AS s, CAST(JARO_WINKLER_SIMILARITY(a.n_name, b.n_name) AS FLOAT) AS j FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
        "SELECT a.n_nationkey AS x, b.n_nationkey AS y, CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) AS d, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 9) AS s, round(jaro_winkler_similarity(a.n_name, b.n_name), 9) AS j FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
    ),
    Q(
        "vector_distances",
        "SELECT a.vec_id, ROUND(VECTOR_DISTANCE('euclidean', a.embedding, b.embedding), 4) AS l2, ROUND(VECTOR_DISTANCE('cosine', a.embedding, b.embedding), 4) AS c, ROUND(VECTOR_DISTANCE('dot', a.embedding, b.embedding), 4) AS d FROM embeddings a CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 7) b",
        "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS l2, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS c, round(-list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) + 0.0 AS d FROM embeddings a CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 7) b",
    ),
    Q("fn_hash", "SELECT n_nationkey, LOWER(CONVERT(VARCHAR(64), HASHBYTES('MD5', n_name), 2)) AS m, LOWER(CONVERT(VARCHAR(64), HASHBYTES('SHA2_256', n_name), 2)) AS s FROM nation", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s FROM nation"),
]
