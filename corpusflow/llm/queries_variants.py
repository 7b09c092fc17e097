"""Query of the spelling variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import variants
from corpusflow.llm.common import table
from corpusflow.llm.registry import query

#: crc(t): the 256 remainders of the checksum's polynomial. crc32(s) of a query that joins it is CRC % s.
CRC_TABLE = """crc AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
)"""
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range((length(hex(%s)) // 2)::BIGINT), lambda i:
    (strpos('0123456789ABCDEF', substr(hex(%s), 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(%s), 2 * i + 2, 1)) - 1)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""


def crc32(text: str) -> str:
    return CRC % (text, text, text)


# Near words by common remainders after one deletion, another way than the operator's.
SQL = f"""
WITH RECURSIVE {CRC_TABLE}, d AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run
    FROM documents
), r AS (
    SELECT id, run, count(*) AS n FROM d WHERE length(run) >= {variants.LEAST} GROUP BY ALL
), h AS (
    SELECT run, n, {crc32("id || ':' || run")} AS h FROM r, crc
), w AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
           sum(n)::BIGINT AS n
    FROM h GROUP BY 1 HAVING sum(n) >= {variants.TWICE} AND length(word) >= {variants.LEAST}
), x AS (
    SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)
), p AS (
    SELECT a.word, b.word AS other, b.n FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM x a JOIN w b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM x a JOIN w b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, min({{'minus': -n, 'form': other}}) AS lead FROM p GROUP BY 1
), f AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
           CASE WHEN -lead.minus >= {variants.RATIO} * w.n THEN lead.form END AS form,
           CASE WHEN -lead.minus >= {variants.RATIO} * w.n THEN -lead.minus END::BIGINT AS form_n
    FROM w LEFT JOIN best USING (word)
), walk AS (
    SELECT word, word AS at FROM f
    UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN walk USING (word) JOIN f l ON l.word = walk.at AND l.form IS NULL
"""


@query("op12_variants", SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return variants.group(table(spark, folder, "documents"))
