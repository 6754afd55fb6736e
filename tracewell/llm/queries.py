"""The registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import table
from tracewell.llm.decontaminate import UNITS, contaminated
from tracewell.llm.exact_dedup import exact_duplicates
from tracewell.llm.html_extract import extract
from tracewell.llm.langid import identify
from tracewell.llm.line_dedup import dedup_lines
from tracewell.llm.minhash import near_duplicates
from tracewell.llm.packing import pack
from tracewell.llm.suffix_dedup import remove_repeats
from tracewell.llm.tokens import token_counts
from tracewell.llm.toxicity import classify
from tracewell.session import ship


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every whole text; null and empty texts have one empty line. Rows that repeat a doc_id, null included, are one document, each with a row."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("tw_n_lines").alias("n_lines"), F.col("tw_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row by its own whole text, whatever its id; null and empty texts have no tokens."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row; null and empty texts are equal. Ties of length go to the smallest doc_id, null ids last; equal rows that repeat an id are all kept."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row by its own whole text, whatever its id; und where the text is null or has no letter. Of equally likely languages the first by name."""
    return identify(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a row; rows that repeat a doc_id are judged together. Of items that are covered equally the smallest; null and empty texts match none. Windows match
    as the SQL has them; the looser matches of the operator are the pipeline's."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), loose=False)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row; a null doc_id counts as the smallest, rows that repeat a doc_id as one document whose equal starts are equally early."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least one piece for every row, null and empty texts included; rows that repeat a doc_id are packed each for itself."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row; null and empty pages have an empty text, broken and null URLs are one host. Equal rows have equal texts but for their neighbours."""
    return extract(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row by its own whole text, whatever its id; null and empty texts get the score of texts that match nothing."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row by its own whole text; rows without a doc_id or without words stay alone. A table of any of these without rows gives none."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5_decontamination,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_packing": op7_packing,
    "op8_html_extraction": op8_html_extraction,
    "op9_toxicity": op9_toxicity,
    "op10_near_dedup": op10_near_dedup,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each query, with this package sent to the executors before it runs."""
    return {name: (lambda spark, sf_dir, f=f: f(ship(spark), sf_dir)) for name, f in QUERIES.items()}


_CANONICAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(coalesce(text, ''),
    '([\p{Ll},;] )(\p{Lu}\p{Ll}+)', '\1' || chr(57344) || 'x\2' || chr(57345), 'g')),
    '[^\p{L}\p{M}\p{Nd}' || chr(57344) || chr(57345) || ']+', ' ', 'g'),
    '([0-9]) ?(UNITS)( |$)', '\1 ' || chr(57344) || 'u\2' || chr(57345) || '\3', 'g'),
    '[0-9]+', chr(57344) || 'n\0' || chr(57345), 'g'))""".replace("UNITS", "|".join(sorted(UNITS, key=lambda u: (-len(u), u))))
_TEMPLATE = "regexp_replace({}, chr(57344) || '(.)[^' || chr(57345) || ']*' || chr(57345), chr(57344) || '\\1', 'g')"
_SLOTS = "regexp_extract_all({}, chr(57344) || '([^' || chr(57345) || ']*)' || chr(57345), 1)"

ORACLES: dict[str, str] = {
    "op5_decontamination": f"""
        WITH d AS (SELECT doc_id, string_split({_CANONICAL}, ' ') AS w FROM documents),
        dw AS (SELECT doc_id, i - 1 AS pos, array_to_string(list_slice(w, i, i + 4), ' ') AS win
               FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
        b AS (SELECT item_id, string_split({_CANONICAL}, ' ') AS w FROM benchmark),
        bw AS (SELECT item_id, i - 1 AS ipos, array_to_string(list_slice(w, i, i + 4), ' ') AS iwin
               FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
        sizes AS (SELECT item_id, count(*) AS n_windows FROM bw GROUP BY item_id),
        dt AS (SELECT *, {_TEMPLATE.format("win")} AS t FROM dw),
        bt AS (SELECT *, {_TEMPLATE.format("iwin")} AS t FROM bw),
        hits AS (SELECT doc_id, item_id, pos - ipos AS shift, ipos, win, iwin FROM dt JOIN bt USING (t)),
        slots AS (SELECT DISTINCT doc_id, item_id, shift, unnest({_SLOTS.format("iwin")}) AS theirs, unnest({_SLOTS.format("win")}) AS ours FROM hits),
        judged AS (SELECT doc_id, item_id, shift, count(*) > count(DISTINCT theirs) AS clash, bool_or(theirs <> ours) AS moved
                   FROM slots GROUP BY ALL),
        per_item AS (
          SELECT h.doc_id, h.item_id, count(DISTINCT ipos) AS n_matched, coalesce(bool_or(moved), false) AS changed
          FROM hits h LEFT JOIN judged j ON h.doc_id = j.doc_id AND h.item_id = j.item_id AND h.shift = j.shift
          WHERE NOT coalesce(clash, false) GROUP BY ALL),
        best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_matched / n_windows DESC, item_id) AS r
                 FROM per_item JOIN sizes USING (item_id))
        SELECT d.doc_id, b.item_id, coalesce(n_matched, 0) AS n_matched, coalesce(n_windows, 0) AS n_windows,
               coalesce(changed, false) AS changed, coalesce(n_matched * 100 >= n_windows * 75, false) AS contaminated
        FROM documents d LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON b.doc_id = d.doc_id""",
    "op10_near_dedup": r"""
        WITH RECURSIVE words AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (
          SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ')) AS s
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        pairs AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
          GROUP BY ALL),
        links AS (
          SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
          WHERE 100 * common >= 75 * (x.n + y.n - common)),
        reach AS (
          SELECT doc_id AS id, doc_id AS to_id FROM sizes
          UNION
          SELECT r.id, l.b FROM reach r JOIN links l ON r.to_id = l.a),
        comp AS (SELECT id, min(to_id) AS c FROM reach GROUP BY id)
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id,
               d.doc_id = coalesce(c.c, d.doc_id) AS kept
        FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN comp c ON c.id = d.doc_id""",
    "op6_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        w AS (SELECT doc_id, i, md5_number(array_slice(b, i, i + 99)) AS h
              FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS i FROM d)),
        f AS (SELECT h, min(doc_id) AS d0, arg_min(i, (doc_id, i)) AS i0 FROM w GROUP BY h HAVING count(*) > 1),
        dup AS (SELECT doc_id, i FROM w JOIN f USING (h) WHERE doc_id > d0 OR i > i0),
        edge AS (SELECT doc_id, i, coalesce(i > lag(i) OVER o + 100, true) AS opens FROM dup WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        numbered AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM edge),
        spans AS (SELECT doc_id, k, min(i) AS s, max(i) + 100 AS e FROM numbered GROUP BY ALL),
        cuts AS (
          SELECT doc_id, s, e FROM spans UNION ALL SELECT doc_id, octet_length(b) + 1, octet_length(b) + 1 FROM d),
        kept AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s, e), 1) AS a, s AS z, e - s AS gone, e > s AS is_span FROM cuts)
        SELECT doc_id, any_value(octet_length(b)) AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(count(*) FILTER (WHERE is_span) AS BIGINT) AS n_spans,
               sha256(unhex(string_agg(CASE WHEN z > a THEN hex(array_slice(b, a, z - 1)) ELSE '' END, '' ORDER BY z, is_span DESC))) AS kept_sha256
        FROM kept JOIN d USING (doc_id) GROUP BY doc_id""",
    "op1_line_dedup": r"""
        WITH lines AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
          FROM documents),
        keyed AS (
          SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        often AS (
          SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
          GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        marked AS (
          SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.last AS dropped
          FROM keyed k LEFT JOIN often o ON k.key = o.key)
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op3_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, length(coalesce(text, '')) AS n,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
        FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)""",
}
