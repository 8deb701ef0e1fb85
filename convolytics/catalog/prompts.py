"""Queries over a corpus of prompt files, one made from each document."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolytics.catalog.common import messages, query, strip_sql
from convolytics.operators import messages as ms
from convolytics.operators import prompts as op
from convolytics.scale import ordered_parts
from convolytics.sources.prompts import clean_lines, load_prompt_lines
from convolytics.sources.views import raw, with_views

# Lines of a file by their number n: system lines with a variable, comments, learner
# lines (another role in every ninth file), functions, assistant lines, models. Some
# lines go on in the next one.
_LINE = """CASE n % 6
    WHEN 0 THEN CASE WHEN doc_id % 7 = 3 AND n > 0 THEN 'sys: {{ V }} ' ELSE 'sys: {{V}} ' END || l
    WHEN 1 THEN '# ' || l
    WHEN 2 THEN CASE WHEN doc_id % 9 = 0 THEN 'bot: ' ELSE 'usr: ' END || l
    WHEN 3 THEN 'func: f' || (n % 4) WHEN 4 THEN 'Ast : ' || l ELSE 'GPT-3.5-turbo' END
  || CASE WHEN (doc_id + n) % 5 = 0 AND n % 6 NOT IN (3, 5) THEN chr(92) ELSE '' END"""

_ORACLE = f"""WITH v_lines AS (
  SELECT doc_id AS file_id, n, {_LINE} AS line FROM (
    SELECT doc_id, i - 1 AS n, p[i] AS l FROM (
      SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))),
v_clean AS (
  SELECT * FROM (SELECT file_id, n, {strip_sql("line")} AS line FROM v_lines)
  WHERE line <> '' AND line NOT LIKE '#%'),
v_marked AS (
  SELECT *, right(line, 1) = chr(92) AS goes_on,
         coalesce(right(lag(line) OVER (PARTITION BY file_id ORDER BY n), 1) = chr(92), false)
           AS continues FROM v_clean),
v_dangling AS (
  SELECT file_id FROM (SELECT file_id, max_by(goes_on, n) AS open FROM v_marked GROUP BY file_id)
  WHERE open),
v_joined AS (
  SELECT file_id, pos, string_agg(CASE WHEN goes_on THEN left(line, length(line) - 1) ELSE line END,
                                  chr(10) ORDER BY n) AS line
  FROM (SELECT *, CAST(sum(CASE WHEN continues THEN 0 ELSE 1 END)
                       OVER (PARTITION BY file_id ORDER BY n) AS bigint) - 1 AS pos FROM v_marked)
  WHERE file_id NOT IN (SELECT file_id FROM v_dangling) GROUP BY file_id, pos),
v_heads AS (
  SELECT *, lower({strip_sql("split_part(line, ':', 1)")}) AS head,
         {strip_sql("CASE WHEN contains(line, ':') THEN substr(line, strpos(line, ':') + 1) ELSE '' END")}
           AS rest FROM v_joined),
v_kinds AS (
  SELECT *, CASE WHEN head = 'gpt-3.5-turbo' THEN 'model' WHEN head = 'func' THEN 'func'
                 WHEN head IN ('sys', 'usr', 'ast') THEN 'msg' END AS kind FROM v_heads),
v_parsed AS (
  SELECT file_id, pos, kind, CASE WHEN kind <> 'model' THEN head END AS role,
         CASE WHEN kind = 'model' THEN head ELSE rest END AS body
  FROM v_kinds WHERE file_id NOT IN (SELECT file_id FROM v_kinds WHERE kind IS NULL)),
v_vars AS (
  SELECT file_id, pos, {strip_sql("split_part(split_part(body, '{{', 2), '}}', 1)")} AS var
  FROM v_parsed WHERE role = 'sys' AND contains(body, '{{{{') AND contains(body, '}}}}'))
"""

_PARAMS = """, v_params AS (
  SELECT file_id, 'V' AS var, 'val' || file_id AS value FROM (SELECT DISTINCT file_id FROM v_parsed)
  WHERE file_id % 4 <> 0
  UNION ALL SELECT file_id, 'W', 'x' FROM (SELECT DISTINCT file_id FROM v_parsed)
  WHERE file_id % 4 = 1),
v_filled AS (
  SELECT p.file_id, p.pos, p.kind, p.role, CASE WHEN a.value IS NULL THEN p.body
           ELSE replace(p.body, '{{' || v.var || '}}', a.value) END AS body
  FROM v_parsed p LEFT JOIN v_vars v ON p.file_id = v.file_id AND p.pos = v.pos
  LEFT JOIN v_params a ON a.file_id = v.file_id AND a.var = v.var),
v_bad AS (
  SELECT file_id, 1 AS why, var FROM v_params a WHERE NOT EXISTS
    (SELECT 1 FROM v_vars v WHERE v.file_id = a.file_id AND v.var = a.var)
  UNION ALL SELECT file_id, 2, var FROM v_vars v WHERE NOT EXISTS
    (SELECT 1 FROM v_params a WHERE v.file_id = a.file_id AND v.var = a.var)
  UNION ALL SELECT file_id, 3, 'V' FROM v_filled
    WHERE role = 'sys' AND contains(body, '{{') AND contains(body, '}}'))"""


def files(spark, d):
    lines = "transform(split(text, char(10)), (l, n) -> " + _LINE.replace("chr(92)", "char(92)")
    text = F.expr(f"array_join({lines}), char(10))")
    return raw(spark, d, "documents").select(
        F.col("doc_id").alias("file_id"), text.alias("text")
    )


def prompts(spark, d):
    return op.read_prompts(files(spark, d))


@query("r1_load_prompt_lines", _ORACLE + " SELECT file_id, n, line FROM v_clean")
def r1(spark, d):
    return load_prompt_lines(files(spark, d))


def _joined(spark, d):
    lined = files(spark, d).select("file_id", clean_lines(F.col("text")).alias("lines"))
    return op.join_continuations(lined)


@query("w4_join_continuations", _ORACLE + " SELECT file_id, pos, line FROM v_joined")
def w4(spark, d):
    return _joined(spark, d)[0].select("file_id", F.posexplode("lines").alias("pos", "line"))


@query(
    "w4_dangling_rejects",
    _ORACLE + " SELECT file_id, 'the last line ends with a backslash' AS reason FROM v_dangling",
)
def w4_rejects(spark, d):
    return _joined(spark, d)[1].select("file_id", "reason")


@query("r2_parse_prompts", _ORACLE + " SELECT * FROM v_parsed")
def r2(spark, d):
    return prompts(spark, d)[0]


@query(
    "r2_prompt_rejects",
    _ORACLE + """ SELECT file_id, pos, line, 'unknown role' AS reason FROM v_kinds WHERE kind IS NULL
      UNION ALL SELECT file_id, count(*) - 1, max_by(line, n),
        'the last line ends with a backslash' FROM v_clean
      WHERE file_id IN (SELECT file_id FROM v_dangling) GROUP BY file_id""",
)
def r2_rejects(spark, d):
    return prompts(spark, d)[1]


@query(
    "r2_prompt_models",
    _ORACLE + " SELECT file_id, 'gpt-3.5-turbo' AS model FROM v_parsed GROUP BY file_id",
)
def r2_models(spark, d):
    return op.prompt_models(prompts(spark, d)[0])


@query("r3_template_vars", _ORACLE + " SELECT file_id, pos, var FROM v_vars")
def r3(spark, d):
    return op.template_vars(prompts(spark, d)[0])


def _substituted(spark, d):
    rows = prompts(spark, d)[0]
    ids = rows.select("file_id").distinct()
    value = F.concat(F.lit("val"), F.col("file_id").cast("string"))
    some = ids.where(F.col("file_id") % 4 != 0).select(
        "file_id", F.lit("V").alias("var"), value.alias("value")
    )
    odd = ids.where(F.col("file_id") % 4 == 1).select(
        "file_id", F.lit("W").alias("var"), F.lit("x").alias("value")
    )
    return op.substitute(rows, some.unionByName(odd))


@query(
    "r4_substitute",
    _ORACLE + _PARAMS + " SELECT * FROM v_filled WHERE file_id NOT IN (SELECT file_id FROM v_bad)",
)
def r4(spark, d):
    return _substituted(spark, d)[0]


@query(
    "r4_substitute_rejects",
    _ORACLE + _PARAMS + """ SELECT file_id, CASE why WHEN 1 THEN 'unknown parameter'
        WHEN 2 THEN 'missing parameter' ELSE 'variable is left' END AS reason, var
      FROM (SELECT file_id, min(why) AS why, min_by(var, (why, var)) AS var FROM v_bad
            GROUP BY file_id)""",
)
def r4_rejects(spark, d):
    return _substituted(spark, d)[1]


_GUARDED = _ORACLE + """, v_g AS (SELECT file_id, pos, role, CASE WHEN file_id % 2 = 0
      THEN replace(body, '{{V}}', 'v') ELSE body END AS body FROM v_parsed),
    v_left AS (SELECT file_id, pos FROM v_g
      WHERE role = 'sys' AND contains(body, '{{') AND contains(body, '}}'))"""


def _guarded(spark, d):
    plain = F.replace(F.col("body"), F.lit("{{V}}"), F.lit("v"))
    body = F.when(F.col("file_id") % 2 == 0, plain).otherwise(F.col("body"))
    return op.guard_templates(prompts(spark, d)[0].withColumn("body", body))


@query(
    "r5_guard_templates",
    _GUARDED + " SELECT file_id, pos, body FROM v_g WHERE file_id NOT IN "
    "(SELECT file_id FROM v_left)",
)
def r5(spark, d):
    return _guarded(spark, d)[0].select("file_id", "pos", "body")


@query("r5_guard_rejects", _GUARDED + " SELECT file_id, pos FROM v_left")
def r5_rejects(spark, d):
    return _guarded(spark, d)[1].select("file_id", "pos")


@query(
    "r6_compose",
    with_views("v_messages") + """ SELECT tid, 'a|b|c|d|e|x|' || t AS appended,
        t || '|a|b|c|d|e' AS prepended, 'a|' || t || '|b|c|d|e' AS inserted
      FROM (SELECT tid, string_agg(body, '|' ORDER BY turn) AS t FROM v_messages GROUP BY tid)""",
)
def r6(spark, d):
    one = F.struct("role", "body")
    # A row of the result holds a whole talk, so the parts of one meet in a row as well.
    parts = ordered_parts(messages(spark, d), ["tid"], [F.col("turn")], one, ms.PART_ROWS, "talk")
    lists = parts.groupBy("tid").agg(
        F.array_sort(F.collect_list(F.struct("part", "talk"))).alias("_p")
    )
    talks = lists.select("tid", F.flatten(F.transform("_p", lambda p: p["talk"])).alias("talk"))

    def block(words):
        return F.array(*[
            F.struct(F.lit("sys").alias("role"), F.lit(w).alias("body")) for w in words
        ])

    def text(col):
        return F.array_join(F.transform(col, lambda m: m["body"]), "|")

    base, talk = block("abcde"), F.col("talk")
    return talks.select(
        "tid",
        text(op.compose(base, talk, extra=block("x"))).alias("appended"),
        text(op.compose(base, talk, "prepend")).alias("prepended"),
        text(op.compose(base, talk, "insert")).alias("inserted"),
    )
