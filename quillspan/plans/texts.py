"""Queries on text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.functions import text as T
from quillspan.plans.registry import Registry
from quillspan.session import table

query = Registry()
q = lambda s: s.replace("'", "''")
TOKEN, PUNCT = q(T.token_pattern()), q(T._cls(T.PUNCTUATION))
HEAD = q(rf"^(?:{T.WORD}|[^\p{{L}}\p{{N}}_\s])")
SPACE = T.SPACE
NORM = rf"regexp_replace(regexp_replace(replace(translate(nfc_normalize(text), 'ёЁ', 'еЕ'), chr(173), ''), '[ \t]+', ' ', 'g'), '^{SPACE}|{SPACE}$', '', 'g')"


@query(f"SELECT line_id, {NORM} AS norm FROM gt_line")
def norm_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gt_line").select("line_id", T.scored_form(F.col("text")).alias("norm"))


@query(
    "SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
    " WHERE trim(l[i]) <> ''"
)
def split_lines(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return made.select("doc_id", F.col("line_no").cast("long"), "line").where(F.trim("line") != "")


@query(f"SELECT lang, count(*) AS n_tokens, count(DISTINCT m) AS n_distinct FROM (SELECT lang, unnest(regexp_extract_all(text, '{TOKEN}')) AS m FROM documents) GROUP BY lang")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(T.token_pattern()), F.lit(0))).alias("m"))
    return made.groupBy("lang").agg(F.count("*").alias("n_tokens"), F.count_distinct("m").alias("n_distinct"))


@query(
    f"SELECT punct_after, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(m, '{HEAD}', ''), '[\\s\\p{{Z}}]+', '', 'g') AS punct_after FROM"
    f" (SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS m FROM gt_line)) GROUP BY punct_after"
)
def punct_after_stats(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "gt_line").select(F.explode(T.token_array(F.col("text"))).alias("t"))
    return made.groupBy(F.col("t.punct_after").alias("punct_after")).agg(F.count("*").alias("n"))


@query(
    "SELECT line_id, i AS line_pos, w[i + 1] AS word, CASE WHEN i > 0 THEN w[i] END AS before, w[i + 2] AS after FROM"
    f" (SELECT line_id, w, unnest(range(0, len(w))) AS i FROM (SELECT line_id, list_filter(string_split_regex(text, '{SPACE}'), lambda x: x <> '') AS w FROM gt_line))"
)
def line_positions(spark: SparkSession, d: str) -> DataFrame:
    """Words of a line with their place and neighbours; neighbours are array elements, so nothing is sorted or shuffled."""
    made = table(spark, d, "gt_line").select("line_id", T.words_of(F.col("text")).alias("w")).select("line_id", "w", F.posexplode("w").alias("i", "word"))
    return made.select("line_id", F.col("i").cast("long").alias("line_pos"), "word", F.when(F.col("i") > 0, F.get("w", F.col("i") - 1)).alias("before"), F.get("w", F.col("i") + 1).alias("after"))


@query(
    f"SELECT core, count(*) AS n FROM (SELECT regexp_replace(lower(unnest(string_split_regex(text, '\\s+'))), '^[{PUNCT}]+|[{PUNCT}]+$', '', 'g') AS core FROM documents)"
    " WHERE core <> '' GROUP BY core ORDER BY n DESC, core LIMIT 50"
)
def word_core_top(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("w")).select(T.word_core(F.col("w")).alias("core"))
    return made.where("core <> ''").groupBy("core").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "core").limit(50)


_APOS = q(T.APOSTROPHES)
_UZ = (
    "SELECT line_id, CASE WHEN s IS NOT NULL AND regexp_matches(s, '[a-zA-Z]') AND NOT regexp_matches(s, '[^" + q(T.UZBEK_ALLOWED) + "]') THEN s END AS label FROM ("
    " SELECT line_id, CASE WHEN NOT contains(o, chr(1)) THEN trim(regexp_replace(o, '\\s+', ' ', 'g')) END AS s FROM ("
    "  SELECT line_id, list_aggregate(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN contains('" + _APOS + "', c[i]) THEN"
    "   CASE WHEN i = 1 OR contains('oOgG', c[i - 1]) THEN 'ʻ' WHEN regexp_full_match(c[i - 1], '\\p{L}') AND i < len(c) AND regexp_full_match(c[i + 1], '\\p{L}') THEN 'ʼ' ELSE chr(1) END"
    "   ELSE c[i] END), 'string_agg', '') AS o FROM (SELECT line_id, string_split(replace(nfc_normalize(text), chr(160), ' '), '') AS c FROM gt_line)))"
)


@query(_UZ)
def uzbek_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gt_line").select("line_id", T.uzbek_label(F.col("text")).alias("label"))


_WRAP = (
    "list_reduce(w, lambda acc, x: CASE WHEN length(regexp_extract(acc, '[^' || chr(10) || ']*$')) + 1 + length(x) <= 48 THEN acc || ' ' || x ELSE acc || chr(10) || x END)"
)


@query(
    "SELECT doc_id, par, i - 1 AS chunk_no, c[i] AS chunk FROM (SELECT doc_id, par, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, par, string_split(" + _WRAP + ", chr(10)) AS c FROM"
    f" (SELECT doc_id, j - 1 AS par, list_filter(string_split_regex(t[j], '{SPACE}'), lambda x: x <> '') AS w FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS j FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents))) WHERE len(w) > 0))"
    " WHERE length(c[i]) BETWEEN 20 AND 68"
)
def chunk_lines_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs wrapped greedily to 48 characters; chunks of 20 to 68 are kept. One fold a paragraph, in the row."""
    made = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("par", "t"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, w):
        grown = F.when(acc["open"] == "", w).otherwise(F.concat(acc["open"], F.lit(" "), w))
        fits = F.length(grown) <= 48
        full = F.when(fits | (acc["open"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(full.alias("done"), F.when(fits | (acc["open"] == ""), grown).otherwise(w).alias("open"))

    chunks = F.aggregate(T.words_of(F.col("t")), start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    return made.select("doc_id", "par", F.posexplode(chunks).alias("chunk_no", "chunk")).where(F.length("chunk").between(20, 68))


@query()
def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    """The same with a length drawn anew for each chunk from the document, the paragraph and the chunk's number."""
    made = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("par", "t"))
    return made.select("doc_id", "par", F.posexplode(T.wrapped(F.col("t"), F.col("doc_id"), F.col("par"))).alias("chunk_no", "chunk"))


_MATH_SQL = f"regexp_replace(trim(text), '(?i){q(T.ANSWER)}', '')"
for _a, _b in T.MATH_SIGNS:
    _MATH_SQL = f"replace({_MATH_SQL}, '{_a}', '{_b}')"
_MATH_SQL = f"regexp_replace(regexp_replace({_MATH_SQL}, '(\\d),(\\d)', '\\1.\\2', 'g'), '(\\d)\\s*:\\s*(\\d)', '\\1/\\2', 'g')"
for _a in T.MATH_DROPPED:
    _MATH_SQL = f"replace({_MATH_SQL}, '{_a}', '')"
_ROUGH = "'Ответ: ' || l_quantity::BIGINT || ' × ' || l_linenumber || ',5 − 12 : ' || l_linenumber || '² '"


@query(f"SELECT l_orderkey, l_linenumber, regexp_replace(trim({_MATH_SQL}), '[.;]+$', '') AS form FROM (SELECT l_orderkey, l_linenumber, {_ROUGH} AS text FROM lineitem)")
def math_forms(spark: SparkSession, d: str) -> DataFrame:
    """Formulas made of every order line, in one spelling."""
    n = F.col("l_linenumber").cast("string")
    text = F.concat(F.lit("Ответ: "), F.col("l_quantity").cast("long").cast("string"), F.lit(" × "), n, F.lit(",5 − 12 : "), n, F.lit("² "))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.math_form(text).alias("form"))


@query("SELECT p_partkey, unnest(list_filter(list_transform(string_split(p_name || ' || ' || p_brand || '||', '||'), lambda x: trim(x)), lambda x: x <> '')) AS form FROM part")
def accepted_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.explode(T.accepted_forms(F.concat("p_name", F.lit(" || "), "p_brand", F.lit("||")))).alias("form"))


_UNITS = "replace(CAST(l_quantity AS BIGINT) || ',5', '.', ',') || CASE l_linenumber % 3 WHEN 0 THEN ' м/с' WHEN 1 THEN ' кг' ELSE '' END"


@query(
    f"SELECT l_orderkey, l_linenumber, CAST(replace(regexp_extract(text, '{q(T.UNIT)}', 1), ',', '.') AS DOUBLE) AS value, lower(regexp_replace(regexp_extract(text, '{q(T.UNIT)}', 2), '\\s+', '', 'g')) AS unit"
    f" FROM (SELECT l_orderkey, l_linenumber, {_UNITS} AS text FROM lineitem) WHERE regexp_matches(text, '{q(T.UNIT)}')"
)
def unit_values(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    text = F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(",5"), F.when(n == 0, " м/с").when(n == 1, " кг").otherwise(""))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.unit_value(text).alias("u")).where("u is not null").select("l_orderkey", "l_linenumber", "u.value", "u.unit")


@query(
    "SELECT line_id, trim(regexp_replace(replace(text, chr(160), ' '), '[ \\t]+', ' ', 'g')) AS plain FROM gt_line WHERE NOT regexp_matches(text, '[<>&]')"
)
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    """Lines written as markup with entities, and read back."""
    text = F.replace(F.replace("text", F.lit("ш"), F.lit("&#1096;")), F.lit("–"), F.lit("&ndash;"))
    page = F.concat(F.lit("<p class='x'>"), F.replace(text, F.lit(" "), F.lit("&nbsp;")), F.lit("</p>"))
    return table(spark, d, "gt_line").where(~F.col("text").rlike("[<>&]")).select("line_id", T.strip_html(page).alias("plain"))


@query("SELECT doc_id, trim(coalesce(text, '')) AS answer FROM documents WHERE NOT contains(coalesce(text, ''), 'think>')")
def think_strip(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a thinking part before and after them."""
    text = F.coalesce("text", F.lit(""))
    thought = F.concat(F.lit("<think>"), F.coalesce("source", F.lit("?")), F.lit("\n...</think> "), text, F.lit(" <think>x</think>"))
    return table(spark, d, "documents").where(~F.contains(text, F.lit("think>"))).select("doc_id", T.strip_thinking(thought).alias("answer"))


@query("SELECT o_orderkey, o_orderstatus AS verdict, o_totalprice AS points FROM orders")
def answers_in_json(spark: SparkSession, d: str) -> DataFrame:
    """A model's answers in JSON behind its thinking, read back."""
    said = F.concat(F.lit("<think>{?}</think> Ответ: "), F.to_json(F.struct(F.col("o_orderstatus").alias("verdict"), F.col("o_totalprice").alias("points"))), F.lit(" конец"))
    return table(spark, d, "orders").select("o_orderkey", T.answer_json(said, "verdict string, points double").alias("a")).select("o_orderkey", "a.*")


@query(
    "SELECT line_id, text, bbox.x0::BIGINT % 1000 / CAST(999 AS DOUBLE) * 1200 AS x0, bbox.y1::BIGINT % 1000 / CAST(999 AS DOUBLE) * 1600 AS y1 FROM gt_line WHERE bbox IS NOT NULL AND NOT contains(text, '<|') AND NOT contains(text, chr(10))"
)
def grounding_parse(spark: SparkSession, d: str) -> DataFrame:
    """Lines and boxes written as a model's grounded output, and read back."""
    whole = lambda c: (F.round(F.col(f"bbox.{c}")).cast("long") % 1000).cast("string")
    tag = F.concat(F.lit("<|ref|>"), "text", F.lit("<|/ref|><|det|>[["), whole("x0"), F.lit(", "), whole("y0"), F.lit(", "), whole("x1"), F.lit(","), whole("y1"), F.lit("]]<|/det|> "))
    lines = table(spark, d, "gt_line").where("bbox is not null and not contains(text, '<|') and not contains(text, '\n')")
    return lines.select("line_id", F.explode(T.grounded_lines(tag, F.lit(1200), F.lit(1600))).alias("g")).select("line_id", "g.text", "g.x0", "g.y1")


@query("SELECT doc_id, regexp_full_match(text, '[0-9a-zA-Z+\\-*/=().,:<> ]+') AS linear FROM documents WHERE text IS NOT NULL")
def linear_ascii(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.is_linear_ascii(F.col("text")).alias("linear"))


@query(
    "SELECT line_id, (CASE WHEN k IS NULL THEN '' ELSE 'key: ' || k || chr(10) END) || '[' || d || (CASE WHEN v THEN '|verbatim' ELSE '' END) || ']' AS prompt FROM (SELECT line_id, CASE WHEN gi % 2 = 0 THEN text END AS k, CASE WHEN col_no = 0 THEN 'left' ELSE 'right' END AS d, gi % 3 = 0 AS v FROM gt_line)"
)
def reading_prompts(spark: SparkSession, d: str) -> DataFrame:
    k = F.when(F.col("gi") % 2 == 0, F.col("text"))
    return table(spark, d, "gt_line").select("line_id", T.prompt(F.when(F.col("col_no") == 0, "left").otherwise("right"), F.col("gi") % 3 == 0, k).alias("prompt"))


@query("SELECT split_name AS split, src AS source, count(*) AS n_rows, count(*) FILTER (writer IS NULL) AS n_no_writer, count(DISTINCT writer) AS n_writers FROM (SELECT *, lower(trim(coalesce(split, 'train'))) AS split_name, coalesce(source, '') AS src FROM train_label) GROUP BY split_name, src")
def mix_counters(spark: SparkSession, d: str) -> DataFrame:
    """What a training mixture is made of."""
    made = table(spark, d, "train_label").withColumns({"split": F.lower(F.trim(F.coalesce("split", F.lit("train")))), "source": F.coalesce("source", F.lit(""))})
    return made.groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.count_if(F.col("writer").isNull()).alias("n_no_writer"), F.count_distinct("writer").alias("n_writers"))


@query("SELECT label_id FROM train_label ORDER BY md5('7-' || label_id), label_id LIMIT 100")
def drawn_labels(spark: SparkSession, d: str) -> DataFrame:
    """A hundred labels drawn at random (a sampling operator): the first in the order of a hash of seed and key."""
    return table(spark, d, "train_label").select("label_id").orderBy(F.md5(F.concat_ws("-", F.lit(7), "label_id")), "label_id").limit(100)


@query("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 7, 0) AS whole FROM lineitem")
def rounded_to_even(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.rounded(F.col("l_extendedprice") / 7, 0).alias("whole"))


@query("SELECT split_name AS split, count(*) AS n_rows, count(DISTINCT norm) AS n_texts FROM (SELECT lower(trim(coalesce(split, 'train'))) AS split_name, " + NORM + " AS norm FROM train_label) GROUP BY split_name")
def distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "train_label").select(F.lower(F.trim(F.coalesce("split", F.lit("train")))).alias("split"), T.scored_form(F.col("text")).alias("norm"))
    return made.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("norm").alias("n_texts"))


ALPHABET = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
_CORES = f"(SELECT DISTINCT regexp_replace(lower(unnest(string_split_regex(text, '\\s+'))), '^[{PUNCT}]+|[{PUNCT}]+$', '', 'g') AS word FROM dictation_key)"


@query(
    "SELECT word, (2 * n + 1) * 32 - 2 * m + r AS n_candidates FROM (SELECT word, length(word) AS n, length(regexp_replace(word, '[^" + ALPHABET + "]', '', 'g')) AS m,"
    f" len(list_filter(range(1, length(word) + 1), lambda i: i = 1 OR substr(word, i, 1) <> substr(word, i - 1, 1))) AS r FROM {_CORES} WHERE word <> '')"
)
def one_edit_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Number of words one edit away from the distinct words of the dictation keys."""
    w = table(spark, d, "dictation_key").select(F.explode(F.split("text", r"\s+")).alias("w")).select(T.word_core(F.col("w")).alias("word")).where("word <> ''").distinct()
    return w.select("word", F.size(T.one_edit_words(F.col("word"), ALPHABET)).cast("long").alias("n_candidates"))


@query(
    f"SELECT word, CASE length(word) % 4 WHEN 0 THEN substr(word, 1, 1) || 'о' || substr(word, 3) WHEN 1 THEN substr(word, 1, 1) || substr(word, 3) WHEN 2 THEN substr(word, 1, 2) || substr(word, 2) ELSE substr(word, 1, 2) || 'о' || substr(word, 3) END AS edited FROM {_CORES} WHERE length(word) >= 3"
)
def applied_edits(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "dictation_key").select(F.explode(F.split("text", r"\s+")).alias("w")).select(T.word_core(F.col("w")).alias("word")).distinct().where("length(word) >= 3")
    n = F.length("word") % 4
    op = F.when(n == 0, "sub").when(n == 1, "del").when(n == 2, "dbl").otherwise("ins")
    # the letter that is put in takes the case of the letter it stands for
    return w.select("word", T.apply_edit(F.col("word"), op, F.lit(1), F.lit("о")).alias("edited"))


@query("SELECT writer, row_number() OVER (ORDER BY n DESC, writer) AS place, n FROM (SELECT writer, count(*) AS n FROM train_label WHERE writer IS NOT NULL GROUP BY writer) QUALIFY place <= 20")
def top_writers(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "train_label").where("writer is not null").groupBy("writer").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "writer").limit(20)
    return made.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "writer")).cast("long"))


QUERIES, ORACLE = query.queries, query.oracle
