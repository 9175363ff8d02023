"""The queries of this package, as __spark_entry__.py registers them: name -> f(spark, sf_dir), and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, line_dedup, merkle, packing, passages, pii, quality, resample, secrets, simhash, token_counts, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


URL_RULES = [
    url_filter.Rule("block", "com/en/"),
    url_filter.Rule("allow", "example.com/en/7"),
    url_filter.Rule("allow", "net/de/"),
    url_filter.Rule("block", "example.net/de/8"),
    url_filter.Rule("block", "org/es/"),
]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


OP2_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(action, rule, host_end, begins) AS (
  VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'),
         ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
fits AS (
  SELECT p.*, u.action, u.rule, row_number() OVER (PARTITION BY page_id ORDER BY length(u.rule) DESC, length(u.host_end) DESC) AS nth
  FROM parts p LEFT JOIN rules u ON ('.' || p.host) LIKE ('%.' || u.host_end) AND starts_with(p.path, u.begins))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE nth = 1
"""


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report_classes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", done["__tw_lines"].alias("n_lines"), done["__tw_removed"].alias("n_removed"))


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, pos, line, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS norm
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
firsts AS MATERIALIZED (
  SELECT norm, length(norm) AS n, min((doc_id, pos)) AS place FROM lines WHERE norm <> '' GROUP BY norm),
long AS MATERIALIZED (SELECT * FROM firsts WHERE n >= 20),
pairs AS (
  SELECT a.norm AS x, a.place AS px, b.norm AS y, b.place AS py FROM long a JOIN long b
    ON left(a.norm, a.n // 2) = left(b.norm, a.n // 2) AND b.n BETWEEN a.n - 1 AND a.n AND a.norm <> b.norm
  UNION
  SELECT a.norm, a.place, b.norm, b.place FROM long a JOIN long b
    ON right(a.norm, a.n - a.n // 2) = right(b.norm, a.n - a.n // 2) AND b.n BETWEEN a.n - 1 AND a.n AND a.norm <> b.norm),
near AS (
  SELECT CASE WHEN px < py THEN y ELSE x END AS norm FROM pairs WHERE levenshtein(x, y) <= 1),
kept AS (
  SELECT place FROM firsts WHERE norm NOT IN (SELECT norm FROM near)),
marked AS (
  SELECT l.doc_id, l.pos, l.line, l.norm, l.norm = '' OR k.place IS NOT NULL AS stays
  FROM lines l LEFT JOIN kept k ON k.place = (l.doc_id, l.pos))
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '') AS text,
       count(*) FILTER (WHERE norm <> '') AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_removed
FROM marked GROUP BY doc_id
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.assign(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes: bit by bit, the lowest first."""
    nibble = f"instr('0123456789ABCDEF', substr(hex({text}), 2 * (i // 8) + 2 - (i % 8) // 4, 1)) - 1"
    bits = f"list_transform(range(0, 4 * length(hex({text}))), lambda i: (({nibble}) >> (i % 4)) & 1)"
    return f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT), 4294967295)"


def _merkle_sql(levels: int = 9) -> str:
    """Trees of up to 8 ** levels leaves: their levels one after the other, each node's siblings, and a leaf folded with those of its ancestors."""
    told = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(told(text if c == 'text' else c) for c in merkle.FIELDS)})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, leaves: str) -> str:
        out = [f"{name}_0 AS MATERIALIZED ({leaves})"]
        for k in range(levels):
            out.append(f"""{name}_{k + 1} AS MATERIALIZED (
  SELECT tree, p // 8 AS p, any_value((n + 7) // 8) AS n, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY p)) END AS d FROM {name}_{k} GROUP BY tree, p // 8),
{name}_sides_{k} AS MATERIALIZED (
  SELECT tree, p, n, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}_{k} WINDOW w AS (PARTITION BY tree, p // 8 ORDER BY p))""")
        return ",\n".join(out)

    def fold(source: str, name: str, tree_is: str, place: str, digest: str, proof: str) -> str:
        joins = "\n".join(f"JOIN {name}_sides_{k} s{k} ON s{k}.tree = {tree_is} AND s{k}.p = {place} // {8**k}" for k in range(levels))
        sides = " || ".join([proof, *(f"s{k}.l || s{k}.r" for k in range(levels))])
        steps, at = [], f"SELECT x.*, {sides} AS sides, {digest} AS f0, [{', '.join(f'{{l: s{k}.l, r: s{k}.r, n: s{k}.n}}' for k in range(levels))}] AS steps FROM {source} x\n{joins}"
        for k in range(levels):
            steps.append(f"SELECT * EXCLUDE (f{k}), CASE WHEN steps[{k + 1}].n = 1 THEN f{k} ELSE sha256(steps[{k + 1}].l || f{k} || steps[{k + 1}].r) END AS f{k + 1} FROM (")
        return "".join(reversed(steps)) + at + ")" * levels

    return f"""
WITH docs AS (
  SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS now FROM documents),
langs AS (SELECT lang AS g, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER () AS n_trees FROM (SELECT DISTINCT lang FROM docs)),
placed AS MATERIALIZED (
  SELECT d.*, tree, n_trees, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n
  FROM docs d JOIN langs ON d.lang IS NOT DISTINCT FROM g),
{tree("t", "SELECT tree, place AS p, n, leaf AS d FROM placed")},
{tree("top", f"SELECT 0 AS tree, t.tree AS p, n_trees AS n, d FROM t_{levels} t JOIN langs USING (tree)")},
low AS ({fold("placed", "t", "x.tree", "x.place", "now", "''")}),
high AS ({fold("low", "top", "0", "x.tree", f"x.f{levels}", "x.sides").replace("x.*", f"x.* EXCLUDE (sides, steps, f{levels})")})
SELECT doc_id, leaf, t.d AS subroot, top.d AS root, sha256(sides) AS proof_sha256, f{levels} AS folded_root, f{levels} = top.d AS verified
FROM high JOIN t_{levels} t USING (tree) JOIN top_{levels} top ON TRUE
"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


OP13_SQL = f"""
WITH texts AS (
  SELECT * FROM (
    SELECT FALSE AS target, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT TRUE, row_number() OVER (), NULL, text FROM benchmark)),
words AS MATERIALIZED (
  SELECT target, row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
features AS MATERIALIZED (
  SELECT target, row, unnest(flatten([w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])])) AS f FROM words),
buckets AS MATERIALIZED (SELECT f, {crc32_sql("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM features)),
counts AS (SELECT b, count(*) FILTER (WHERE NOT target) AS s, count(*) FILTER (WHERE target) AS t FROM features JOIN buckets USING (f) GROUP BY b),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM counts),
gains AS (SELECT b, floor(1000 * ln((t::DOUBLE + 1) * (ss + 10000) / ((s::DOUBLE + 1) * (tt + 10000))))::BIGINT AS gain FROM counts, totals),
weighed AS (SELECT row, count(*) AS n, sum(gain)::BIGINT AS weight FROM features JOIN buckets USING (f) JOIN gains USING (b) WHERE NOT target GROUP BY row),
scored AS (
  SELECT doc_id, row, coalesce(len(w), 0) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (row) WHERE NOT target),
able AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS nth, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= 5 * n // 100 THEN nth END AS rank FROM scored LEFT JOIN able USING (row)
"""


def queries() -> dict[str, Query]:
    found = (
        op1_token_counts, op2_url_filters, op3_best_fit_packing, op4_pii, op5_secret_scans, op6_decontamination, op7_substring_dedup, op8_line_dedup, op9_simhash, op10_quality_rules,
        op11_merkle_manifest, op12_toxicity, op13_importance_resampling,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": OP2_SQL, "op8_line_dedup": OP8_SQL, "op11_merkle_manifest": _merkle_sql(), "op13_importance_resampling": OP13_SQL}
