"""URL filter: listed rules first, then per-host path templates judged by labelled purity.

The tree of a host is grown level by level over distinct path shapes (digit runs read as '#'). A branch keeps its literal segment only
where it has support and its labels differ from its siblings' by a two-proportion test, the stricter the more siblings are tested; all other
branches merge into one wildcard. The tree ends where no node with segments left has the support that a literal branch needs; those
segments are a wildcard each. A template is blocked where its share of good labels, smoothed towards its host's share,
that towards the share of all labels and that towards 1, is under `min_purity`.

Defined results: a null url, or one without '://', has empty host and path and template ''; without labels everything not ruled is
allowed; equal rows give equal rows; labels of ids that no page has only count for nothing; other columns are passed by.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.inputs import staged, table

#: (verdict, host, path): the rules that the registered query applies.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

MIN_SUPPORT = 20
SMOOTHING = 20
MIN_PURITY = 0.5

#: A branch (n, lab, good) against its parent's sums (all_n, all_lab, all_good) as one of `tested` branches: kept as a literal segment.
#: For one branch the test is at 1%; 2 ln(tested) more on the square keeps that for all together.
DISTINCT = f"""n >= {MIN_SUPPORT} AND CASE WHEN lab > 0 AND all_lab > lab THEN
  abs(good / lab - (all_good - good) / (all_lab - lab)) > sqrt(2.58 * 2.58 + 2 * ln(tested)) * sqrt((all_good / all_lab) * (1 - all_good / all_lab) * (1.0 / lab + 1.0 / (all_lab - lab)))
  ELSE false END"""
#: Levels whose finished rows are read one by one before they are written together.
TOGETHER = 32


def with_parts(urls: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    return urls.withColumn("host", F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(url, PARTS, 2))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, of, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        text, verdict = F.when(fits, f"{of}{start}").otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def shape(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]+", "#")


def path_templates(urls: DataFrame, labels: DataFrame) -> DataFrame:
    """host, shape, template and purity of each distinct path shape. `urls`: page_id, host, path; `labels`: page_id, good (0 or 1)."""
    sums = lambda *more: [F.sum(c).alias(c) for c in ("n", "lab", "good")] + list(more)
    known = labels.filter("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.max("good").alias("good"), F.lit(1).alias("lab"))
    nodes = (
        urls.select("page_id", "host", shape(F.col("path")).alias("shape")).join(known, "page_id", "left")
        .select("host", "shape", F.lit(1).alias("n"), F.coalesce("lab", F.lit(0)).alias("lab"), F.coalesce("good", F.lit(0)).cast("long").alias("good"))
        .groupBy("host", "shape").agg(*sums())
        .withColumn("tail", F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split(F.expr("substring(shape, 2)"), "/", -1)))
        .withColumn("template", F.lit(""))
    )
    nodes = staged(nodes, "url-shapes")
    ended: list[DataFrame] = []
    while True:
        ended.append(nodes.filter(F.size("tail") == 0))
        if len(ended) > TOGETHER:
            ended = [staged(reduce(DataFrame.unionByName, ended), "url-ended")]
        nodes = nodes.filter(F.size("tail") > 0)
        branches = nodes.groupBy("host", "template", F.col("tail")[0].alias("segment")).agg(*sums())
        tested = F.count_if((F.col("n") >= MIN_SUPPORT) & (F.col("lab") > 0)).alias("tested")
        whole = branches.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "lab", "good")], tested)
        # below a node with fewer pages or labels no branch can be literal
        whole = staged(whole.filter((F.col("all_n") >= MIN_SUPPORT) & (F.col("all_lab") > 1)), "url-nodes")
        if whole.isEmpty():
            break
        literal = branches.join(whole, ["host", "template"]).filter(DISTINCT).select("host", "template", "segment", F.lit(True).alias("literal"))
        step = F.concat(F.lit("/"), F.when(F.col("literal"), F.col("segment")).otherwise("*"))
        nodes = nodes.withColumn("segment", F.col("tail")[0]).join(literal, ["host", "template", "segment"], "left")
        rest = F.slice("tail", 2, F.greatest(F.size("tail") - 1, F.lit(0)))
        nodes = staged(nodes.select("host", "shape", "n", "lab", "good", rest.alias("tail"), F.concat("template", step).alias("template")), "url-tree")
    nodes = nodes.withColumn("template", F.concat("template", F.expr("repeat('/*', size(tail))")))
    nodes = staged(reduce(DataFrame.unionByName, ended, nodes), "url-leaves")
    per = staged(nodes.groupBy("host", "template").agg(*sums()), "url-templates")
    good, lab = per.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("lab"), F.lit(0))).first()
    rate = (good + SMOOTHING) / (lab + SMOOTHING)
    hosts = per.groupBy("host").agg(((F.sum("good") + SMOOTHING * F.lit(rate)) / (F.sum("lab") + SMOOTHING)).alias("host_rate"))
    purity = (F.col("good") + SMOOTHING * F.col("host_rate")) / (F.col("lab") + SMOOTHING)
    judged = per.join(hosts, "host").select("host", "template", purity.alias("purity"))
    return nodes.select("host", "shape", "template").join(judged, ["host", "template"])


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, min_purity: float = MIN_PURITY) -> DataFrame:
    urls = with_parts(pages.select("page_id", "url"))
    judged = staged(path_templates(urls, labels), "url-judged")
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < min_purity, "block").otherwise("allow")
    return (
        urls.withColumn("shape", shape(F.col("path"))).join(judged, ["host", "shape"])
        .select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity")
    )


def good_pages(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0).alias("good"))


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), good_pages(table(spark, sf_dir, "labels")))


def _sql() -> str:
    """For the given tables: four levels cover their paths, and none of their sections is literal, with the share or without."""
    depth = 4
    distinct = f"""n >= {MIN_SUPPORT} AND n >= 0.02 * all_n AND CASE WHEN lab > 0 AND all_lab > lab THEN
  abs(good / lab - (all_good - good) / (all_lab - lab)) > 2.58 * sqrt((all_good / all_lab) * (1 - all_good / all_lab) * (1.0 / lab + 1.0 / (all_lab - lab)))
  ELSE false END"""
    fits = [f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{}} END" for _, h, p in RULES]
    longest = sorted(range(len(RULES)), key=lambda i: -len(RULES[i][1] + RULES[i][2]))
    rule = ", ".join(fits[i].format(f"'{RULES[i][1]}{RULES[i][2]}'") for i in longest)
    verdict = ", ".join(fits[i].format(f"'{RULES[i][0]}'") for i in longest)
    steps, last = "", "t0"
    for d in range(depth):
        steps += f"""
b{d} AS (SELECT host, template, tail[1] AS segment, sum(n) AS n, sum(lab) AS lab, sum(good) AS good FROM t{d} WHERE len(tail) > 0 GROUP BY ALL),
l{d} AS (SELECT * FROM (SELECT *, sum(n) OVER w AS all_n, sum(lab) OVER w AS all_lab, sum(good) OVER w AS all_good FROM b{d} WINDOW w AS (PARTITION BY host, template)) WHERE {distinct}),
t{d + 1} AS (SELECT host, shape, n, lab, good, tail[2:] AS tail,
  concat(template, CASE WHEN len(tail) > 0 THEN concat('/', CASE WHEN EXISTS (SELECT 1 FROM l{d} l WHERE l.host = t{d}.host AND l.template = t{d}.template AND l.segment = tail[1]) THEN tail[1] ELSE '*' END) ELSE '' END) AS template FROM t{d}),"""
        last = f"t{d + 1}"
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path FROM pages),
s AS (SELECT *, regexp_replace(path, '[0-9]+', '#', 'g') AS shape FROM u),
k AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
t0 AS (SELECT host, shape, count(*) AS n, count(k.good) AS lab, coalesce(sum(k.good), 0) AS good,
  CASE WHEN shape = '' THEN [] ELSE string_split(shape[2:], '/') END AS tail, '' AS template FROM s LEFT JOIN k USING (page_id) GROUP BY host, shape),{steps}
f AS (SELECT host, shape, n, lab, good, concat(template, CASE WHEN len(tail) > 0 THEN '/**' ELSE '' END) AS template FROM {last}),
p AS (SELECT host, template, sum(lab) AS lab, sum(good) AS good FROM f GROUP BY ALL),
r AS (SELECT (CAST(coalesce(sum(good), 0) AS DOUBLE) + {SMOOTHING}) / (coalesce(sum(lab), 0) + {SMOOTHING}) AS rate FROM p),
h AS (SELECT host, (sum(good) + {SMOOTHING} * (SELECT rate FROM r)) / (sum(lab) + {SMOOTHING}) AS host_rate FROM p GROUP BY host),
j AS (SELECT host, template, (good + {SMOOTHING} * host_rate) / (lab + {SMOOTHING}) AS purity FROM p JOIN h USING (host))
SELECT page_id, host, path, coalesce({rule}, NULL) AS rule,
  coalesce({verdict}, CASE WHEN purity < {MIN_PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM s JOIN f USING (host, shape) JOIN j USING (host, template)
"""


QUERIES = {"op1_url_templates": op1_url_templates}
ORACLES = {"op1_url_templates": _sql()}
