"""URL filter: fixed rules first, then a path-template tree per host with smoothed labelled purity.

A path's segments are generalised where they vary: one with a digit becomes `*` and its extension. Then, level by
level, the branches below a node are merged into `*` unless their share of bad labels differs significantly from
that of their siblings together (two-proportion z-test; its bound Z rises with the number of branches tested, as
sqrt(Z^2 + 2 ln branches), so that the chance of a false difference at a node stays about the same), down to the last
segment of the longest path. A template's bad share is smoothed towards its host's, and that towards the whole
table's (a quarter, where nothing is labelled); from REJECT on, the template's urls are blocked.

The tree is built from counts per host and generalised path, which are aggregated map-side, so a host that has a
third of all pages is no hot task; the last join, by host and generalised path, can be split by AQE.

Null urls and urls without `://` have an empty host and path and are judged like others. Labels of ids without a
page, nulls in labels and repeated label rows do no harm: a page is bad if any of its rows says so. Repeated pages
are judged each; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: DEPTH is the SQL's: its levels are written out, so it is the same for paths of that many segments.
DEPTH, LEAST, Z, WEIGHT, REJECT = 12, 5, 1.96, 10.0, 0.5

# The rules that come before the method.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule whose host is the url's or a parent of it and whose path starts the url's; its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """Segments after the leading slash; one with a digit is `*` and its extension."""
    return F.transform(F.split(F.regexp_replace(path, r"\A/", ""), "/"), lambda s: F.when(s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"\.[A-Za-z]+\z", 0))).otherwise(s))


def template_tree(paths: DataFrame) -> DataFrame:
    """paths (host, shape, segs, labelled, bad) with their template: a segment or `*` for each of theirs.

    A round tests one level of each open node and ends when none is. Open are nodes in which a level further down
    could still tell branches apart: what is left of their paths differs, and they have labels of both kinds and
    enough for two branches. Levels that all of a node's paths share are passed at once, and so is the rest of the
    others': they have no two branches to test. So the rounds are as many as the levels that branch."""
    tree = paths.withColumns({"template": F.lit(""), "at": F.lit(0)})
    total = lambda: (F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    stars = lambda n: F.repeat(F.lit("/*"), n)
    left = F.slice("segs", F.col("at") + 1, F.greatest(F.size("segs") - F.col("at"), F.lit(0)))
    while True:
        nodes = tree.where(F.size("segs") > F.col("at")).groupBy("host", "template").agg(*total(), F.min(left).alias("low"), F.max(left).alias("high"))
        differ = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), False)
        opened = nodes.where((F.col("labelled") >= 2 * LEAST) & (F.col("bad") > 0) & (F.col("bad") < F.col("labelled"))).select("host", "template", (differ - 1).cast("int").alias("common")).where("common >= 0")
        opened = materialize(opened, "open-nodes")
        if opened.isEmpty():
            break
        tree = tree.join(opened, ["host", "template"], "left").withColumns({"template": F.concat("template", stars(F.coalesce("common", F.lit(0)))), "at": F.col("at") + F.coalesce("common", F.lit(0)), "seg": F.when(F.col("common").isNotNull(), F.get("segs", F.col("at") + F.col("common")))}).drop("common")
        tree = materialize(tree, "level")
        branch = tree.where("seg is not null").groupBy("host", "template", "seg").agg(*total())
        node = branch.groupBy("host", "template").agg(F.count(F.lit(1)).alias("branches"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        b, rest_n, rest_bad = F.col("bad"), F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        enough = (F.col("labelled") >= LEAST) & (rest_n >= LEAST)
        pooled = F.try_divide(F.col("all_bad").cast("double"), F.col("all_labelled").cast("double"))
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("labelled").cast("double")) + F.try_divide(F.lit(1.0), rest_n.cast("double"))))
        gap = F.abs(F.try_divide(b.cast("double"), F.col("labelled").cast("double")) - F.try_divide(rest_bad.cast("double"), rest_n.cast("double")))
        own = F.coalesce(F.when(enough & (pooled > 0) & (pooled < 1), gap >= F.sqrt(Z * Z + 2 * F.ln(F.col("branches").cast("double"))) * spread), F.lit(False))
        named = branch.join(node, ["host", "template"]).select("host", "template", "seg", F.concat("template", F.lit("/"), F.when(own, F.col("seg")).otherwise("*")).alias("longer"))
        tree = tree.join(named, ["host", "template", "seg"], "left").withColumns({"template": F.coalesce("longer", "template"), "at": F.col("at") + F.when(F.col("longer").isNull(), 0).otherwise(1)}).drop("longer", "seg")
        tree = materialize(tree, "level")
    return tree.withColumn("template", F.concat("template", stars(F.size("segs") - F.col("at")))).drop("at")


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, bad_share). labels: (label_id, quality 0/1, toxic 0/1) of pages."""
    host, path = host_and_path(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("segs", segments(F.col("path"))).withColumn("shape", F.array_join("segs", "/"))
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("long")
    known = labels.where(F.col(label_id).isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())).groupBy(F.col(label_id).cast("long").alias("page_id")).agg(F.max(bad).alias("bad"))
    paths = rows.join(known, "page_id", "left").groupBy("host", "shape", "segs").agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = materialize(template_tree(materialize(paths, "paths")), "templates")
    bad_all, labelled_all = tree.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("labelled"), F.lit(0))).first()
    prior = (bad_all + 0.5) / (labelled_all + 2.0)
    hosts = tree.groupBy("host").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")).select("host", ((F.col("b") + WEIGHT * F.lit(prior)) / (F.col("n") + WEIGHT)).alias("host_share"))
    shares = tree.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")).join(hosts, "host").select("host", "template", ((F.col("b") + WEIGHT * F.col("host_share")) / (F.col("n") + WEIGHT)).alias("bad_share"))
    by_shape = tree.select("host", "shape", "template").join(shares, ["host", "template"])
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    out = rows.join(by_shape, ["host", "shape"], "left")
    own = F.when(F.col("bad_share") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "bad_share")


def judge_urls_sql(depth: int = DEPTH, rules=RULES) -> str:
    """The same in DuckDB's SQL, over the tables pages and labels."""
    rule = verdict = ""
    for text, says in sorted(rules, key=lambda r: -len(r[0])):
        name, slash, rest = text.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}')"
        rule, verdict = f"{rule} WHEN {fits} THEN '{text}'", f"{verdict} WHEN {fits} THEN '{says}'"
    levels = ""
    for i in range(depth):
        t = f"t{i}"
        levels += f"""
, b{i} AS MATERIALIZED (SELECT host, template, segs[{i + 1}] AS seg, sum(labelled) AS labelled, sum(bad) AS bad FROM {t} WHERE len(segs) > {i} GROUP BY ALL)
, n{i} AS MATERIALIZED (SELECT host, template, count(*) AS branches, sum(labelled) AS al, sum(bad) AS ab FROM b{i} GROUP BY ALL)
, m{i} AS MATERIALIZED (SELECT host, template, seg, template || '/' || CASE WHEN labelled >= {LEAST} AND al - labelled >= {LEAST} AND ab > 0 AND ab < al
    AND abs(bad / labelled - (ab - bad) / (al - labelled)) >= sqrt({Z * Z}::DOUBLE + 2 * ln(branches::DOUBLE)) * sqrt((ab / al) * (1 - ab / al) * (1 / labelled + 1 / (al - labelled)))
    THEN seg ELSE '*' END AS longer FROM b{i} JOIN n{i} USING (host, template))
, t{i + 1} AS MATERIALIZED (SELECT t.host, t.shape, t.segs, t.labelled, t.bad, coalesce(m.longer, t.template) AS template FROM {t} t LEFT JOIN m{i} m ON m.host = t.host AND m.template = t.template AND len(t.segs) > {i} AND m.seg = t.segs[{i + 1}])"""
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS cut FROM pages)
, r AS (SELECT page_id, CASE WHEN cut > 0 THEN substr(url, cut + 3) ELSE '' END AS rest FROM u)
, hp AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
, s AS (SELECT *, list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' || regexp_extract(x, '\\.[A-Za-z]+\\z') ELSE x END) AS segs FROM hp)
, rows_ AS (SELECT *, array_to_string(segs, '/') AS shape FROM s)
, known AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1)
, t0 AS MATERIALIZED (SELECT host, shape, segs, count(bad)::DOUBLE AS labelled, coalesce(sum(bad), 0)::DOUBLE AS bad, '' AS template FROM rows_ LEFT JOIN known USING (page_id) GROUP BY host, shape, segs){levels}
, tree AS (SELECT host, shape, labelled, bad, template || CASE WHEN len(segs) > {depth} THEN '/**' ELSE '' END AS template FROM t{depth})
, whole AS (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(labelled), 0) + 2.0::DOUBLE) AS prior FROM tree)
, hosts AS (SELECT host, (sum(bad) + {WEIGHT}::DOUBLE * any_value(prior)) / (sum(labelled) + {WEIGHT}::DOUBLE) AS host_share FROM tree, whole GROUP BY host)
, shares AS (SELECT host, template, (sum(bad) + {WEIGHT}::DOUBLE * any_value(host_share)) / (sum(labelled) + {WEIGHT}::DOUBLE) AS bad_share FROM tree JOIN hosts USING (host) GROUP BY host, template)
SELECT r.page_id, r.host, r.path, CASE{rule} END AS rule, coalesce(CASE{verdict} END, CASE WHEN bad_share >= {REJECT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, template, bad_share
FROM rows_ r LEFT JOIN (SELECT host, shape, template, bad_share FROM tree JOIN shares USING (host, template)) USING (host, shape)"""
